"""Feature tables and verdicts for model evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinage import params as P
from vicinage.operators.clean import number
from vicinage.operators.ranking import cumulative
from vicinage.store import once


def _as_number(df: DataFrame, c: str) -> Column:
    """A column as double; booleans are 1 and 0."""
    return F.col(c).cast("double") if dict(df.dtypes)[c] == "boolean" else number(F.col(c))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG13: (column, share, numeric): the share of rows that parse as number. One pass for all columns."""
    shares = df.agg(*(F.avg(_as_number(df, c).isNotNull().cast("double")).alias(c) for c in columns))
    long = shares.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0.0)).alias("share")) for c in columns))).alias("_x")).select("_x.*")
    return long.withColumn("numeric", F.col("share") > P.DEFAULT.numeric_share)


def medians(df: DataFrame, columns: list[str], accuracy: int | None = None) -> dict[str, float | None]:
    """AGG12: exact medians of columns, or approximate ones of the given accuracy, all in one pass.

    Exact ones come from the counts of distinct values in order, which no task holds all of.
    """
    if not columns:
        return {}
    if accuracy:
        return df.agg(*(F.percentile_approx(_as_number(df, c), 0.5, accuracy).alias(c) for c in columns)).first().asDict()
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), _as_number(df, c).alias("value")) for c in columns))).alias("_x")).select("_x.*").where("value IS NOT NULL")
    counts = cumulative(long.groupBy("column", "value").agg(F.count("*").alias("n")), "value", "n", "upto", ("column",))
    total = counts.groupBy("column").agg(F.sum("n").alias("total"))
    # the middle value, or the two in the middle
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    holds = lambda k: (F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)
    middle = counts.join(total, "column").groupBy("column").agg(((F.min(F.when(holds(low), F.col("value"))) + F.min(F.when(holds(high), F.col("value")))) / 2).alias("m"))
    return {c: None for c in columns} | {r["column"]: r["m"] for r in middle.collect()}


def median_fill(df: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """AGG12: columns as numbers with nulls replaced by the median."""
    return df.withColumns({c: F.coalesce(_as_number(df, c), F.lit(m).cast("double")) for c, m in medians(df, columns, accuracy).items()})


#: Values of all columns together that are numbered as one small table, and characters of a column's values that are sent to every task at most.
FEW_VALUES, SENT = 50_000, 4 << 20


def codes(df: DataFrame, column: str) -> DataFrame:
    """FEA2: (value, code): distinct values numbered from 0 in sorted order. Only the dictionary is ordered."""
    return dictionary(distinct_values(df, [column])).select("value", "code")


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of all columns in one pass, computed once."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("_x")).select("_x.*")
    return once(long.where("value IS NOT NULL").distinct())


def dictionary(values: DataFrame, few: bool = False) -> DataFrame:
    """FEA2: (column, value, code) from distinct_values(). Few of them are numbered by a window; many in ranges, of which no task sees all."""
    if few:
        return values.withColumn("code", F.row_number().over(Window.partitionBy("column").orderBy("value")) - 1)
    ranked = cumulative(values.withColumn("_one", F.lit(1)), "value", "_one", "_n", ("column",))
    return ranked.select("column", "value", (F.col("_n") - 1).cast("int").alias("code"))


def encode(df: DataFrame, *columns: str) -> DataFrame:
    """FEA2: columns replaced by their codes, -1 for null.

    The values of all columns are found in one pass. A column's codes go to every task if they are short enough, so that the table is
    not shuffled; others are joined.
    """
    if not columns:
        return df
    values = distinct_values(df, list(columns))
    sizes = {r["column"]: (r["n"], r["chars"]) for r in values.groupBy("column").agg(F.count("*").alias("n"), F.sum(F.length("value") + 24).alias("chars")).collect()}
    few = sum(n for n, _ in sizes.values()) <= FEW_VALUES
    found = dictionary(values, few)
    found = found if few else once(found)
    for c in columns:
        of = found.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("code").alias("_code"))
        of = F.broadcast(of) if sizes.get(c, (0, 0))[1] <= SENT else of
        df = df.join(of, F.col(c).cast("string") == F.col("_v"), "left").withColumn(c, F.coalesce("_code", F.lit(-1))).drop("_v", "_code")
    return df


def structured(df: DataFrame, key: str, exclude: tuple[str, ...] = (), accuracy: int | None = None) -> DataFrame:
    """FEA1, SET3: key and features: numeric columns filled by the median, others as codes."""
    columns = [c for c in df.columns if c != key and c not in exclude]
    numeric = {r["column"] for r in column_profile(df, columns).where("numeric").collect()} if columns else set()
    out = median_fill(df.select(key, *columns), [c for c in columns if c in numeric], accuracy)
    return encode(out, *(c for c in columns if c not in numeric)).select(key, *columns)


def condition_sets(df: DataFrame, key: str, target: str, text: str, image: str | None = None) -> dict[str, DataFrame]:
    """FEA3: the feature set of each condition, all keyed alike."""
    base = structured(df, key, tuple(c for c in (target, text, image) if c))
    add = lambda *cs: base.join(df.select(key, *cs), key)
    out = {"structured": base, "unstructured_text": df.select(key, text), "joint_text": add(text)}
    return out | ({"unstructured_image": df.select(key, image), "joint_image": add(image)} if image else {})


def criteria(report: DataFrame, modality: str = "text") -> DataFrame:
    """AGG14: (learner, joint_signal, tar_gain, passed); a NaN or null score passes nothing."""
    frozen, tar, alone = (F.col(f"{a}_{modality}{b}") for a, b in (("joint", "_frozen"), ("joint", "_tar"), ("unstructured", "")))
    more = lambda a, b: F.coalesce(~F.isnan(a) & ~F.isnan(b) & (a > b), F.lit(False))
    joint = more(frozen, F.col("structured")) & more(frozen, alone)
    return report.select("learner", joint.alias("joint_signal"), more(tar, frozen).alias("tar_gain")).withColumn("passed", F.col("joint_signal") & F.col("tar_gain"))


def verdict(report: DataFrame, modality: str = "text", p: P.Params = P.DEFAULT) -> DataFrame:
    """AGG14: one row (modality, n_pass, eligible)."""
    passed = F.count_if("passed")
    return criteria(report, modality).agg(F.lit(modality).alias("modality"), passed.alias("n_pass"), (passed >= p.learners_needed).alias("eligible"))


def verdict_of_both(report: DataFrame, p: P.Params = P.DEFAULT) -> DataFrame:
    """AGG15: verdicts of both modalities and of the two together."""
    each = verdict(report, "text", p).unionByName(verdict(report, "image", p))
    return each.unionByName(each.agg(F.lit("both").alias("modality"), F.min("n_pass").alias("n_pass"), F.bool_and("eligible").alias("eligible")))
