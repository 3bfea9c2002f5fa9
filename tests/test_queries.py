"""Every registered query of the library against its SQL, and the plans of the heavy ones."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from vicinage import store
from vicinage.plans.oracles import ORACLES
from vicinage.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def as_text(rows, columns):
    return sorted(tuple("None" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in (r[c] for c in columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, engine, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = engine.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    assert sorted(names) == columns
    assert as_text([r.asDict() for r in df.collect()], columns) == as_text(want, columns)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_distance_join_is_an_equi_join(spark):
    text = plan(QUERIES["listing_density"](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and text.count("REPARTITION_BY_COL") == 1


def test_records_share_one_exchange_by_listing(spark):
    """Sums of density, lists of buckets and the join with landmarks follow one exchange by id; the landmarks' side has its own."""
    text = plan(QUERIES["density_record_text"](spark, DATA))
    density = [line for line in text.splitlines() if "Exchange hashpartitioning(id#" in line and "REPARTITION_BY_COL" in line]
    others = [line for line in text.splitlines() if "Exchange hashpartitioning(id#" in line and "REPARTITION_BY_COL" not in line and "x_m" not in line]
    assert len(density) == 1 and len(others) <= 3


def test_folders_of_queries_can_be_cleaned(spark):
    store.clean(spark)
    rows = QUERIES["vanilla_table"](spark, DATA)
    n = rows.count()
    assert n and store.clean(spark) == 1
    with pytest.raises(Exception, match="(?s)FILE_NOT_EXIST|FileNotFound|does not exist"):
        rows.count()


def test_corpus_windows_see_the_histogram_only(spark):
    """One task gets partial counts of the corpus, and nothing else."""
    lines = plan(QUERIES["corpus_histogram"](spark, DATA)).splitlines()
    below = [lines[k + 1] for k, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert all("HashAggregate(keys=[], functions=[partial_count(1)]" in line for line in below)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) == set(ORACLES)
