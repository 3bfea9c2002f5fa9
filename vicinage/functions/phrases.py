"""Bands, labels and phrases as functions of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vicinage import params as P


def _first(pairs: list[tuple[Column | None, str | Column]]) -> Column:
    out = F.lit(None).cast("string")
    for condition, value in reversed(pairs):
        value = F.lit(value) if isinstance(value, str) else value
        out = value if condition is None else F.when(condition, value).otherwise(out)
    return out


def upto(v: Column, bands: tuple) -> Column:
    """The phrase of the first cutoff that v does not exceed; the last has none."""
    return _first([(None if cut is None else v <= cut, phrase) for cut, phrase in bands])


def proximity(metres: Column) -> Column:
    """PRJ7."""
    return upto(metres, P.PROXIMITY)


def landmark_band(metres: Column) -> Column:
    """PRJ8."""
    return upto(metres, P.LANDMARK_BANDS)


def share_band(share: Column) -> Column:
    """PRJ9: null below the least share."""
    return _first([(share >= cut, phrase) for cut, phrase in P.SHARES])


def label(bucket: Column) -> Column:
    """PRJ10."""
    return _first([*((bucket == b, text) for b, text in P.LABELS.items()), (None, F.replace(bucket, F.lit("_"), F.lit(" ")))])


def extremity(pct: Column) -> Column:
    return F.abs(pct - F.lit(0.5))


def banded(count: Column, pct: Column, present: Column, p: P.Params = P.DEFAULT) -> tuple[Column, Column]:
    """TXT1: (phrase, extremity) of a bucket against the corpus; a null phrase is not worth telling."""
    absent = F.when(present >= p.usually_present, P.ABSENT)
    told = _first([*((pct >= cut, text) for cut, text in P.AT_LEAST), *((pct <= cut, text) for cut, text in P.AT_MOST)])
    return F.when(count <= 0, absent).otherwise(told), F.when(count <= 0, F.lit(0.5)).otherwise(extremity(pct))


def exact(count: Column, pct: Column, present: Column, p: P.Params = P.DEFAULT) -> tuple[Column, Column]:
    """TXT2: (phrase, extremity) with the rank in percent."""
    rank = F.rint(pct * 100).cast("int")
    absent = F.when(present >= p.usually_present, f"{P.ABSENT} (most {p.city_short} blocks have some)")
    top = F.concat(F.lit("top "), (100 - rank).cast("string"), F.lit(f"% of {p.city_short} blocks"))
    bottom = F.concat(F.lit("bottom "), rank.cast("string"), F.lit(f"% of {p.city_short} blocks"))
    told = F.when(extremity(pct) < p.typical, F.lit(None).cast("string")).when(pct >= 0.5, top).otherwise(bottom)
    return F.when(count <= 0, absent).otherwise(told), extremity(pct)


def band(count: Column, pct: Column) -> Column:
    """The band of a count in a histogram of all listings."""
    return _first([(count <= 0, "none"), *((pct >= cut, text) for cut, text in P.BAND_AT_LEAST), *((pct <= cut, text) for cut, text in P.BAND_AT_MOST), (None, "typical")])


def proximity_band(metres: Column) -> Column:
    return upto(metres, P.PROXIMITY_BANDS)


def section(header: str, lines: Column, empty: str) -> Column:
    """TXT3: header and lines, or header and the empty-state line."""
    return F.concat(F.lit(header + "\n"), F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit(empty)))
