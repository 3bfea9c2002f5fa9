"""Plane geometry and map projection as functions of columns."""

from __future__ import annotations

import math
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: WGS 84: equatorial radius in metres and flattening; UTM scale and false easting.
_A, _FLAT, _K0, _EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """PRJ5: easting and northing on the northern half of a UTM zone, by Krüger's series to the fourth order."""
    n = _FLAT / (2 - _FLAT)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    e = 2 * math.sqrt(n) / (1 + n)
    phi, away = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _EAST + _K0 * radius * east, _K0 * radius * north


def cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("long")


def morton(lon: Column, lat: Column, bits: int = 16) -> Column:
    """The place of a point in degrees on a space-filling (Z) curve over the whole globe: `bits` (16 at most) of each coordinate, interleaved."""

    def spread(v: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    step = lambda v, low, width: F.least(F.greatest(F.floor((v - low) / width * float(1 << bits)).cast("long"), F.lit(0).cast("long")), F.lit((1 << bits) - 1).cast("long"))
    return spread(step(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(spread(step(lat, -90.0, 180.0)), 1))


def morton_ranges(box: tuple[float, float, float, float], bits: int, most: int = 64) -> list[tuple[int, int]]:
    """Ranges of morton() codes that cover the box (lon0, lon1, lat0, lat1): quarters are split while they are only partly inside and there are fewer than `most`."""
    x0, x1, y0, y1 = (box[0] + 180) / 360, (box[1] + 180) / 360, (box[2] + 90) / 180, (box[3] + 90) / 180
    todo, found = [(0, 0, 0)], []
    while todo:
        x, y, level = todo.pop(0)
        side = 1 / (1 << level)
        # as codes are clamped, what lies beyond the globe's edge is in the cells at the edge
        low = lambda a: -1e9 if a == 0 else a * side
        high = lambda a: 1e9 if a + 1 == 1 << level else (a + 1) * side
        if low(x) > x1 or high(x) < x0 or low(y) > y1 or high(y) < y0:
            continue
        inside = low(x) >= x0 and high(x) <= x1 and low(y) >= y0 and high(y) <= y1
        if inside or level == bits or len(todo) + len(found) >= most:
            code = sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(level)) << 2 * (bits - level)
            found.append((code, code + (1 << 2 * (bits - level)) - 1))
        else:
            todo += [(2 * x + i, 2 * y + j, level + 1) for j in (0, 1) for i in (0, 1)]
    joined: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if joined and joined[-1][1] + 1 == a:
            a = joined.pop()[0]
        joined.append((a, b))
    return joined


def cells_around(x: Column, y: Column, size: float, reach: int = 1) -> Column:
    """The cells within `reach` of the point's own: with reach * size >= radius they hold all that lies within the radius."""
    steps = range(-reach, reach + 1)
    return F.array(*(F.struct((cell(x, size) + i).alias("cx"), (cell(y, size) + j).alias("cy")) for i in steps for j in steps))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """From a point to the nearest point of a segment; the segment may be a point."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    along = F.when(square == 0, 0.0).otherwise(((x - x1) * dx + (y - y1) * dy) / square)
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return distance(x, y, x1 + along * dx, y1 + along * dy)


def crosses(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a ray to the right of the point meets the segment; an odd number of them means inside."""
    return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)


def wkt_rings(wkt: Column) -> Column:
    """The point lists of a POINT, LINESTRING, POLYGON or MULTI* text, in order: array of arrays of (x, y)."""
    number = lambda s, k: F.try_element_at(F.split(F.trim(s), r"\s+"), F.lit(k)).try_cast("double")
    point = lambda s: F.struct(number(s, 1).alias("x"), number(s, 2).alias("y"))
    return F.transform(F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1)), lambda ring: F.transform(F.split(ring, ","), point))


def ring_segments(ring: Column) -> Column:
    """The segments of a point list; a lone point is a segment of no length."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))), lambda i: F.struct(
        F.get(ring, i - 1)["x"].alias("x1"), F.get(ring, i - 1)["y"].alias("y1"),
        F.coalesce(F.get(ring, i)["x"], F.get(ring, i - 1)["x"]).alias("x2"), F.coalesce(F.get(ring, i)["y"], F.get(ring, i - 1)["y"]).alias("y2"),
    ))
    return pairs


@F.pandas_udf(StringType())
def wkb_text(shapes: pd.Series) -> pd.Series:
    """WKT of WKB points, lines, areas and MULTI* of these, as far as two dimensions go; null for other bytes."""
    return shapes.map(lambda b: None if b is None else _wkt(bytes(b)), na_action="ignore")


def _wkt(b: bytes) -> str | None:
    kinds = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON"}

    def take(form: str, at: int) -> tuple[tuple, int]:
        return struct.unpack_from(form, b, at), at + struct.calcsize(form)

    def points(end: str, at: int, width: int) -> tuple[str, int]:
        (n,), at = take(f"{end}I", at)
        v, at = take(f"{end}{n * width}d", at)
        return "(" + ",".join(f"{v[k]!r} {v[k + 1]!r}" for k in range(0, len(v), width)) + ")", at

    def body(at: int) -> tuple[int, str, int]:
        (order,), at = take("B", at)
        end = "<" if order else ">"
        (code,), at = take(f"{end}I", at)
        if code >> 16:  # the extended form: flags for height, measure and a reference system's number, which follows
            kind, more, at = code & 0xFF, (code >> 31) + (code >> 30 & 1), at + 4 * (code >> 29 & 1)
        else:
            kind, more = code % 1000, (0, 1, 1, 2)[code // 1000 % 4]
        if kind == 1:
            v, at = take(f"{end}{2 + more}d", at)
            return kind, f"({v[0]!r} {v[1]!r})", at
        if kind == 2:
            text, at = points(end, at, 2 + more)
            return kind, text, at
        (n,), at = take(f"{end}I", at)
        parts = []
        for _ in range(n):
            if kind == 3:
                text, at = points(end, at, 2 + more)
            else:
                _, text, at = body(at)
            parts.append(text)
        return kind, "(" + ",".join(parts) + ")", at

    try:
        kind, text, _ = body(0)
        return f"{kinds[kind]} {text}"
    except (struct.error, KeyError):
        return None


def is_area(wkt: Column) -> Column:
    return F.upper(wkt).contains("POLYGON")
