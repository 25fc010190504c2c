"""Places as column expressions: geohashes, distances, line strings, pieces of roads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The geohash alphabet; metres of a degree of latitude, here on a sphere.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
METRES_A_DEGREE = 111_320.0
REFERENCE_LAT = 38.72


def geohash(lat: Column, lon: Column, precision: int) -> Column:
    """Geohash of a place: bits of longitude and latitude in turn, five a character."""
    n = 5 * precision
    lon_bits, lat_bits = (n + 1) // 2, n // 2
    x = F.least(F.floor((lon + 180) / 360 * (1 << lon_bits)), F.lit((1 << lon_bits) - 1))
    y = F.least(F.floor((lat + 90) / 180 * (1 << lat_bits)), F.lit((1 << lat_bits) - 1))
    chars = []
    for c in range(precision):
        code = F.lit(0)
        for i in range(5 * c, 5 * c + 5):
            of, left = (x, lon_bits - 1 - i // 2) if i % 2 == 0 else (y, lat_bits - 1 - i // 2)
            code = code * 2 + F.shiftright(of, left).bitwiseAND(F.lit(1))
        chars.append(F.substring(F.lit(ALPHABET), code.cast("int") + 1, F.lit(1)))
    return F.concat(*chars)


def geohash_bounds(hash_: str) -> tuple[float, float, float, float]:
    """south, north, west, east of a literal geohash; for configuration."""
    sides = [[-180.0, 180.0], [-90.0, 90.0]]
    even = 0
    for ch in hash_:
        code = ALPHABET.index(ch)
        for bit in (16, 8, 4, 2, 1):
            side = sides[even]
            middle = sum(side) / 2
            side[0 if code & bit else 1] = middle
            even ^= 1
    return *sides[1], *sides[0]


def parent(hash_: Column, precision: int = 5) -> Column:
    return F.substring(hash_, 1, precision)


def line_points(wkt: Column) -> Column:
    """Points (lon, lat) of a two-dimensional LINESTRING; null for anything else, for places out of range and for fewer than two points."""
    body = F.regexp_extract(F.upper(F.trim(wkt)), r"^LINESTRING\s*\(([^()]*)\)$", 1)
    pairs = F.transform(F.split(body, ","), lambda p: F.split(F.trim(p), r"\s+"))
    points = F.transform(pairs, lambda p: F.struct(F.try_element_at(p, F.lit(1)).try_cast("double").alias("lon"), F.try_element_at(p, F.lit(2)).try_cast("double").alias("lat")))
    good = F.forall(pairs, lambda p: F.size(p) == 2) & F.forall(points, lambda p: F.coalesce(p["lon"].between(-180, 180) & p["lat"].between(-90, 90), F.lit(False)))
    return F.when(good & (F.size(points) >= 2), points)


def metres(lat: Column, lon: Column, reference: float = REFERENCE_LAT) -> tuple[Column, Column]:
    """x and y in metres on a plane around a reference latitude."""
    return lon * (METRES_A_DEGREE * F.cos(F.radians(F.lit(reference)))), lat * METRES_A_DEGREE


def segments(lines: DataFrame, points: str, keys: list[str]) -> DataFrame:
    """keys, seg, x1, y1, x2, y2: consecutive points of each line in metres."""
    p = lines.select(*keys, F.posexplode(F.arrays_zip(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1))).alias("seg", "z"))
    (x1, y1), (x2, y2) = (metres(F.col(f"z.{i}.lat"), F.col(f"z.{i}.lon")) for i in ("0", "1"))
    return p.select(*keys, "seg", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def pieces(seg: DataFrame, keys: list[str], most: float = 25.0) -> DataFrame:
    """Segments cut into equal pieces of at most `most` metres: piece, x1, y1, x2, y2, metres."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    n = F.greatest(F.lit(1), F.ceil(length / most)).cast("int")
    s = seg.withColumn("n", n).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at: Callable[[str, Column], Column] = lambda c, i: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * i / F.col("n")
    return s.select(*keys, "seg", "piece", at("x", F.col("piece")).alias("x1"), at("y", F.col("piece")).alias("y1"), at("x", F.col("piece") + 1).alias("x2"), at("y", F.col("piece") + 1).alias("y2"), (length / F.col("n")).alias("metres"))


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres from a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * dx + (py - y1) * dy) / square))).otherwise(0.0)
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))
