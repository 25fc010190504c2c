"""Validation, identity, dedup and rollups of raw pings, timetables and jam reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.functions import clock

#: The columns that a raw ping file has.
PING_COLUMNS = ["_id", "agency_id", "created_at", "driver_id", "latitude", "longitude", "operational_date", "received_at", "stop_id", "trip_id", "vehicle_id", "geohash_5"]
#: Milliseconds of the years 2000 to 2100; times outside are faults.
YEARS_MS = (946_684_800_000, 4_133_980_799_999)
SENTINEL = "UNAVAILABLE_STOP_ID"


def number(c: Column) -> Column:
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def reject_reason(raw: DataFrame) -> DataFrame:
    """Raw pings (all strings) with reject_reason, the first rule that fails, or null. A row with a fault of its file (a column `fault`, where there is one) or without a required field fails first."""
    lat, lon = number(F.col("latitude")), number(F.col("longitude"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    ids = blank("agency_id") | blank("vehicle_id") | blank("_id")
    place = F.coalesce(~(lat.between(-90, 90) & lon.between(-180, 180)), F.lit(True))
    ms = lambda c: F.trim(c).try_cast("long")
    wrong = lambda c: ~F.coalesce(ms(c).between(*YEARS_MS), F.lit(False))
    times = wrong("created_at") | wrong("received_at") | F.try_to_date(F.when(F.col("operational_date").rlike("^[0-9]{8}$"), F.col("operational_date")), "yyyyMMdd").isNull()
    hash5 = ~F.coalesce(F.trim("geohash_5").rlike("^[0-9bcdefghjkmnpqrstuvwxyz]{5}$"), F.lit(False))
    ragged = F.col("fault").isNotNull() if "fault" in raw.columns else F.lit(False)
    for c in PING_COLUMNS:
        ragged = ragged | F.col(c).isNull()
    reason = F.when(ragged, "column_count").when(ids, "identifier").when(place, "coordinates").when(times, "timestamp_or_date").when(hash5, "geohash")
    return raw.withColumn("reject_reason", reason)


def observation_key(p: DataFrame) -> Column:
    """SHA-256 of what makes an observation: agency, vehicle, time, place (-0 as 0), trip, stop."""
    zero = lambda c: (F.col(c) + F.lit(0.0)).cast("string")
    return F.sha2(F.to_json(F.array("agency_id", "vehicle_id", F.col("created_us").cast("string"), zero("lat"), zero("lon"), "trip_id", "stop_id")), 256)


IDENTITY = ["agency_id", "vehicle_id", "trip_id", "stop_id", "created_us"]


def dedup(p: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: received_us is the earliest; event and type are those of the smallest (receipt, event)."""
    g = p.groupBy(*keys).agg(F.min("received_us").alias("received_us"), F.min_by(F.struct("event_id", "event_type"), F.struct("received_us", "event_id")).alias("e"), F.count("*").alias("copies"))
    return g.select(*keys, "received_us", "e.event_id", "e.event_type", "copies")


def provenance(p: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Each key and source with its earliest receipt."""
    return p.groupBy(*keys, source).agg(F.min("received_us").alias("received_us"), F.count("*").alias("rows"))


#: What a raw ping can be rejected for, in the order of the rules.
REASONS = ["column_count", "identifier", "coordinates", "timestamp_or_date", "geohash"]


def counters(p: DataFrame, source: str, keys: list[str]) -> DataFrame:
    """Per source: rows read, valid ones, observations by keys that it gives, duplicates that collapse into those, rejects by reason (needs reject_reason)."""
    r = F.col("reject_reason")
    good = F.when(r.isNull(), F.struct(*keys))
    g = p.groupBy(source).agg(F.count("*").alias("rows_read"), F.count_if(r.isNull()).alias("valid_rows"), F.count_distinct(good).alias("inserted"), *[F.count_if(r == x).alias(x) for x in REASONS])
    return g.withColumn("duplicates", F.col("valid_rows") - F.col("inserted"))


def availability(p: DataFrame, cell: Column) -> DataFrame:
    """Pings per cell, local date and agency, with the first and last."""
    day = F.to_date(clock.local(F.col("created_us")))
    return p.groupBy(cell.alias("cell"), day.alias("date"), "agency_id").agg(F.count("*").alias("pings"), F.min("created_us").alias("first_us"), F.max("created_us").alias("last_us"))


def portable(p: DataFrame, agencies: list[str], lines: list[str] | None = None, cells: list[str] | None = None) -> DataFrame:
    """The agencies' pings for sharing, of some lines or cells where asked for: vehicles stay, drivers are redacted."""
    p = p.where(F.col("agency_id").isin(agencies))
    for name, some in (("line", lines), ("cell", cells)):
        p = p.where(F.col(name).isin(some)) if some is not None else p
    return p.withColumn("driver_id", F.lit("redacted"))


def parity(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows only in a, rows only in b (as multisets), and keys of both whose receipts differ."""
    only = lambda x, y: x.select(*keys).exceptAll(y.select(*keys)).agg(F.count("*").alias("n"))
    both = a.select(*keys, F.col("received_us").alias("ra")).join(b.select(*keys, F.col("received_us").alias("rb")), keys).where("ra <> rb").agg(F.count("*").alias("n"))
    return only(a, b).withColumnRenamed("n", "only_a").crossJoin(only(b, a).withColumnRenamed("n", "only_b")).crossJoin(both.withColumnRenamed("n", "receipts_differ"))  # one row each


def latest_plan(days: DataFrame, packages: DataFrame) -> DataFrame:
    """agency_id, day, package_id: of the plans valid on the day that of the largest id. Days come first, so pings meet it by equality."""
    d = days.select("agency_id", "day").distinct().join(packages, "agency_id").where(F.col("day").between(F.col("active_from"), F.col("active_until")))
    return d.groupBy("agency_id", "day").agg(F.max("id").alias("package_id"))


def all_plans(days: DataFrame, packages: DataFrame) -> DataFrame:
    """agency_id, day, package_id for every plan valid on the day."""
    d = days.select("agency_id", "day").distinct().join(packages, "agency_id").where(F.col("day").between(F.col("active_from"), F.col("active_until")))
    return d.select("agency_id", "day", F.col("id").alias("package_id"))


def overlapping_plans(packages: DataFrame) -> DataFrame:
    """Plans that begin while an earlier one of their agency is still valid."""
    w = Window.partitionBy("agency_id").orderBy("active_from", "id")
    before = F.max("active_until").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return packages.withColumn("valid_before", before).where(F.col("valid_before") >= F.col("active_from"))


def public_line(agency: Column, route_id: Column, short: Column, line: Column) -> Column:
    """The line that riders know: one operator's is a prefix of the route id, else the first of short name, line and route id that isn't blank."""
    prefixed = (agency == "HF16N") & route_id.rlike("^M[0-9][0-9]_")
    return F.when(prefixed, F.split(route_id, "_")[0]).otherwise(F.coalesce(F.nullif(F.trim(short), F.lit("")), F.nullif(F.trim(line), F.lit("")), route_id))


def cleaned(p: DataFrame, agencies: list[str], most_kmh: float = 120, most_gap_s: float | None = 120) -> DataFrame:
    """Pings of bus agencies with the sentinel stop as null, without those that a leap over most_kmh from the vehicle's ping before would need, and without those whose
    stop's time is uncertain by more than most_gap_s (None: all stay), the pause since that ping."""
    from fleetspan.operators.vehicles import haversine

    w = Window.partitionBy("day", "agency_id", "vehicle_id").orderBy("created_us", "event_id")
    p = p.where(F.col("agency_id").isin(agencies)).withColumn("stop_id", F.nullif("stop_id", F.lit(SENTINEL)))
    b = F.col("before")
    pause = (F.col("created_us") - b["created_us"]) / 1_000_000
    kmh = haversine(b["lat"], b["lon"], F.col("lat"), F.col("lon")) / F.nullif(pause, F.lit(0.0)) * 3.6
    p = p.withColumn("before", F.lag(F.struct("created_us", "lat", "lon")).over(w)).withColumns({"kmh_before": kmh, "pause_before_s": pause})
    sure = F.lit(True) if most_gap_s is None else F.coalesce(F.col("pause_before_s") <= most_gap_s, F.lit(True))
    return p.where(F.coalesce(F.col("kmh_before") <= most_kmh, F.lit(True)) & sure).drop("before")


def in_areas(cell: Column, areas: list[str]) -> Column:
    """Whether a geohash lies in one of the areas, whose names may be of several lengths up to the geohash's own."""
    found = F.lit(False)
    for a in areas:
        found = found | cell.startswith(a)
    return found
