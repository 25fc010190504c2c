"""Timetable packages and their catalogue: lossless records, checks, normalised tables, stops, routes and geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.functions import clock

#: Columns that a package's table must have.
REQUIRED = {
    "agency": ["agency_id", "agency_name"], "feed_info": ["feed_start_date", "feed_end_date"], "routes": ["route_id"], "trips": ["trip_id", "route_id", "shape_id"],
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon"], "shapes": ["shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"],
    "stop_times": ["trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time"],
}
#: Columns of each table that identify its rows and must not be blank.
IDENTITY = {"routes": ["route_id"], "trips": ["trip_id", "route_id"], "stops": ["stop_id"], "shapes": ["shape_id"], "stop_times": ["trip_id", "stop_id"]}
#: Points of a shape beyond which every second one goes.
MOST_POINTS = 1200


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.try_element_at("data", F.lit(c))), F.lit("")) == ""


def field(c: str) -> Column:
    """A record's field, blank as null."""
    return F.nullif(F.trim(F.try_element_at("data", F.lit(c))), F.lit(""))


def record_fault(records: DataFrame) -> DataFrame:
    """Records (table_name, row_number, data, maybe ragged) with fault: what is wrong with a row, or null. A stop may lack both coordinates."""
    def place(lat: str, lon: str, optional: bool) -> Column:
        a, b = field(lat).try_cast("double"), field(lon).try_cast("double")
        good = a.between(-90, 90) & b.between(-180, 180) & ~F.isnan(a) & ~F.isnan(b)
        return ~F.coalesce(good, F.lit(False)) & ~((blank(lat) & blank(lon)) if optional else F.lit(False))

    whole = lambda c: ~F.coalesce(field(c).rlike(r"^[0-9]+$"), F.lit(False))
    is_ = lambda t: F.col("table_name") == t
    no_id = F.lit(False)
    for table, keys in IDENTITY.items():
        for key in keys:
            no_id = no_id | (is_(table) & blank(key))
    ragged = F.col("ragged") if "ragged" in records.columns else F.lit(False)
    fault = F.when(ragged, "column_count").when(no_id, "identifier").when(is_("stops") & place("stop_lat", "stop_lon", True) | is_("shapes") & place("shape_pt_lat", "shape_pt_lon", False), "coordinates")
    return records.withColumn("fault", fault.when(is_("stop_times") & whole("stop_sequence") | is_("shapes") & whole("shape_pt_sequence"), "sequence"))


def checked(records: DataFrame) -> DataFrame:
    """The records, if no row has a fault and every table that is there has its required columns; else ValueError with the first fault: a package comes in whole or not at all."""
    needs = [(t, c) for t, columns in REQUIRED.items() for c in columns]
    lacking = F.array(*[F.when(F.col("table_name") == t, F.when(~F.map_contains_key("data", c), F.lit(c))) for t, c in needs])
    judged = record_fault(records).withColumn("fault", F.coalesce(F.concat(F.lit("lacks "), F.get(F.array_compact(lacking), F.lit(0))), "fault"))
    bad = judged.where("fault is not null").select("package_id", "table_name", "row_number", "fault").orderBy("package_id", "table_name", "row_number").head(1)
    if bad:
        raise ValueError("{package_id}: {table_name}, row {row_number}: {fault}".format(**bad[0].asDict()))
    return records


def package_validity(feed: DataFrame, configured: DataFrame) -> DataFrame:
    """package_id, active_from, active_until: as configured, else the feed's own dates (YYYYMMDD)."""
    date = lambda c: F.try_to_date(field(c), "yyyyMMdd")
    own = feed.select("package_id", date("feed_start_date").alias("a"), date("feed_end_date").alias("b"))
    j = own.join(configured.select("package_id", F.col("active_from").alias("c"), F.col("active_until").alias("d")), "package_id", "left")
    return j.select("package_id", F.coalesce("c", "a").alias("active_from"), F.coalesce("d", "b").alias("active_until"))


def trips_of(records: DataFrame) -> DataFrame:
    """Normalised trips; missing shape, direction and service are empty."""
    empty = lambda c: F.coalesce(field(c), F.lit("")).alias(c)
    t = records.where("table_name = 'trips'")
    return t.select("package_id", field("trip_id").alias("trip_id"), field("route_id").alias("route_id"), empty("shape_id"), empty("direction_id"), empty("service_id")).dropDuplicates(["package_id", "trip_id"])


def visits_of(records: DataFrame) -> DataFrame:
    """Normalised stop visits: the sequence is a number, clocks stay text."""
    v = records.where("table_name = 'stop_times'")
    return v.select("package_id", field("trip_id").alias("trip_id"), field("stop_id").alias("stop_id"), field("stop_sequence").try_cast("int").alias("stop_sequence"), field("arrival_time").alias("arrival_time"), field("departure_time").alias("departure_time")).dropDuplicates(["package_id", "trip_id", "stop_id", "stop_sequence"])


def listing(records: DataFrame, table: str, key: str | None = None, value: str | None = None) -> DataFrame:
    """A package table's records in source order, of one key if asked for."""
    r = records.where(F.col("table_name") == table)
    return (r if key is None else r.where(field(key) == value)).orderBy("package_id", "row_number")


def stop_records(records: DataFrame) -> DataFrame:
    """package_id, stop_id and the data of the stop's first record."""
    s = records.where("table_name = 'stops'").withColumn("stop_id", field("stop_id"))
    return s.groupBy("package_id", "stop_id").agg(F.min_by("data", "row_number").alias("stop"))


def newest_stops(stops: DataFrame) -> DataFrame:
    """stop_id with name and place of the newest package that has it."""
    return stops.groupBy("stop_id").agg(F.max_by(F.struct("name", "lat", "lon"), "package_id").alias("s")).select("stop_id", "s.*")


def enriched(rows: DataFrame, stops: DataFrame) -> DataFrame:
    """Rows that name a stop, with its planned name and place; their own lat and lon where no plan has it."""
    s = newest_stops(stops).select("stop_id", F.col("name").alias("stop_name"), F.col("lat").alias("plan_lat"), F.col("lon").alias("plan_lon"))
    j = rows.join(s, "stop_id", "left")
    return j.withColumns({"lat": F.coalesce("plan_lat", "lat"), "lon": F.coalesce("plan_lon", "lon")}).drop("plan_lat", "plan_lon")


def previous_stops(visits: DataFrame) -> DataFrame:
    """trip_id, stop_id, seq, stop_before: the planned stop before, of lower sequence."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    return visits.select("trip_id", "stop_id", F.col("stop_sequence").alias("seq"), F.lag("stop_id").over(w).alias("stop_before"))


def sharing_lines(visits: DataFrame, line: str, direction: str, least: int = 3) -> DataFrame:
    """Other lines and directions with at least `least` planned stops of the chosen one."""
    s = visits.select("line", "direction_id", "stop_id").distinct()
    own = s.where((F.col("line") == line) & (F.col("direction_id") == direction)).select("stop_id")
    return s.where(F.col("line") != line).join(own, "stop_id", "left_semi").groupBy("line", "direction_id").agg(F.count("*").alias("stops")).where(F.col("stops") >= least)


def repaired(visits: DataFrame, seconds: Column, route: list[str]) -> DataFrame:
    """Visits with planned_s: flat trips' clocks moved by the typical offset of their route at the stop, else of their line and direction; null where there is neither.

    Only flat trips' visits meet the offsets; all others stay where they are.
    """
    from fleetspan.operators.passages import line_offsets, typical_offsets

    fine = typical_offsets(visits, seconds, route)
    coarse = line_offsets(fine, ["line", "direction_id"]).withColumnRenamed("offset_s", "line_offset_s")
    trip = Window.partitionBy("trip_id")
    v = visits.withColumn("s", seconds).withColumn("flat", F.min("s").over(trip) == F.max("s").over(trip))
    moved = v.where("flat").join(fine, [*route, "stop_id"], "left").join(coarse, ["line", "direction_id", "stop_id"], "left")
    moved = moved.select(*v.columns, (F.col("s") + F.coalesce("offset_s", "line_offset_s")).alias("planned_s"))
    return v.where("not coalesce(flat, false)").withColumn("planned_s", F.col("s").cast("double")).unionByName(moved)


def replanned(visits: DataFrame, route: list[str]) -> DataFrame:
    """Visits as stop_passages() takes them, flat trips repaired(): sched_us is the start plus the typical run time to the stop, null where none is known, so that such passages have no delay and aren't judged."""
    r = repaired(visits, clock.clock_seconds(F.col("clock")), route)
    return r.withColumn("sched_us", F.col("sched_us") + F.round((F.col("planned_s") - F.col("s")) * 1_000_000).cast("long")).drop("s", "flat", "planned_s")


def totals(pings: DataFrame, *levels: str) -> DataFrame:
    """Pings and vehicles of each group of the levels, and of all groups above."""
    return pings.rollup(*levels).agg(F.count("*").alias("pings"), F.countDistinct("vehicle_id").alias("vehicles"))


def directions(visits: DataFrame) -> DataFrame:
    """Per line its directions and stops, each once, in order."""
    return visits.groupBy("line").agg(F.array_join(F.array_sort(F.collect_set("direction_id")), ",").alias("directions"), F.array_join(F.array_sort(F.collect_set("stop_id")), ",").alias("stops"))


def geometry(visits: DataFrame, places: DataFrame, most: int = MOST_POINTS) -> DataFrame:
    """Per line and direction the stops of its longest trip as a line: points in order (every second one beyond `most`), and the box around them."""
    n = visits.groupBy("line", "direction_id", "trip_id").agg(F.count("*").alias("n"))
    longest = n.groupBy("line", "direction_id").agg(F.min_by("trip_id", F.struct((-F.col("n")).alias("n"), F.col("trip_id"))).alias("trip_id"))
    v = visits.join(longest, ["line", "direction_id", "trip_id"], "left_semi").join(places, "stop_id")
    g = v.groupBy("line", "direction_id").agg(F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id", "lat", "lon"))).alias("p"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    thin = F.when(F.size("p") > most, F.filter("p", lambda x, i: i % 2 == 0)).otherwise(F.col("p"))
    return g.withColumn("p", thin).select("line", "direction_id", F.transform("p", lambda x: x["stop_id"]).alias("stops"), F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("points"), "south", "north", "west", "east")


def route_catalogue(routes: DataFrame, presets: DataFrame, seen: DataFrame) -> DataFrame:
    """Lines of plans and of presets: which presets name them, whether a plan and whether vehicles have them, and a warning where one is missing. presets: preset, line; a bounded table."""
    named = presets.groupBy("line").agg(F.array_join(F.array_sort(F.collect_set("preset")), ",").alias("presets"))
    r = routes.select("line").distinct().withColumn("planned", F.lit(True)).join(named, "line", "full").join(seen.select("line").distinct().withColumn("seen", F.lit(True)), "line", "left")
    r = r.select("line", "presets", F.coalesce("planned", F.lit(False)).alias("planned"), F.coalesce("seen", F.lit(False)).alias("seen"))
    return r.withColumn("warning", F.when(~F.col("planned"), "no plan").when(~F.col("seen"), "no vehicles"))


def route_colour(colour: Column, default: str = "2563EB") -> Column:
    """A route's colour as #RRGGBB, the default where it has none."""
    c = F.coalesce(F.nullif(F.trim(colour), F.lit("")), F.lit(default))
    return F.when(c.startswith("#"), c).otherwise(F.concat(F.lit("#"), c))


def jam_key(observed: Column, fields: list[Column]) -> Column:
    """Identity of a jam report: sha-256 of its time and fields, trimmed, null as empty, joined by |."""
    return F.sha2(F.concat_ws("|", observed, *[F.trim(F.coalesce(f, F.lit(""))) for f in fields]).cast("binary"), 256)


def inserted(new: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of new whose key known lacks, each key once; and one row of how many were inserted and skipped."""
    fresh = new.dropDuplicates([key]).join(known.select(key), key, "left_anti")
    n = new.agg(F.count("*").alias("n"))
    return fresh, fresh.agg(F.count("*").alias("inserted")).crossJoin(F.broadcast(n)).select("inserted", (F.col("n") - F.col("inserted")).alias("skipped"))  # one row each


def commonest(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Per key the commonest value, the first in order of several, and how often it comes (name)."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = n.groupBy(*keys).agg(F.min_by(F.struct(value, "n"), F.struct((-F.col("n")).alias("k"), F.col(value))).alias("b"))
    return best.select(*keys, F.col(f"b.{value}").alias(value), F.col("b.n").alias(name))
