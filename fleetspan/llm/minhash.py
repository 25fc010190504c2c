"""Near duplicates: circulant MinHash, banding, exact Jaccard of full shingle sets, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.llm.common import discard, even, hot_join, map_rows, saved, split_by, table
from fleetspan.llm.words import WordHash, mixed, shingles, signed, space_words

#: Words of a shingle and least similarity in percent, unless a caller asks otherwise.
WORDS, PERCENT = 5, 80
#: Bands and coordinates of each. A pair at similarity 0.8 shares no band once in 190,000; one at 0.85 once in 320 million.
BANDS, ROWS = 40, 6
#: Slots that the first permutation deals shingles to.
SLOTS = 1 << 22
#: Words of 64 bits of a node's bitmap.
BITMAP = 32
#: Pairs with one centre that a task may get, and nodes of one bucket that a task compares with the others of that bucket.
CENTRE_PAIRS = APART_NODES = 2000
#: Orders by which buckets choose a second node to compare with.
ORDERS = 8
SEED = 20_240_229

SIGNED = "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>"


@lru_cache(1)
def circle(slots: int = SLOTS, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """The second permutation, of the slots, as windows: row s is what slot s has under each of the shifts 0, 1, 2, ..."""
    p = np.random.default_rng(SEED).permutation(slots).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([p, p[: coordinates - 1]]), coordinates)


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """All coordinates: the smallest value of any shingle under each shift. The first permutation is that of the 64-bit hashes by mixed()."""
    slots = (mixed(shingle_set + np.uint64(SEED)) & np.uint64(SLOTS - 1)).astype(np.int64)
    ring = circle()
    least = ring[slots[:2048]].min(axis=0)
    for i in range(2048, len(slots), 2048):
        np.minimum(least, ring[slots[i : i + 2048]].min(axis=0), out=least)
    return least


def band_hashes(sig: np.ndarray) -> list[int]:
    acc = np.arange(BANDS, dtype=np.uint64)
    for column in sig.reshape(BANDS, ROWS).T:
        acc = mixed(acc * np.uint64(31) + column.astype(np.uint64))
    return acc.view(np.int64).tolist()


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit hash, its bands' hashes."""

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        hashed = WordHash()
        for doc, text in it:
            s = shingles(hashed.of(space_words(text)), words)
            if not len(s):
                yield doc, 0, None, None, None
                continue
            h = xxhash.xxh3_128_intdigest(s.tobytes())
            yield doc, len(s), signed(h >> 64), signed(h & (1 << 64) - 1), band_hashes(signature(s))

    return map_rows(docs.select("doc_id", "text"), SIGNED, rows)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """id, n, set, bits: each document's sorted shingle hashes as bytes, their number, and a bitmap with a bit set for each."""

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        hashed = WordHash()
        for doc, text in it:
            s = shingles(hashed.of(space_words(text)), words)
            marks = np.zeros(64 * BITMAP, np.uint8)
            marks[(mixed(s) & np.uint64(64 * BITMAP - 1)).astype(np.intp)] = 1
            yield doc, len(s), s.tobytes(), np.packbits(marks, bitorder="little").view(np.int64).tolist()

    return map_rows(docs.select("doc_id", "text"), "id long, n long, `set` binary, bits array<long>", rows)


def bitmaps(sets: DataFrame) -> DataFrame:
    """id, n, marks, bits: each document's number of shingles, of bits, and its bitmap."""
    return sets.select("id", "n", F.aggregate("bits", F.lit(0), lambda acc, w: acc + F.bit_count(w)).alias("marks"), "bits")


def possible(percent: int) -> Column:
    """Whether rows that hold two bitmaps, the second one's columns after s_, may be linked. Exact: it rules out no link.

    Bits that one bitmap has and the other hasn't stand for as many shingles at least that are in one set only. With x and y of these, the intersection has at most
    min(size - x, size' - y) shingles and the union at least x + y more.
    """
    # of the bits, c are common to both: x = marks - c, y = s_marks - c; solved for c, so that the long sum stands in the condition once
    common = sum((F.bit_count(F.get("bits", F.lit(i)).bitwiseAND(F.get("s_bits", F.lit(i)))) for i in range(BITMAP)), F.lit(0))
    least = percent * (F.col("marks") + F.col("s_marks")) - (100 - percent) * F.least(F.col("n") - F.col("marks"), F.col("s_n") - F.col("s_marks"))
    return (100 * F.least("n", "s_n") >= percent * F.greatest("n", "s_n")) & ((100 + percent) * common >= least)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs that are linked by the exact sizes of the intersection and union of full sets.

    Bitmaps rule pairs out before any set is moved, and only sets of pairs that are left are. A centre a with more than CENTRE_PAIRS partners is dealt to
    several tasks by a salt; its set is copied once a salt, so copies follow the pairs.
    """
    pairs = saved(pairs.distinct(), "pairs")
    counts, total, most = partners(pairs)
    if not total:
        discard(counts)
        return pairs
    maps = bitmaps(sets)
    of_a = maps.withColumnRenamed("id", "a")
    with_a = pairs.join(of_a, "a") if even(total, most) else hot_join(pairs, counts.join(of_a, "a"), ["a"], "partners", total)
    with_b = with_a.join(maps.select(F.col("id").alias("b"), *[F.col(c).alias(f"s_{c}") for c in maps.columns if c != "id"]), "b")
    left = saved(with_b.where(possible(percent)).select("a", "b").distinct(), "pairs")
    discard(pairs, counts)
    counts, total, most = partners(left)
    if not total:
        discard(counts)
        return left
    moved = split_by(sets.select("id", "set"), "id", left.select(F.explode(F.array("a", "b")).alias("id")))[0]
    set_b = moved.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    if even(total, most) and most <= CENTRE_PAIRS:  # nothing to deal out
        both = left.join(set_b, "b").join(moved.withColumnRenamed("id", "a"), "a").select("a", "b", "set", "set_b")
    else:
        salted = hot_join(left, counts, ["a"], "partners", total, most=most)
        parts = F.ceil(F.col("partners") / CENTRE_PAIRS).cast("int")
        sides = salted.select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("salt")).join(set_b, "b")
        centres = moved.join(counts.withColumnRenamed("a", "id"), "id").select(F.col("id").alias("a"), "set", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
        both = sides.join(centres, ["a", "salt"]).select("a", "b", "set", "set_b")

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        for a, b, set_a, set_b in it:
            x, y = np.frombuffer(set_a, np.uint64), np.frombuffer(set_b, np.uint64)
            inter = len(np.intersect1d(x, y, assume_unique=True))
            if inter * 100 >= (len(x) + len(y) - inter) * percent:
                yield a, b

    found = saved(map_rows(both, "a long, b long", rows).distinct(), "checked")
    discard(left, counts)
    return found


def partners(pairs: DataFrame) -> tuple[DataFrame, int, int]:
    """a, partners: how many pairs each centre has; all pairs, and the most of one centre."""
    counts = saved(pairs.groupBy("a").agg(F.count("*").alias("partners")), "partners")
    total, most = counts.agg(F.sum("partners"), F.max("partners")).first()
    return counts, total or 0, most or 0


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id reachable, for every id on an edge (a, b).

    Alternates large-star and small-star steps, each linear in the edges, until the edges are stars around each component's smallest id. A
    node of many edges is pre-aggregated, and its edges join the result where they are (hot_join). Edges are such stars just if no node has both a smaller neighbour
    and a second one, so no further step is needed to see it.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "lowest")
        total, most, between = low.agg(F.sum("n"), F.max("n"), F.count_if((F.col("m") < F.col("u")) & (F.col("n") > 1))).first()
        if not between:
            members = low.select(F.col("u").alias("id"), F.col("m").alias("component"))
            discard(now)
            return members
        large = hot_join(both, low, ["u"], "n", total, most=most).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = saved(large, "links")
        discard(now, low)
        low = saved(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "lowest")
        total, most = low.agg(F.sum("n"), F.max("n")).first()
        small = hot_join(large, low, ["u"], "n", total, most=most).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = saved(small, "links")
        discard(large, low)


def homes(met: DataFrame, joined: DataFrame, n_nodes: int) -> DataFrame:
    """band, id, size, comp, home, n_apart: each node of each bucket with its component so far, the bucket's commonest, and how many nodes there are of others; only buckets with several."""
    known = joined.withColumnRenamed("component", "comp")
    placed = saved(met.select("band", "id", "size").join(known, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "comps")
    counts = placed.groupBy("band", "comp").agg(F.count("*").alias("n"))
    home = counts.groupBy("band").agg(F.max_by("comp", F.struct("n", "comp")).alias("home"), F.sum("n").alias("n"), F.count("*").alias("comps"), (F.sum("n") - F.max("n")).alias("n_apart")).where("comps > 1")
    home = saved(home, "homes")
    most = home.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    found = saved(hot_join(placed, home, ["band"], "n", n_nodes * BANDS, most=most).select("band", "id", "size", "comp", "home", "n_apart"), "placed")
    discard(placed, home)
    return found


def apart(placed: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs that may be linked of a node outside of its bucket's commonest component and one of another component there. Exact: it leaves out no link.

    Pairs that possible() rules out go before any set is moved. A pair comes out of the first band
    only that both have. A bucket with many nodes outside is dealt to several tasks, each with its share of those and all others.
    """
    live = placed.select("id").distinct().join(nodes.select("id", "bands"), "id").join(bitmaps(sets), "id")
    columns = ["id", "n", "comp", "bands", "marks", "bits"]
    live = saved(placed.join(live, "id").select("band", "home", F.ceil(F.col("n_apart") / APART_NODES).cast("int").alias("parts"), *columns), "live-places")
    s = live.where("comp <> home").select("band", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("salt"), *[F.col(c).alias(f"s_{c}") for c in columns])
    spread = live.select("band", "home", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), *columns)
    once = (F.col("comp") == F.col("home")) | (F.col("s_id") < F.col("id"))
    first = F.element_at(F.array_intersect("bands", "s_bands"), 1) == F.col("band")
    both = spread.join(s, ["band", "salt"]).where((F.col("s_comp") != F.col("comp")) & once & possible(percent) & first)
    return both.select(F.col("s_id").alias("a"), F.col("id").alias("b"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest doc_id reachable and
    kept marks it. Null, empty and wordless texts have no shingles and no links. Rows with a null doc_id are never linked; their component_id is null and
    they are kept. Rows that share a doc_id each get a row; equal texts make them one document, different texts are judged each for itself. Other columns
    are not read; an empty table gives no rows.

    Equal sets are one node from the start. Nodes meet in the buckets of their bands. First every node of a bucket is compared with the
    bucket's smallest id. Nodes that this links need no more comparisons with each other. The rest, those outside of a bucket's commonest component, are compared with
    some nodes of that component, one a bucket; and what then is still apart from a node of its buckets is compared with it, unless exact bounds rule that out (apart()).
    """
    text = docs.select("doc_id", "text")
    signs = saved(signatures(text, words), "signatures")
    usable = signs.where("doc_id is not null and n_shingles > 0")
    nodes = saved(usable.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size")), "nodes")
    n_nodes = nodes.count()
    places = nodes.select("id", "size", F.explode("bands").alias("band"))
    buckets = saved(places.groupBy("band").agg(F.min("id").alias("centre"), F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = split_by(places, "band", buckets.select("band"))[0]  # most bands are of one node only; their places stay where they are
    most = buckets.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    met = saved(hot_join(shared, buckets, ["band"], "n", n_nodes * BANDS, most=most).select("band", "id", "size", "centre"), "bucket-places")
    discard(buckets)
    sets = saved(shingle_sets(split_by(text, "doc_id", met.select("id"))[0], words), "shingle-sets")

    links = verified(met.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")), sets, percent)
    joined = saved(components(links), "components")
    placed = homes(met, joined, n_nodes)

    order = F.struct(F.xxhash64("id", F.pmod("band", F.lit(ORDERS))), F.col("id"))
    others = placed.where("comp = home").groupBy("band").agg(F.min_by("id", order).alias("other"), F.first("n_apart").alias("n"))
    tries = hot_join(placed.where("comp <> home").select("band", "id"), others, ["band"], "n", n_nodes * BANDS)
    more = verified(tries.select(F.col("other").alias("a"), F.col("id").alias("b")), sets, percent)
    if more.head(1):
        links = links.unionByName(more)
        old, joined = (joined, placed), saved(components(links), "components")
        placed = homes(met, joined, n_nodes)
        discard(*old)
    discard(met)
    last = verified(apart(placed, sets, nodes, percent), sets, percent)
    discard(placed, sets)
    final = components(links.unionByName(last)) if last.head(1) else joined

    grouped = nodes.select("set_hi", "set_lo", "id").join(final, "id", "left").select("set_hi", "set_lo", F.coalesce("component", "id").alias("component"))
    sizes = usable.groupBy("set_hi", "set_lo").agg(F.count("*").alias("n"))
    grouped = grouped.join(sizes, ["set_hi", "set_lo"])
    own = hot_join(usable.select("doc_id", "n_shingles", "set_hi", "set_lo"), grouped, ["set_hi", "set_lo"], "n", signs.count())
    own = own.select("doc_id", "n_shingles", "component")
    alone = signs.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    out = own.unionByName(alone)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component"))).alias("kept"))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)
