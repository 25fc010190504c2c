"""Benchmark decontamination: one Aho-Corasick automaton over normalised test texts scans each document once.

Test texts beyond AUTOMATON_BYTES are dealt to several automata of bounded size; each document is scanned once by each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.llm.common import fresh, keep_rows, map_rows, saved, split_by, table
from fleetspan.llm.words import ODD, alnum_words, mixed

#: Words of a window; an item with fewer words is one window.
WINDOW = 13
#: A document is contaminated if at least one word in ONE_IN is hit.
ONE_IN = 20
#: Marks a block among the automaton's values, whose lower bits are the length of a text shorter than a window.
BLOCK = 1 << 20
#: Classes of words; a block of words of the right classes that are other words is told by comparing its windows.
CLASSES = 255
#: Bytes of test texts that one automaton is built of; 8 MB take some 300 MB of a worker (measured).
AUTOMATON_BYTES = 8_000_000

HITS = "doc_id long, text string, n_words long, n_hit long, n_items long, items_sha256 string, items array<long>, spans array<struct<start:long,end:long>>"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_built: dict[tuple, object] = {}


def pieces(words: list[bytes], size: int, most: int) -> Iterator[bytes]:
    """Texts that together have the windows of all words, of some `most` bytes each, or of one window if that is longer."""
    begin, length = 0, 0
    for i, w in enumerate(words):
        length += len(w) + 1
        if length > most and i + 1 - begin >= size and i + 1 < len(words):
            yield b" ".join(words[begin : i + 1])
            begin = i + 2 - size
            length = sum(len(x) + 1 for x in words[begin : i + 1])
    if words:
        yield b" ".join(words[begin:])


class Tests:
    """Test texts as word numbers: an automaton over blocks of words, and all windows by hash.

    Every (size + 1) / 2 words of a test text begin a block of as many words, so each window holds a whole block: the automaton has a node a word of test text and not one for each sign of each
    window. Its signs are classes of words, so that its nodes have few children. Where it finds a block, the windows that may lie around it are looked up, and compared word by word with a place that holds them. Texts shorter than a window are patterns of their own.
    """

    def __init__(self, items: list[tuple[int, bytes]], size: int):
        import ahocorasick

        self.size, self.block = size, (size + 1) // 2
        self.numbers: dict[bytes, int] = {}
        texts = [(item, words) for item, text in items if (words := alnum_words(text))]
        coded = [np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.int64) for _, words in texts]
        self.words = np.concatenate(coded) if coded else np.zeros(0, np.int64)
        patterns: dict[str, int] = {}
        hashes, places, owners, at = [], [], [], 0
        for (item, _), c in zip(texts, coded, strict=True):
            n = len(c)
            if n < size:
                patterns[key] = patterns.get(key := self.signs(c), 0) | n
            for begin in range(0, n - self.block + 1 if n >= size else 0, self.block):
                patterns[key] = patterns.get(key := self.signs(c[begin : begin + self.block]), 0) | BLOCK
            length = min(n, size)
            starts = np.arange(n - length + 1)
            hashes.append(self.hashes(c, starts, length))
            places.append(starts + at)
            owners.append(np.full(len(starts), item))
            at += n
        h, place, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, places, owners))
        order = np.argsort(h, kind="stable")
        self.sorted, self.places, self.owners = h[order], place[order], owner[order]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for key, value in patterns.items():
            self.automaton.add_word(key, value)
        if patterns:
            self.automaton.make_automaton()

    @staticmethod
    def signs(numbers: np.ndarray) -> str:
        """A sign for each word: its class, or zero for a word that no test has."""
        return np.where(numbers > 0, numbers % CLASSES + 1, 0).astype(np.uint8).tobytes().decode("latin-1")

    @staticmethod
    def hashes(numbers: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        out = np.full(len(starts), length, np.uint64)
        for j in range(length):
            out = mixed(out * ODD + numbers[starts + j].astype(np.uint64))
        return out

    def matches(self, numbers: np.ndarray, starts: np.ndarray, length: int, items: set[int]) -> list[int]:
        """Those of the starts at which a window of this length stands; its items are added."""
        h, found = self.hashes(numbers, starts, length), []
        low, high = np.searchsorted(self.sorted, h), np.searchsorted(self.sorted, h, "right")
        span = np.arange(length)
        for s, a, b in zip(starts.tolist(), low.tolist(), high.tolist(), strict=True):
            here = [k for k in range(a, b) if self.places[k] + length <= len(self.words) and (self.words[self.places[k] + span] == numbers[s + span]).all()]
            if here:
                found.append(s)
                items.update(self.owners[here].tolist())
        return found

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, merged runs [first, end) of words inside windows, and ids of the items found."""
        words = alnum_words(text)
        if not words or not len(self.automaton):
            return len(words), [], set()
        numbers = np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words))
        hits = list(self.automaton.iter(self.signs(numbers)))
        if not hits:
            return len(words), [], set()
        items, runs, size = set(), [], self.size
        ends = np.array([e for e, value in hits if value & BLOCK])
        if len(ends):
            starts = np.unique(ends[:, None] - np.arange(self.block - 1, size))
            starts = starts[(starts >= 0) & (starts + size <= len(words))]
            runs += [(s, s + size) for s in self.matches(numbers, starts, size, items)]
        for length in {value & BLOCK - 1 for _, value in hits} - {0}:
            starts = np.array([e - length + 1 for e, value in hits if value & BLOCK - 1 == length])
            runs += [(s, s + length) for s in self.matches(numbers, starts, length, items)]
        return len(words), merged(runs), items


def automaton(items: list[tuple[int, bytes]], size: int) -> Tests:
    """The tests' automaton; one is kept per Python worker."""
    key = (size, hashlib.sha256(repr(items).encode()).digest())
    if key not in _built:
        _built.clear()
        _built[key] = Tests(items, size)
    return _built[key]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as code point ranges of the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """One row per document row: doc_id, text, n_words, n_hit, n_items, items_sha256, items, spans and contaminated.

    spans are code point ranges of the original text. A null or empty text has no words, no hits and isn't contaminated; a null
    test text has no windows and a null item_id is skipped; repeated item rows count once; a null doc_id stays null; no test
    items: no hits. Other columns are not read.
    """
    parts = test_parts(benchmark, size, most_bytes)
    text = docs.select("doc_id", "text")
    if len(parts) > 1:
        return by_parts(text, parts, size)
    held = collected(parts[0])

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        made = automaton(held.value, size)
        for doc, raw in it:
            n, runs, found = made.scan(raw)
            yield doc, *told(raw, n, runs, found)

    return map_rows(text, HITS, rows).withColumn("contaminated", verdict())


def told(raw: bytes | None, n: int, runs: list[tuple[int, int]], items) -> tuple:
    """HITS without doc_id."""
    string = None if raw is None else raw.decode("utf-8", "replace")
    spans = [{"start": a, "end": b} for a, b in offsets(string, runs)] if runs else []
    return string, n, sum(b - a for a, b in runs), len(items), digest(items), sorted(items), spans


def test_parts(benchmark: DataFrame, size: int, most_bytes: int) -> list[DataFrame]:
    """item, piece: test texts as pieces of normalised words; dealt by hash to parts of some most_bytes / 2, one part if all are no more than most_bytes."""

    def cut(it: Iterator[tuple]) -> Iterator[tuple]:
        for item, text in it:
            for p in pieces(alnum_words(text), size, max(1, most_bytes // 16)):
                yield item, p.decode("utf-8", "replace")

    items = map_rows(benchmark.select("item_id", "text").where("item_id is not null and text is not null"), "item long, piece string", cut).distinct()
    items = saved(items, "test-pieces")
    total = items.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()[0]
    n = 1 if total <= most_bytes else -(-2 * total // most_bytes)
    return [items.where(F.pmod(F.xxhash64("item", "piece"), F.lit(n)) == i) for i in range(n)]


def collected(part: DataFrame):
    """A broadcast of one part's pieces, whose size test_parts() bounds."""
    return part.sparkSession.sparkContext.broadcast([(r[0], r[1].encode()) for r in part.orderBy("item", "piece").collect()])


def hits_of(text: DataFrame, parts: list[DataFrame], size: int) -> DataFrame:
    """h1, h2, runs, items of the document rows with hits, whose doc_id and text these two hashes stand for; rows that are alike make one."""
    key = [F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64(F.lit("text"), "text").alias("h2")]
    found = []
    for number, part in enumerate(parts):
        held = collected(part)

        def rows(it: Iterator[tuple], held=held, number=number) -> Iterator[tuple]:
            made = automaton(held.value, size)
            for h1, h2, raw in it:
                _, runs, items = made.scan(raw)
                if runs:
                    yield h1, h2, number, [{"a": a, "b": b} for a, b in runs], sorted(items)

        one = map_rows(text.select(*key, "text"), "h1 long, h2 long, part int, runs array<struct<a:long,b:long>>, items array<long>", rows)
        found.append(saved(one.dropDuplicates(["h1", "h2", "part"]), "test-hits"))
        held.unpersist()
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("h1", "h2").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def by_parts(text: DataFrame, parts: list[DataFrame], size: int) -> DataFrame:
    """contamination() by several automata. Only rows that have hits are moved."""
    hits = saved(hits_of(text, parts, size), "test-hits")
    keyed = text.withColumns({"h1": F.xxhash64("doc_id", "text"), "h2": F.xxhash64(F.lit("text"), "text")})
    may, never = split_by(keyed, "h1", hits.select("h1"))
    joined = may.join(hits, ["h1", "h2"], "left").select("doc_id", "text", "runs", "items")
    joined = joined.unionByName(never.select("doc_id", "text"), allowMissingColumns=True)

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        for doc, raw, runs, items in it:
            yield doc, *told(raw, len(alnum_words(raw)), merged([(r["a"], r["b"]) for r in runs or ()]), items or ())

    return map_rows(joined, HITS, rows).withColumn("contaminated", verdict())


def uncontaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Rows that aren't contaminated, with all their columns as they are; rows with null or empty texts stay, and no test items leave all."""
    parts = test_parts(benchmark, size, most_bytes)
    if len(parts) > 1:
        bad = by_parts(docs.select("doc_id", "text"), parts, size).where("contaminated")
        h1, h2 = fresh("h1", docs.columns), fresh("h2", docs.columns)
        bad = saved(bad.select(F.xxhash64("doc_id", "text").alias(h1), F.xxhash64(F.lit("text"), "text").alias(h2)).distinct(), "test-bad")
        keyed = docs.withColumns({h1: F.xxhash64("doc_id", "text"), h2: F.xxhash64(F.lit("text"), "text")})
        may, never = split_by(keyed, h1, bad.select(h1))
        return may.join(bad, [h1, h2], "left_anti").unionByName(never).drop(h1, h2).select(*[F.col(f"`{c}`") for c in docs.columns])
    held = collected(parts[0])

    def keep(texts):
        made = automaton(held.value, size)
        for text in texts:
            n, runs, _ = made.scan(text)
            hit = sum(b - a for a, b in runs)
            yield not (hit and hit * ONE_IN >= n)

    return keep_rows(docs, keep)


def verdict():
    return (F.col("n_hit") > 0) & (F.col("n_hit") * ONE_IN >= F.col("n_words"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
