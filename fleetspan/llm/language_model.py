"""Language-model scoring: causal self-attention over subword ids, beside a word unigram base.

A position stands for a subword id, or the end of the text, each of which is learned from and predicted by attention over the ids before. A word is its first id, and the rest given that id: the
discounted share of the word's own count, and what discounting leaves goes to all words by their other ids, half by attention and half by the chain of ids. Windows overlap, and each id is scored once.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.llm.attention import PARTS, STRIDE, Attention, initial
from fleetspan.llm.common import discard, map_batches, map_rows, saved, strings, table
from fleetspan.llm.words import space_words

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The model's vocabulary are the first IDS ids of the file: byte-level BPE with its first merges only.
IDS = 4096
#: Rows whose crc32(doc_id as text) mod FOLDS is 0 are scored only.
FOLDS = 10
#: Words that every worker keeps with their counts, the most frequent; all others meet their counts in a shuffle. Scores don't depend on it.
MOST_WORDS = 1 << 18
#: Taken off each word's count, and the weight of single ids' shares in the chain.
DISCOUNT, SMOOTH = 0.75, 4.0
#: Share of attention, beside the chain, in the ids after a word's first and in the word's end.
ATTENDED = 0.5
#: Counts that a task keeps before it hands them on, and tokens that it reads at once.
COUNTS, TOKENS = 300_000, 60_000
#: Rounds of training, after each of which weights are averaged, and tokens of a chunk, which one task learns from in turn.
ROUNDS, CHUNK_TOKENS = 3, 1_000_000
#: Kinds of counts: words by first id, distinct words by first id, distinct words that have one id after another, and ids of all words.
TOTAL, TYPES, PAIR, EACH = 0, 1, 2, 3
ADD = 0.1
LOG10 = math.log(10)


class Subwords:
    """Byte-level BPE over the first IDS ids of a public vocabulary file. STOP follows a word's last id."""

    STOP = IDS

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        ranks = {b: i for b, i in ranks.items() if i < IDS}
        self.bpe = tiktoken.Encoding("first-merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.begins = np.zeros(IDS, bool)
        self.begins[[i for b, i in ranks.items() if b[:1] == b" "]] = True

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, each with a space before it, and the place of each word's first id."""
        ids = np.array(self.bpe.encode_ordinary(" " + b" ".join(words).decode("utf-8", "replace")) if words else [], np.int64)
        first = np.flatnonzero(self.begins[ids])
        if len(first) != len(words):  # white space of other kinds inside words; one by one
            each = [self.bpe.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
            ids, first = np.array([i for e in each for i in e], np.int64), np.cumsum([0, *map(len, each)])[:-1]
        return ids, first


_made: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    if path not in _made:
        _made[path] = Subwords(path)
    return _made[path]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all texts."""

    def batches(it: Iterator[tuple]) -> Iterator[list]:
        counts: Counter = Counter()
        for (text,) in it:
            counts.update(space_words(text))
            if len(counts) > COUNTS:
                yield [strings(list(counts)), pa.array(counts.values(), pa.int64())]
                counts.clear()
        yield [strings(list(counts)), pa.array(counts.values(), pa.int64())]

    return map_batches(docs.select("text"), "word string, n long", batches).groupBy("word").agg(F.sum("n").alias("n"))


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest n such that at most `most` rows of counts have n or more."""
    steps = F.when(F.col("n") < 1000, F.col("n")).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2("n"))).cast("long"))
    found = counts.groupBy(steps.alias("n")).count().orderBy(F.desc("n")).collect()  # some 1,050 rows
    least, rows = 1 << 62, 0
    for step, n in found:
        rows += n
        if rows > most:
            break
        least = step if step <= 1000 else step // 2 + 1
    return least


def id_counts(words: DataFrame, vocabulary: str) -> DataFrame:
    """kind, a, b, n over all words of training texts: TOTAL and TYPES of first id a; PAIR of id a and id b or STOP after it; EACH of id a, wherever it stands."""

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        sub, counts, total = subwords(vocabulary), Counter(), {kind: np.zeros(IDS, np.int64) for kind in (TOTAL, TYPES, EACH)}
        waiting: list[bytes] = []
        often: list[int] = []

        def read() -> None:
            ids, first = sub.encode(waiting)
            heads = ids[first]
            total[TOTAL] += np.bincount(heads, often, IDS).astype(np.int64)
            total[TYPES] += np.bincount(heads, minlength=IDS)
            total[EACH] += np.bincount(ids, np.repeat(often, np.diff(np.append(first, len(ids)))), IDS).astype(np.int64)
            after = np.append(ids[1:], sub.STOP)
            after[first[1:] - 1] = sub.STOP
            pairs, n = np.unique(ids * (IDS + 1) + after, return_counts=True)
            counts.update(dict(zip(pairs.tolist(), n.tolist(), strict=True)))
            waiting.clear()
            often.clear()

        def handed() -> Iterator[tuple]:
            yield from ((PAIR, p // (IDS + 1), p % (IDS + 1), n) for p, n in counts.items())
            counts.clear()

        for word, n in it:
            waiting.append(word)
            often.append(n)
            if len(waiting) == 20_000:
                read()
                if len(counts) > COUNTS:
                    yield from handed()
        if waiting:
            read()
        yield from handed()
        yield from ((kind, int(a), 0, int(n[a])) for kind, n in total.items() for a in np.flatnonzero(n))

    return map_rows(words.select("word", "n"), "kind int, a int, b int, n long", rows).groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


class Words:
    """Probabilities of words given their first subword id. All its tables have at most as many entries as IDS or its square."""

    def __init__(self, counts: DataFrame, texts: int):
        total, types, every = np.zeros(IDS), np.zeros(IDS), np.zeros(IDS)
        pairs = np.zeros((IDS, IDS + 1), np.float32)
        got = counts.toArrow()  # at most IDS * (IDS + 4) rows
        kind, a, b, n = (got[c].to_numpy() for c in ("kind", "a", "b", "n"))
        total[a[kind == TOTAL]] = n[kind == TOTAL]
        types[a[kind == TYPES]] = n[kind == TYPES]
        every[a[kind == EACH]] = n[kind == EACH]
        pairs[a[kind == PAIR], b[kind == PAIR]] = n[kind == PAIR]
        one = pairs.sum(0) + np.float32(0.01)
        one /= one.sum()
        each = pairs.sum(1, keepdims=True) + np.float32(SMOOTH)
        pairs += np.float32(SMOOTH) * one
        pairs /= each
        self.chain = np.log10(pairs, out=pairs).astype(np.float16)
        self.total = np.maximum(total, 1.0)
        self.left = np.log10(np.where(total > 0, DISCOUNT * types / self.total, 1.0))  # log10 of what discounting leaves
        # symbols of the model: first ids of training words and one for all others, ids that stand after them and one for all others, the border
        first, after = np.flatnonzero(total), np.flatnonzero((every > 0) & (total == 0))
        self.symbol = np.full(IDS, -1, np.int32)
        self.symbol[first] = np.arange(len(first))
        self.symbol[after] = len(first) + 1 + np.arange(len(after))
        self.other = len(first), len(first) + 1 + len(after)
        self.begins = np.arange(self.other[1] + 2) <= self.other[0]  # what may follow a whole word: these, and the border
        self.begins[-1] = True
        self.left[total == 0] = -math.log10(max(IDS - len(first), 1))
        self.unseen = 1 / max(IDS - len(first) - len(after), 1)  # share of each id that stands after first ids nowhere in training
        share = np.concatenate([total[first], [0.5], every[after], [0.5, texts + 0.5]])
        self.share = share / share.sum()

    def spelled(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 of what discounting leaves at each word's first id, times the probability of its other ids."""
        if not len(first):
            return np.zeros(0)
        after = np.append(ids[1:], IDS)
        after[first[1:] - 1] = IDS
        return self.left[ids[first]] + np.add.reduceat(self.chain[ids, after].astype(np.float64), first)


class Reader:
    """Reads texts as ids and symbols; words of the common table are found in it, all others spelled."""

    def __init__(self, words: Words, common: tuple, vocabulary: str):
        names, counts = common
        self.words, self.sub = words, subwords(vocabulary)
        self.place = {w: i for i, w in enumerate(names)}
        self.symbol = np.where(words.symbol >= 0, words.symbol, np.where(self.sub.begins, *words.other)).astype(np.int32)  # by id
        parts, firsts, size = [np.zeros(0, np.int64)], [], 0
        for at in range(0, len(names), 20_000):
            ids, first = self.sub.encode(names[at : at + 20_000])
            parts.append(ids)
            firsts.append(first + size)
            size += len(ids)
        self.ids, self.first = np.concatenate(parts), np.concatenate([*firsts, [size]])  # of the common words, end to end
        self.own = np.maximum(counts - DISCOUNT, 0) / words.total[self.ids[self.first[:-1]]]

    def read(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the tokens, the place of each token's first id and, last, their number; the tokens' places in the common table or -1, and where those without are."""
        at = np.fromiter(map(self.place.get, tokens, repeat(-1)), np.int64, len(tokens))
        rare = np.flatnonzero(at < 0)
        ids, begin = self.sub.encode([tokens[i] for i in rare.tolist()])
        start, length = self.first[at], self.first[at + 1] - self.first[at]  # of no meaning where rare
        start[rare], length[rare] = begin + len(self.ids), np.diff(np.append(begin, len(ids)))
        first = np.append(0, np.cumsum(length))
        places = np.repeat(start - first[:-1], length) + np.arange(first[-1])
        return np.concatenate([self.ids, ids])[places], first, at, rare

    def windows(self, model: Attention, ids: np.ndarray, first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The model's windows of texts whose tokens end at ends."""
        return model.windows(np.split(self.symbol[ids], first[ends[:-1]]))


_readers: dict[int, Reader] = {}


def reader_of(held, vocabulary: str) -> Reader:
    """The reader of a broadcast of (Words, common words), made once per Python worker."""
    if held.id not in _readers:
        _readers.clear()
        _readers[held.id] = Reader(*held.value, vocabulary)
    return _readers[held.id]


class Broadcast:
    """A broadcast, and an id that tells it from others inside a reused worker."""

    def __init__(self, spark: SparkSession, value):
        self.held, self.id = spark.sparkContext.broadcast(value), xxhash.xxh3_64_intdigest(repr(id(value)).encode() + np.random.default_rng().bytes(8))

    @property
    def value(self):
        return self.held.value


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in PARTS]).astype(np.float64)


def shaped(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in PARTS:
        n = like[k].size
        out[k] = values[at : at + n].reshape(like[k].shape).astype(np.float32)
        at += n
    return out


def grouped(it: Iterator[tuple]) -> Iterator[tuple[list[tuple], list[bytes], np.ndarray]]:
    """Rows (all but the text), the tokens of their texts end to end, and where each text ends; some TOKENS tokens at once."""
    rows, tokens, ends = [], [], []
    for *row, text in it:
        tokens += space_words(text)
        rows.append((*row, xxhash.xxh3_64_intdigest(text or b"") >> 1))
        ends.append(len(tokens))
        if len(tokens) + len(ends) > TOKENS:
            yield rows, tokens, np.array(ends)
            rows, tokens, ends = [], [], []
    if rows:
        yield rows, tokens, np.array(ends)


def local_steps(it: Iterator[tuple[int, bytes | None]], params: dict[str, np.ndarray], reader: Reader) -> Iterator[tuple]:
    """i, v, w: of each chunk, whose rows come one after the other, the weights after steps over all windows of all ids of all texts, times the tokens, ends included, that they learned from; added up."""
    total, seen = np.zeros(len(flat(params))), 0
    for _, rows in groupby(it, key=lambda r: r[0]):
        model, mine = Attention(dict(params)), 0
        for _, tokens, ends in grouped((text,) for _, text in rows):
            ids, first, *_ = reader.read(tokens)
            model.train(*reader.windows(model, ids, first, ends))
            mine += len(tokens) + len(ends)
        total += flat(model.params) * mine
        seen += mine
    if seen:
        yield from ((i, v, seen) for i, v in enumerate(total.tolist()))


def train(docs: DataFrame, held: Broadcast, share: np.ndarray, tokens: int, vocabulary: str) -> dict[str, np.ndarray]:
    """ROUNDS rounds, each over its share of the texts, dealt by hash to chunks of some CHUNK_TOKENS tokens. Every chunk takes steps over all windows of its texts from the round's start; their weights, averaged
    by tokens, are the next round's. Rounds, chunks and the order in them hang on doc_id, text and the number of tokens alone, so the model doesn't depend on how the table is partitioned.
    """
    params = initial(share)
    n = max(1, round(tokens / (ROUNDS * CHUNK_TOKENS)))
    h = F.xxhash64("doc_id", "text")
    dealt = docs.select(F.pmod(h, F.lit(ROUNDS)).alias("round"), F.pmod(F.xxhash64(F.lit("chunk"), h), F.lit(n)).alias("chunk"), h.alias("h"), "doc_id", "text")
    for number in range(ROUNDS):
        mine = dealt.where(F.col("round") == number).repartition("chunk").sortWithinPartitions("chunk", "h", "doc_id", "text")

        def rows(it: Iterator[tuple], params=params) -> Iterator[tuple]:
            return local_steps(it, params, reader_of(held, vocabulary))

        mean = map_rows(mine.select("chunk", "text"), "i int, v double, w long", rows).groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v"))
        got = mean.orderBy("i").toArrow()["v"].to_numpy()  # as many rows as the model has weights
        params = shaped(got, params) if len(got) else params
    return params


def attended(reader: Reader, model: Attention, ids: np.ndarray, first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 of each word's first id given that a word or the end comes, of what discounting leaves at it times the other ids and the word's end, and of each text's end; texts' tokens end at ends."""
    words, stops = reader.words, first[ends]
    likely, border = model.log_probs(*reader.windows(model, ids, first, ends), words.begins)
    likely, border = likely.ravel().astype(np.float64), border.ravel().astype(np.float64)
    lengths = np.diff(stops, prepend=0)
    blocks = -(-(lengths + 1) // STRIDE)
    start = (np.cumsum(blocks) - blocks) * STRIDE  # of each text among the targets, which its windows hold end to end
    at = np.arange(len(ids)) + np.repeat(start - stops + lengths, lengths)
    begin, end = at[first[:-1]], start + lengths
    begun, ended = ((likely[i] - border[i]) / LOG10 for i in (begin, end))
    if not len(ids):
        return begun, np.zeros(0), ended
    last = np.zeros(len(ids), bool)
    last[first[1:] - 1] = True
    after = np.where(last, IDS, np.append(ids[1:], IDS))
    p = np.exp(np.where(last, border[at + 1], likely[at + 1]))
    p[~last & (reader.symbol[np.minimum(after, IDS - 1)] == words.other[1])] *= words.unseen
    steps = np.log10(ATTENDED * p + (1 - ATTENDED) * 10.0 ** words.chain[ids, after].astype(np.float64))
    return begun, words.left[ids[first[:-1]]] + np.add.reduceat(steps, first[:-1]), ended


def scored(docs: DataFrame, vocabulary: str = VOCABULARY, most_words: int = MOST_WORDS) -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty: its one token is the end. A null doc_id is scored, but never learned from and not held out. Rows that share a doc_id are scored each for itself. Without any
    training rows counts are zero and the model is at its start. Other columns are not read; an empty table gives no rows. score is a
    log10 probability of the words and the end: white space beyond what parts words isn't modelled, as in the base.
    """
    text = docs.select("doc_id", "text")
    known = text.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = saved(word_counts(known), "lm-words")
    texts = known.count()
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = n + texts, v + (texts > 0)
    words = Words(id_counts(counts, vocabulary), texts)
    least = least_count(counts, most_words)
    found = counts.where(F.col("n") >= least).toArrow()  # most_words rows at most
    common = [w.encode() for w in found["word"].to_pylist()], found["n"].to_numpy().astype(np.float64)
    held = Broadcast(docs.sparkSession, (words, common))
    params = train(known, held, words.share, n, vocabulary)
    base = lambda c: np.log10((c + ADD) / (n + ADD * (v + 1)))
    end, end_known, size = float(base(texts)), int(texts > 0), ADD * (v + 1) + n

    def batches(it: Iterator[tuple]) -> Iterator[list]:
        reader, model = reader_of(held, vocabulary), Attention(dict(params))
        common_base = base(held.value[1][1])
        for docs_, tokens, ends in grouped(it):
            ids, first, at, rare = reader.read(tokens)
            begun, spelled, ended = attended(reader, model, ids, first, ends)
            lengths = np.diff(ends, prepend=0)
            doc = np.repeat(np.arange(len(docs_)), lengths)
            here = at >= 0
            by_doc = lambda x: np.bincount(doc[here], x, len(docs_))
            score = ended + np.bincount(doc, begun, len(docs_)) + by_doc(np.log10(reader.own[at[here]] + 10.0 ** spelled[here]))
            base_score, n_known = by_doc(common_base[at[here]]) + end, by_doc(np.ones(here.sum())).astype(np.int64) + end_known
            ids_, hashes = (pa.array(c, pa.int64()) for c in zip(*docs_, strict=True))
            none = lambda m, kind: pa.nulls(m, kind)
            same = lambda m, value: pa.array(np.full(m, value))
            m = len(docs_)
            yield [ids_, hashes, none(m, pa.string()), same(m, 0), *map(pa.array, (lengths + 1, score, base_score, n_known)), same(m, 0.0), same(m, 0.0)]
            # a row for each rare word, wherever it stands
            d, m = pa.array(doc[rare]), len(rare)
            total = reader.words.total[ids[first[rare]]]
            yield [ids_.take(d), hashes.take(d), strings([tokens[i] for i in rare.tolist()]), same(m, 1), same(m, 0), same(m, 0.0), same(m, 0.0), same(m, 0), pa.array(spelled[rare]), pa.array(total)]

    parts = saved(map_batches(text, "doc_id long, h long, word string, k long, n_tokens long, score double, base double, known long, spelled double, total double", batches), "lm-parts")
    rare = counts.where(F.col("n") < least).select(F.col("word").alias("w"), F.col("n").alias("c"))
    met = parts.where("word is not null").join(rare, F.col("word") == F.col("w"), "left")
    own = F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) / F.col("total")
    inside = F.when(F.col("c").isNull(), F.col("spelled")).otherwise(F.log10(own + F.pow(F.lit(10.0), F.col("spelled"))))
    value = F.log10((F.coalesce("c", F.lit(0)) + ADD) / F.lit(size))
    met = met.select("doc_id", "h", F.lit(0).cast("long").alias("n_tokens"), (inside * F.col("k")).alias("score"), (value * F.col("k")).alias("base"), F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0).alias("known"), F.lit(0).alias("copies"))
    whole = parts.where("word is null").select("doc_id", "h", "n_tokens", "score", "base", "known", F.lit(1).alias("copies"))
    sums = met.unionByName(whole).groupBy("doc_id", "h").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "score", "base", "known", "copies")])
    each = lambda c: F.col(c) / F.col("copies")
    out = sums.select("doc_id", each("n_tokens").cast("long").alias("n_tokens"), each("known").cast("long").alias("n_known"), each("base").alias("base_score"), each("score").alias("score"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
