"""BPE over content-defined chunks: chunks that several texts share are encoded once, and their joins repaired."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.llm.common import FILTER_BITS, hot_join, map_rows, packed, saved, sliced, spark_schema, table, unpacked

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: A chunk ends where the hash of the WINDOW bytes before is below 2^32 / MEAN; it has from LEAST to MOST bytes, the last of a text maybe fewer.
WINDOW, MEAN, LEAST, MOST = 32, 1024, 256, 8192
#: Bytes of text that are hashed at once.
BLOCK = 1 << 20
#: Words of a generation; a worker keeps the ids of two.
WORDS_KEPT = 200_000
#: White space at which texts can be parted: no token reaches over it, whatever stands before and after.
SPACES = frozenset(b" \t\n\x0b\x0c\r")
#: Words of ASCII signs (but the apostrophe) and of letters that have one lower-case form and no other spelling, and what the pre-tokenizer parts those into once they are in lower case.
PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
ATOMS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: The sign that stands for each byte in the vocabulary: itself if it can be seen in Latin-1, else one from 256 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in _SEEN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SEEN)}
#: Rows of whole texts in an Arrow batch.
FEW = 64
BASE = 0x9E3779B1

_codecs: dict[str, Codec] = {}

PLACES = "text_key binary, doc_id long, place long"


class Codec:
    """A tokenizer file of the tokenizers library. Ids are kept as bytes of four a token, little-endian."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.atoms: dict[str, bytes] = {}
        self.merges = self.tokenizer.model
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]

    def encode(self, text: bytes) -> bytes:
        """Ids of a text: those of its words between white space, of which frequent ones are remembered."""
        words = text.split()
        out = list(map(self.words.get, words))
        if None in out:
            found = self.looked_up({w for w, ids in zip(words, out, strict=True) if ids is None})
            out = [found[w] if ids is None else ids for w, ids in zip(words, out, strict=True)]
        return b"".join(out)

    def looked_up(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words that aren't among those met of late: from those met before, or from the library. Words that don't come again are forgotten after two generations."""
        found = {w: ids for w in words if (ids := self.older.get(w)) is not None}
        fresh = [w for w in words if w not in found]
        odd, said = [], []
        for w in fresh:
            text = w.decode("utf-8", "replace")
            if PLAIN.fullmatch(text) and "<|" not in text:
                found[w] = b"".join(map(self.atom, ATOMS.findall(text.lower())))
            else:
                odd.append(w)
                said.append(text)
        if odd:
            e = self.tokenizer.encode(said, is_pretokenized=True, add_special_tokens=False)
            ids, ends = np.array(e.ids, "<u4").tobytes(), np.cumsum(np.bincount(np.array(e.word_ids, np.int64), minlength=len(odd))) * 4
            found.update((w, ids[a:b]) for w, a, b in zip(odd, [0, *ends.tolist()], ends.tolist(), strict=False))
        self.words.update((w, ids) for w, ids in found.items() if len(w) <= 64)
        if len(self.words) > WORDS_KEPT:
            self.words, self.older = {}, self.words
        return found

    def atom(self, atom: str) -> bytes:
        """Ids of a run of letters, a digit or a run of other signs: the pre-tokenizer parts words there, so letters and digits go straight to the merges, byte by byte."""
        ids = self.atoms.get(atom)
        if ids is None:
            known = self.merges.tokenize("".join(map(BYTES.__getitem__, atom.encode()))) if atom.isalnum() else None
            ids = np.array([t.id for t in known] if known is not None else self.tokenizer.encode(atom, add_special_tokens=False).ids, "<u4").tobytes()
            if len(self.atoms) > WORDS_KEPT:
                self.atoms = {}
            if len(atom) <= 64:
                self.atoms[atom] = ids
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """As the library does without a decoder: tokens with one space between them."""
        return b" ".join(map(self.tokens.__getitem__, ids.tolist()))


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def marks(text: bytes) -> np.ndarray:
    """Places where a chunk may end, by a polynomial hash of the WINDOW bytes before; never inside a code point."""
    found = []
    for begin in range(0, len(text), BLOCK):
        low = max(0, begin - WINDOW + 1)
        block = np.frombuffer(text, np.uint8, min(len(text), begin + BLOCK) - low, low)
        h, span, power = (block.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B), 1, BASE
        while span < WINDOW:  # the hash of twice as many bytes is that of the later half and that of the earlier half, moved on
            twice = h.copy()
            twice[span:] += h[:-span] * np.uint32(power)
            h, span, power = twice, 2 * span, power * power & 0xFFFFFFFF
        at = np.flatnonzero(h * np.uint32(0xC2B2AE35) < (1 << 32) // MEAN) + low + 1
        found.append(at[at > begin])
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    at = at[at < len(text)]
    return at[np.frombuffer(text, np.uint8)[at] & 0xC0 != 0x80] if len(at) else at


def chunks(text: bytes) -> list[tuple[int, int]]:
    """(begin, end) of a text's chunks."""
    out, begin = [], 0
    for at in [*marks(text).tolist(), len(text)]:
        while at - begin > MOST:
            end = begin + MOST
            while end > begin + MOST - 4 and text[end] & 0xC0 == 0x80:
                end -= 1
            out.append((begin, end))
            begin = end
        if at - begin >= LEAST or at == len(text) > begin:
            out.append((begin, at))
            begin = at
    return out


def digest(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def bit_of(chunk: bytes) -> int:
    return int.from_bytes(chunk[:4], "little") % FILTER_BITS


class Shared:
    """Chunks that may stand in several places: all that do, and some more, by a bitmap of FILTER_BITS bits."""

    def __init__(self, words: list[tuple[int, int]]):
        self.bits = np.zeros(FILTER_BITS // 64, np.uint64)
        for word, mask in words:
            self.bits[word] = np.uint64(mask & 0xFFFFFFFFFFFFFFFF)

    def __contains__(self, chunk: bytes) -> bool:
        bit = bit_of(chunk)
        return bool(int(self.bits[bit >> 6]) >> (bit & 63) & 1)


def shared_chunks(texts: DataFrame) -> Broadcast:
    """Shared, by a count of all chunks' digests; the driver gets at most FILTER_BITS / 64 rows, whatever the number of chunks."""

    def counted(it: Iterator[tuple]) -> Iterator[tuple]:
        n: dict[bytes, int] = {}  # of a task's texts
        for (text,) in it:
            for begin, end in chunks(text or b""):
                chunk = digest(text[begin:end])
                n[chunk] = n.get(chunk, 0) + 1
        yield from n.items()

    several = map_rows(texts.select("text"), "chunk binary, n long", counted).groupBy("chunk").agg(F.sum("n").alias("n")).where("n > 1")
    bit = several.select(F.pmod(F.conv(F.hex(F.reverse(F.substring("chunk", 1, 4))), 16, 10).cast("long"), F.lit(FILTER_BITS)).alias("bit"))
    words = bit.select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    return texts.sparkSession.sparkContext.broadcast(Shared([tuple(r) for r in words.collect()]))


def chunk_ids(texts: DataFrame, shared: Broadcast, vocabulary: str) -> DataFrame:
    """chunk, n, ids of every shared chunk: its text goes once from each task that has it to the one that encodes it, once."""

    def sent(it: Iterator[tuple]) -> Iterator[tuple]:
        n: dict[bytes, int] = {}
        for (text,) in it:
            for begin, end in chunks(text or b""):
                chunk = digest(piece := text[begin:end])
                if chunk in shared.value:
                    if chunk not in n:
                        yield chunk, 0, piece
                    n[chunk] = n.get(chunk, 0) + 1
        for chunk, times in n.items():
            yield chunk, times, None

    def encoded(it: Iterator[tuple]) -> Iterator[tuple]:
        c, now, n, ids = codec(vocabulary), None, 0, None
        for chunk, times, piece in it:
            if chunk != now:
                if now is not None:
                    yield now, n, ids
                now, n, ids = chunk, 0, None
            n += times
            if ids is None and piece is not None:
                ids = c.encode(piece)
        if now is not None:
            yield now, n, ids

    there = map_rows(texts.select("text"), "chunk binary, n long, piece binary", sent)
    return saved(map_rows(there.repartition("chunk").sortWithinPartitions("chunk"), "chunk binary, n long, ids binary", encoded), "bpe-chunks")


def parted(text: bytes, at: int) -> bool:
    """Whether a text's tokens before and after a place don't hang on each other."""
    return at in (0, len(text)) or text[at - 1] in SPACES


def before(text: bytes, at: int) -> int:
    while not parted(text, at):
        at -= 1
    return at


def after(text: bytes, at: int) -> int:
    while not parted(text, at):
        at += 1
    return at


def reused(text: bytes, shared: Shared) -> list[tuple[int, int, int, int, bytes]] | None:
    """(begin, end, first, last, chunk): shared chunks of a text and from where to where their ids hold; None if it has no shared chunk.

    Joins are repaired outwards: what lies between the last place in the chunk before and the first place in the chunk after at which the tokens of the chunk and of the whole text must agree
    is left to be encoded anew. A chunk without such places holds nowhere, and the repair goes on into its neighbour.
    """
    found = [(begin, end, chunk) for begin, end in chunks(text) if (chunk := digest(text[begin:end])) in shared]
    if not found:
        return None
    out = []
    for begin, end, chunk in found:
        first, last = after(text, begin), before(text, end)
        if begin <= first < last <= end:
            out.append((begin, end, first, last, chunk))
    return out


def references(texts: DataFrame, shared: Broadcast, vocabulary: str) -> DataFrame:
    """PLACES of shared chunks, head and tail tokens of each to leave off; and for each document with any a row at place -1 that counts its copies (rows of the same doc_id and text)."""

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        c, copies = codec(vocabulary), {}
        for doc_id, text in it:
            text = text or b""
            if (parts := reused(text, shared.value)) is None:
                continue
            key = (digest(text), doc_id)
            copies[key] = copies.get(key, 0) + 1
            if copies[key] == 1:
                for begin, end, first, last, chunk in parts:
                    yield *key, first, 0, chunk, len(c.encode(text[begin:first])) // 4, len(c.encode(text[last:end])) // 4
        for key, n in copies.items():
            yield *key, -1, n, None, 0, 0

    return saved(map_rows(texts, f"{PLACES}, copies long, chunk binary, head int, tail int", run), "bpe-references")


def literals(texts: DataFrame, shared: Broadcast, vocabulary: str) -> DataFrame:
    """PLACES and ids of what no shared chunk holds for, of documents that have a shared chunk: other chunks, and joins."""

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        c, seen = codec(vocabulary), set()
        for doc_id, text in it:
            text = text or b""
            key = (digest(text), doc_id)
            if key in seen or (parts := reused(text, shared.value)) is None:
                continue
            seen.add(key)
            at = 0
            for _, _, first, last, _ in [*parts, (0, 0, len(text), len(text), None)]:
                if first > at and (ids := c.encode(text[at:first])):
                    yield *key, at, ids
                at = last

    return map_rows(texts, f"{PLACES}, ids binary", run)


def id_batches(rows: Iterator[tuple[int, bytes]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of FEW rows at most, each an id and tokens."""
    for few in iter(lambda: list(islice(rows, FEW)), []):
        ends = np.cumsum([0, *[len(ids) // 4 for _, ids in few]])
        values = pa.array(np.frombuffer(b"".join(ids for _, ids in few), "<i4"))
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in few], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=schema.field(1).type)], schema=schema)


def coded(docs: DataFrame, schema: str, finish: Callable[[Iterator[tuple[int, bytes]], pa.Schema], Iterator[pa.RecordBatch]], vocabulary: str = VOCABULARY) -> DataFrame:
    """finish() over (doc_id, ids as bytes) of a partition's documents, as encoded() states; it runs in the worker that has encoded them."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = shared_chunks(texts)
    arrow = spark_schema(docs.sparkSession, schema)
    ids = chunk_ids(texts, shared, vocabulary)
    places = references(texts, shared, vocabulary)
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = hot_join(places.where("chunk is not null"), ids, ["chunk"], "n", total)
    own = ["text_key", "doc_id", "place"]
    rows = held.select(*own, F.lit(0).cast("long").alias("copies"), F.expr("substring(ids, 1 + 4 * head, length(ids) - 4 * (head + tail))").alias("ids"))
    rows = rows.unionByName(places.where("chunk is null").select(*own, "copies", F.lit(None).cast("binary").alias("ids")))
    rows = rows.unionByName(literals(texts, shared, vocabulary).select(*own, F.lit(0).cast("long").alias("copies"), "ids"))
    rows = rows.repartition("text_key", "doc_id").sortWithinPartitions("text_key", F.asc_nulls_first("doc_id"), "place")

    def alone(it: Iterator[tuple]) -> Iterator[tuple[int, bytes]]:
        c, s = codec(vocabulary), shared.value
        for doc_id, text in it:
            text = text or b""
            if not any(digest(text[begin:end]) in s for begin, end in chunks(text)):
                yield doc_id, c.encode(text)

    def joined(it: Iterator[tuple]) -> Iterator[tuple[int, bytes]]:
        now, copies, parts, last = None, 0, [], -1
        for text_key, doc_id, place, more, part in it:
            if (text_key, doc_id) != now:
                if now:
                    yield from repeat((now[1], b"".join(parts)), copies)
                now, copies, parts, last = (text_key, doc_id), 0, [], -1
            copies += more
            if place > last:  # tasks with copies of a document each send its parts
                parts.append(part)
                last = place
        if now:
            yield from repeat((now[1], b"".join(parts)), copies)

    def over(df: DataFrame, made: Callable[[Iterator[tuple]], Iterator[tuple[int, bytes]]]) -> DataFrame:
        return df.mapInArrow(lambda batches: finish(made(r for b in sliced(batches) for r in unpacked(b)), arrow), schema)

    return over(rows, joined).unionByName(over(texts, alone))


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (array<int>) of every document row, as the tokenizers library encodes its whole text without adding special tokens.

    Texts are cut where a rolling hash says, so equal passages give equal chunks wherever they stand. A document without shared chunks is encoded where it is. Of
    the others, ids of shared chunks, encoded once, meet the ids of what is left, in order; texts aren't moved, but for one copy of a shared chunk from each task that has it. White space is
    where chunk and text agree for certain, as no token of the vocabulary reaches over it (its normalizer and its pre-tokenizer part there); text without any is encoded as a whole. A null text is
    empty and has no ids; bytes that aren't UTF-8 are U+FFFD; rows with null doc_ids and repeated rows are rows like others; other columns aren't read; no rows give no rows.
    """
    return coded(docs, "doc_id long, ids array<int>", id_batches, vocabulary)


def decoded(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text of encoded() rows: tokens with one space between them, special ones too. Null or no ids give an empty text; ids must be the vocabulary's."""
    out = spark_schema(rows.sparkSession, "doc_id long, text string")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
        c = codec(vocabulary)
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield doc_id, c.decode(ids.values.to_numpy()).decode() if ids.is_valid else ""

    return rows.select("doc_id", "ids").mapInArrow(lambda batches: packed(texts(batches), out, FEW), "doc_id long, text string")


def digests(rows: Iterator[tuple[int, bytes]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    c = codec(VOCABULARY)
    return packed(((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(np.frombuffer(ids, "<u4"))).hexdigest()) for d, ids in rows), schema)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "documents"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests)
