"""Chat formatting by token-level assembly: segments are encoded apart, reserved ids spliced between them."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.llm.common import map_rows, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Control strings of the template; the i-th has the i-th id after the vocabulary's.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<<ROLE>>", "<</ROLE>>"]
BOS, END, USER, ASSISTANT, SYSTEM, ROLE, ROLE_END = range(7)
#: Known roles have a mark of their own; any other is spelled out between <<ROLE>> and <</ROLE>>.
MARKS = {"user": USER, "assistant": ASSISTANT, "system": SYSTEM}
#: The role that is learned from.
LEARNED = "assistant"

_CONTROL = re.compile("|".join(rf"{re.escape(c[0])}(\\*){re.escape(c[1:])}" for c in CONTROLS))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\(\\*){re.escape(c[1:])}" for c in CONTROLS))
_codecs: dict[str, Codec] = {}

SEGMENTS = "conv_id long, turn_no long, token_start long, input_ids array<int>, loss_mask array<tinyint>"


def escape(text: str) -> str:
    """A control string gets a backslash after its first character, one with backslashes there gets one more."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


class Codec:
    """Byte-level BPE of a public vocabulary file; reserved ids follow its own."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.first = max(ranks.values()) + 1
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.bpe.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self.bpe.decode_bytes(ids).decode("utf-8", "surrogatepass")


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def segment(role: str, text: str, c: Codec) -> tuple[list[int], int, int]:
    """Ids of a turn, and where what is learned begins and ends in them (0 and 0 if nothing is)."""
    mark = [c.first + MARKS[role]] if role in MARKS else [c.first + ROLE, *c.encode(escape(role)), c.first + ROLE_END]
    body = c.encode(escape(text))
    learned = (len(mark), len(mark) + len(body)) if role == LEARNED else (0, 0)
    return [*mark, *body, c.first + END], *learned


def spliced(ids: list[int], begin: int, end: int, c: Codec, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of a turn in its conversation. The mask is the running sum of +1 where learned text begins and -1 where it ends."""
    out = np.array([c.first + BOS, *ids] if first else ids, np.int32)
    steps = np.zeros(len(out) + 1, np.int8)
    if end > begin:
        steps[begin + first] += 1
        steps[end + first] -= 1
    return out, np.cumsum(steps)[:-1].astype(np.int8)


def format_conversations(conversations: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per turn in order: conv_id, turn_no (from 0), token_start, input_ids, loss_mask. A conversation's ids are its rows' ids end to end.

    Turns are ordered by turn (null first), then role and ids, so repeated rows stay, side by side. Null text and null role are empty; rows with a
    null conv_id are one conversation. Rows are encoded where they are; only splicing and counting need a conversation's rows in order, and rows stream through
    sorted partitions: nothing holds a whole conversation, however long. Texts keep every code point, bytes that aren't UTF-8 become U+FFFD;
    other columns are not read; no rows give no rows.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def encoded(it: Iterator[tuple]) -> Iterator[tuple]:
        c = codec(vocabulary)
        for conv, turn, role, text in it:
            role = role.decode("utf-8", "replace")
            yield conv, turn, role, *segment(role, text.decode("utf-8", "replace"), c)

    segments = map_rows(rows, "conv_id long, turn long, role string, ids array<int>, learned_from int, learned_to int", encoded)
    ordered = segments.repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "ids")])

    def turns(it: Iterator[tuple]) -> Iterator[tuple]:
        c, now, n, at = codec(vocabulary), object(), 0, 0
        for conv, _, _, given, begin, end in it:
            if conv != now:
                now, n, at = conv, 0, 0
            ids, mask = spliced(given, begin, end, c, n == 0)
            yield conv, n, at, ids, mask
            n, at = n + 1, at + len(ids)

    return map_rows(ordered, SEGMENTS, turns)


class ReadBack:
    """What a conversation's ids say, turn after turn."""

    def __init__(self, conv_id, c: Codec):
        self.conv_id, self.c = conv_id, c
        self.turns, self.learned = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, ids: list[int], mask: list[int]) -> None:
        c, names = self.c, {v: k for k, v in MARKS.items()}
        at = 1 if ids[0] == c.first + BOS else 0
        mark = ids[at] - c.first
        begin = at + 1
        if mark == ROLE:
            end = ids.index(c.first + ROLE_END, begin)
            raw_role = c.decode(ids[begin:end])
            role, begin = unescape(raw_role), end + 1
            self.chars += len(raw_role) + len(CONTROLS[ROLE_END])
        else:
            role = names[mark]
        body = ids[begin:-1]
        raw = c.decode(body)
        text = unescape(raw)
        self.chars += len(CONTROLS[BOS]) * at + len(CONTROLS[mark]) + len(raw) + len(CONTROLS[END])
        self.turns.update(f"{role}\n{text}\n".encode())
        learned = unescape(c.decode([x for x, m in zip(ids, mask, strict=True) if m]))
        self.learned.update(learned.encode())
        self.loss_chars += len(learned)
        self.n += 1

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(segments: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Digests of each conversation, decoded from format_conversations()'s rows, whose partitions hold conversations whole and in order."""

    def digests(it: Iterator[tuple]) -> Iterator[tuple]:
        c, now = codec(vocabulary), None
        for conv, n, _, ids, mask in it:
            if n == 0:
                if now:
                    yield now.row()
                now = ReadBack(conv, c)
            now.add(ids, mask)
        if now:
            yield now.row()

    return map_rows(segments, READ, digests)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(says).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("t")).select("conv_id", "t.*")
    return read_back(format_conversations(given.unionByName(own)))
