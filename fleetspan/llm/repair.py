"""Conversation structure repair: the cheapest edits that make roles alternate, found by depth-first branch-and-bound."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspan.llm.common import hot_join, map_rows, saved, table

#: Costs of edits, and what an undeleted truncated row adds.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
SPACES = " \t\n\x0b\x0c\r"
ENDS = [".", "!", "?"]
#: A row's code: its role's initial, and four times its fault.
INITIALS = "sua"
SOUND, BLANK, DUPLICATE, CUT = range(4)
OTHER = 3
#: States of the roles given out so far: none, after a system row, after a user row, after an assistant row; the first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDING = (START, ASSISTANT)
#: State -> initial of a row that is kept -> state after it.
KEPT = [{0: SYSTEM, 1: USER}, {1: USER}, {2: ASSISTANT}, {1: USER}]
#: State -> state after a row of the role that is due, user or assistant.
DUE = [USER, USER, ASSISTANT, USER]
#: Pairs of initials that may follow each other.
LEGAL = {(0, 1), (1, 2), (2, 1)}
D, I, K, R = b"DIKR"
FAR = 1 << 30

AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def suffix_bounds(codes: bytes) -> array:
    """For each row and state (at 4 * row + state) a lower bound of the cost of all edits from there on: the least cost if audits are of no account."""
    n = len(codes)
    bounds = array("i", bytes(16 * (n + 1)))
    bounds[4 * n :] = array("i", [0, 2 * INSERT, INSERT, 0])
    for i in range(n - 1, -1, -1):
        fault, initial = codes[i] >> 2, codes[i] & 3
        after = bounds[4 * i + 4 : 4 * i + 8]
        stays = TRUNCATED * (fault == CUT)
        least = [DELETE + x for x in after]
        if fault not in (BLANK, DUPLICATE):
            for q in range(4):
                least[q] = min(least[q], REROLE + stays + after[DUE[q]], stays + after[KEPT[q][initial]] if initial in KEPT[q] else FAR)
        user, assistant = least[USER], least[ASSISTANT]
        least[USER], least[ASSISTANT] = min(user, INSERT + assistant), min(assistant, INSERT + user)
        least[START], least[SYSTEM] = min(least[START], INSERT + least[USER]), min(least[SYSTEM], INSERT + least[USER])
        bounds[4 * i : 4 * i + 4] = array("i", least)
    return bounds


def search(codes: bytes) -> tuple[int, bytes]:
    """Least cost of edits whose roles match (s?(ua)+)?, and of those edits' initials the ASCII-least.

    Branches are tried in ASCII order from an explicit stack. A branch is cut if its cost and the bound of what is left exceed the incumbent's cost (at first the root's bound), or if its node was
    reached as cheaply before: what comes later is the greater audit. The search ends when the incumbent's cost is the root's bound. Memory is a few numbers a row.
    """
    n, bounds = len(codes), suffix_bounds(codes)
    reached = array("i", [FAR]) * (4 * n + 4)
    limit, best, audit = bounds[START], None, bytearray()
    stack = [(0, START, 0, 0, 0)]
    while stack:
        i, q, cost, depth, edit = stack.pop()
        node = 4 * i + q
        if cost >= reached[node] or cost + bounds[node] > limit:
            continue
        reached[node] = cost
        del audit[depth:]
        if edit:
            audit.append(edit)
        if i == n and q in ENDING:
            limit, best = cost, bytes(audit)
            if limit == bounds[START]:
                break
            continue
        branches = []
        if i < n:
            fault, initial = codes[i] >> 2, codes[i] & 3
            stays = cost + TRUNCATED * (fault == CUT)
            branches.append((i + 1, q, cost + DELETE, D))
            branches.append((i, DUE[q], cost + INSERT, I))
            if fault not in (BLANK, DUPLICATE):
                if initial in KEPT[q]:
                    branches.append((i + 1, KEPT[q][initial], stays, K))
                branches.append((i + 1, DUE[q], stays + REROLE, R))
        else:
            branches.append((i, DUE[q], cost + INSERT, I))
        for row, state, total, name in reversed(branches):
            if total + bounds[4 * row + state] <= limit:
                stack.append((row, state, total, len(audit), name))
    return limit, best


class Conversation:
    """Codes of a conversation's rows, one byte each, as they come in order, and what is counted on the way."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes, self.counts = conv_id, bytearray(), [0, 0, 0, 0]
        self.first = self.last = self.before = None
        self.turns = self.illegal = 0

    def add(self, turn: int | None, code: int) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        self.counts[code >> 2] += 1
        self.illegal += bool(self.codes) and (self.codes[-1] & 3, code & 3) not in LEGAL
        self.codes.append(code)

    def row(self) -> tuple:
        cost, audit = search(bytes(self.codes))
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, *self.counts[1:], self.illegal, cost, audit.decode()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by a checksum of conversation and turn; nulls of role and text, and of the checksum's text, are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), kind.alias("kind"), space("role").alias("role"), space("text").alias("text"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and pos, a row's place in its conversation from 1: by turn, nulls first, then role and text. Rows of a conversation stream through one task's window."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return saved(own.withColumn("pos", F.row_number().over(order)), "repair-rows")


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, pos and code of numbered() rows. Only digests of texts meet, to tell which rows say what an earlier one said."""
    solid = F.rtrim("text", F.lit(SPACES))
    digest = F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0)) - 1, F.lit(OTHER))  # an empty role stands at 0 too
    initial = F.when(F.length("role") == 0, OTHER).otherwise(initial)
    own = F.when(solid == "", BLANK).when(F.right(solid, F.lit(1)).isin(ENDS), SOUND).otherwise(CUT)
    marks = rows.select("conv_id", "turn", "pos", initial.cast("int").alias("initial"), own.alias("fault"), digest.alias("h"))
    said = saved(marks.where(F.col("fault") != BLANK).groupBy("h").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1"), "repair-said")
    total = said.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = hot_join(marks, said, ["h"], "n", total, "left")
    fault = F.when((F.col("fault") != BLANK) & (F.col("pos") > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    return met.select("conv_id", "turn", "pos", (F.col("initial") + 4 * fault).alias("code"))


def in_order(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "pos", *more)


def audits(rows: DataFrame) -> DataFrame:
    """AUDITS of each conversation of numbered() rows; a task holds a byte and some numbers for each row of the conversation that it is at, and no texts."""

    def solved(it: Iterator[tuple]) -> Iterator[tuple]:
        now = None
        for conv_id, turn, _, code in it:
            if now is None or now.conv_id != conv_id:
                if now:
                    yield now.row()
                now = Conversation(conv_id)
            now.add(turn, code)
        if now:
            yield now.row()

    return saved(map_rows(in_order(coded(rows)), AUDITS, solved), "repair-audits")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, turn_no (from 0), role, text: numbered() rows after the edits of audits(). Partitions hold conversations whole and in order; a task holds one row at a time."""
    edits = found.select("conv_id", F.posexplode(F.regexp_extract_all("audit", F.lit("I*[DKR]|I+$"), F.lit(0))).alias("at", "edit"))
    edits = edits.select("conv_id", (F.col("at") + 1).alias("pos"), F.lit(0).alias("kind"), F.lit("").alias("role"), F.col("edit").alias("text"))
    own = rows.select("conv_id", "pos", F.lit(1).alias("kind"), "role", "text")

    def applied(it: Iterator[tuple]) -> Iterator[tuple]:
        due, now, state, n, edit = [None, None, "user", "assistant"], object(), START, 0, ""
        for conv_id, _, kind, role, text in it:
            if conv_id != now:
                now, state, n = conv_id, START, 0
            role, text = role.decode("utf-8", "replace"), text.decode("utf-8", "replace")
            if kind == 0:
                inserts, edit = text.count("I"), text.lstrip("I")
                for _ in range(inserts):
                    state = DUE[state]
                    yield conv_id, n, due[state], ""
                    n += 1
            elif edit != "D":
                state = KEPT[state][INITIALS.index(role[0])] if edit == "K" else DUE[state]
                yield conv_id, n, role if edit == "K" else due[state], text
                n += 1

    return map_rows(in_order(edits.unionByName(own), "kind"), "conv_id long, turn_no long, role string, text string", applied)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of repaired() rows as they stand in their partitions."""

    def hashed(it: Iterator[tuple]) -> Iterator[tuple]:
        now, h = None, None
        for conv_id, n, role, text in it:
            if n == 0:
                if h:
                    yield now, h.hexdigest()
                now, h = conv_id, hashlib.sha256()
            h.update((b"\n" if n else b"") + role + b":" + text)
        if h:
            yield now, h.hexdigest()

    return map_rows(turns, "conv_id long, repaired_sha256 string", hashed)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits(), repaired()) of conversations' rows.

    A row's first fault counts: blank, said before by the same role in the same conversation, or cut off. Blank and repeated rows are deleted; others are kept, given the role that is
    due, or deleted, and empty rows of user or assistant come in, so that roles match (s?(ua)+)? at the least cost, of equal costs by the ASCII-least audit. Null role and text are one
    space; a null turn comes first and leaves no gap; rows of a null conv_id are one conversation; ties of turn go by role and text, so repeated rows stand together; other columns aren't
    read; no rows give no rows.
    """
    rows = numbered(conversations)
    found = audits(rows)
    return found, repaired(rows, found)


def or_zero(c: str, zero: int | str) -> Column:
    return F.coalesce(c, F.lit(zero)).alias(c)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    found, turns = repair(damaged(given))
    ids = given.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    out = out.join(digests(turns), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [or_zero(c, 0) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *counts, or_zero("audit", ""), or_zero("repaired_sha256", hashlib.sha256().hexdigest()))
