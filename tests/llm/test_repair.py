"""Conversation repair against a search of all edits, over whole tables and odd rows."""

from __future__ import annotations

import hashlib
import re
from itertools import product
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from fleetspan.llm import repair

CONV = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.001"
MATCH = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """rows: (initial, fault). Every string of edits with up to three inserts at each place, told apart by cost, then ASCII order."""
    best = None
    for edits in product("DKR", repeat=len(rows)):
        cost, kept = 0, []
        for edit, (initial, fault) in zip(edits, rows, strict=True):
            if edit != "D" and fault in (repair.BLANK, repair.DUPLICATE) or edit == "K" and initial not in "sua":
                break
            cost += {"D": 3, "K": 0, "R": 2}[edit] + (edit != "D" and fault == repair.CUT)
            kept.append("" if edit == "D" else initial if edit == "K" else "?")
        else:
            for inserts in product(range(4), repeat=len(rows) + 1):
                total = cost + 2 * sum(inserts)
                if best and total > best[0]:
                    continue
                roles = "".join("?" * n + k for n, k in zip(inserts, [*kept, ""], strict=True))
                audit = "".join("I" * n + e for n, e in zip(inserts, [*edits, ""], strict=True))
                fills = roles.replace("?", "{}")
                if any(MATCH.fullmatch(fills.format(*f)) for f in product("ua", repeat=roles.count("?"))):
                    best = min(best or (total, audit), (total, audit))
    return best


def test_search_equals_all_edits():
    r = np.random.default_rng(1)
    for n in range(5):
        for _ in range(40 if n < 4 else 25):
            rows = [("suax"[r.integers(4)], int(r.choice([0, 0, 0, 1, 2, 3]))) for _ in range(n)]
            codes = bytes("suax".index(i) + 4 * f for i, f in rows)
            cost, audit = repair.search(codes)
            assert (cost, audit.decode()) == cheapest(rows), rows


def test_search_of_a_long_conversation():
    r = np.random.default_rng(2)
    codes = bytes(int(x) for x in r.integers(0, 16, 100_000))
    cost, audit = repair.search(codes)
    state, spent, i = repair.START, 0, 0
    for e in audit.decode():
        fault, initial = codes[i] >> 2 if e != "I" else 0, codes[i] & 3 if e != "I" else 0
        spent += {"D": 3, "I": 2, "K": 0, "R": 2}[e] + (e in "KR" and fault == repair.CUT)
        assert e in "DI" or fault not in (repair.BLANK, repair.DUPLICATE)
        state = state if e == "D" else repair.KEPT[state][initial] if e == "K" else repair.DUE[state]
        i += e != "I"
    assert i == len(codes) and spent == cost and state in repair.ENDING


def brute(rows):
    """conv_id -> result of the query, by rows and in turn."""
    out, by = {}, {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        by[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, given in by.items():
        given.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in given:
            solid = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append(repair.BLANK if not solid else repair.DUPLICATE if (role, text) in seen else repair.SOUND if solid[-1] in ".!?" else repair.CUT)
            seen.add((role, text))
        turns = [t for t, _, _ in given if t is not None]
        initials = [r[:1] for _, r, _ in given]
        codes = bytes(("sua".index(i) if i and i in "sua" else 3) + 4 * f for i, f in zip(initials, faults, strict=True))
        cost, audit = repair.search(codes)
        said, last, it = [], "", iter(given)
        for e in audit.decode():
            row = next(it) if e != "I" else (0, "", "")
            due = "assistant" if last == "u" else "user"
            if e != "D":
                said.append((row[1] if e == "K" else due, row[2]))
                last = said[-1][0][0]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit.decode(), digest)
    return out


def query(spark, rows, tmp_path):
    frame = spark.createDataFrame(rows, CONV).withColumns({c: F.lit("x") for c in ("pos", "code", "h", "audit", "kind")})
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def test_query_equals_brute_force(spark):
    given = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = repair.op13_conversation_repair(spark, SF).collect()
    want = brute([tuple(r) for r in given.collect()])
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got} == want


def test_odd_rows(spark, tmp_path):
    rows = [(None, 1, "user", "hi."), (None, None, None, None), (None, 2, "assistant", "yes"), (2, 5, "user", "a b c."), (2, 5, "user", "a b c."), (2, 5, "tool", "x!"), (2, 9, "", "y?"), (3, 0, "Ärzte", " \t"), (4, None, "assistant", "ß " * 50_000)]
    rows += [(5, i, ("system", "user", "assistant")[i % 3], "same words." if i % 2 else f"turn {i}") for i in range(400)]
    lone = next(i for i in range(100, 400) if crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((lone, 0, "user", "dropped."))
    got = query(spark, rows, tmp_path)
    assert got == brute(rows)
    assert got[lone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_no_rows(spark, tmp_path):
    assert query(spark, [], tmp_path) == {}
