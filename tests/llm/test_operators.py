"""Text operators on small tables: brute force, round trips, nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspan.llm import chat, common, decontaminate, language_model, licenses, line_dedup, minhash, mixing, quality_model, quality_rules, toxicity
from fleetspan.llm.attention import STRIDE, WINDOW, Attention, initial
from fleetspan.llm.common import saved

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOC)


ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "a row without an id that has some words"), (4, "word " * 30_000), (5, "same text here with words"), (5, "same text here with words"), (6, "naïve Ünïcode ß\x0b\x0c\r\nend")]


@pytest.fixture(scope="module")
def odd(spark):
    clash = {c: F.lit("x") for c in ("score", "n_words", "kept", "held_out", "n_lines", "rate", "h", "keys", "word", "band", "id")}
    return frame(spark, ODD).withColumns(clash)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (5, 0, None), (None, 1, 1), (4, 0, 1), (6, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")


# near duplicates


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    n = min(k, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute_components(rows, k, percent=80):
    ids = [i for i, _ in rows]
    sets = [sets_of(t, k) for _, t in rows]
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(ids[a]), root(ids[b])
                comp[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in zip(ids, sets, strict=True)}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    r = np.random.default_rng(k)
    base = [f"w{i}" for i in r.integers(0, 500, 60)]
    rows = []
    for i in range(90):  # one large group of copies that differ in some words, around the limit of similarity
        w = list(base)
        for j in r.choice(60, int(r.integers(0, 9)), replace=False):
            w[j] = f"x{r.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"u{r.integers(0, 3000)}" for _ in range(40))) for i in range(30)]
    rows += [(200, "One"), (201, "one "), (202, "one two"), (203, rows[3][1].upper())]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(frame(spark, rows), k).collect()}
    assert got == brute_components(rows, k)


def test_near_duplicates_of_odd_rows(spark, odd):
    got = minhash.near_duplicates(odd, 2).collect()
    assert len(got) == len(ODD)
    by = {(x.doc_id): x for x in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept
    assert by[None].component_id is None and by[None].kept
    assert by[4].n_shingles == 1 and sum(x.doc_id == 5 for x in got) == 2
    assert minhash.near_duplicates(odd.where("false")).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.id: r.component for r in minhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100 + i: 100 for i in range(30)}


def test_stars_take_no_step(spark, monkeypatch):
    made = []
    monkeypatch.setattr(minhash, "saved", lambda df, tag: made.append(tag) or saved(df, tag))
    stars = [(1, i) for i in range(2, 9)] + [(20, 21)]
    got = {r.id: r.component for r in minhash.components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 9)} | {20: 20, 21: 20}
    assert made == ["links", "lowest"]


@pytest.mark.parametrize("hot_rows", [0, 256])
def test_near_duplicates_with_and_without_hot_keys(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(minhash, "CENTRE_PAIRS", 3 if hot_rows == 0 else minhash.CENTRE_PAIRS)
    rows = [(i, " ".join(f"w{j}" for j in range(60) if j != i % 11)) for i in range(40)] + [(100 + i, " ".join(f"v{i}_{j}" for j in range(20))) for i in range(5)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), words=2).collect()}
    assert got == {i: 0 for i in range(40)} | {100 + i: 100 + i for i in range(5)}


def test_hot_join_without_hot_keys_is_one_join(spark, monkeypatch):
    left = spark.createDataFrame([(i % 3, i) for i in range(30)], "k long, x long")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    plain, dealt = common.hot_join(left, right, ["k"], "n", 30, most=10), common.hot_join(left, right, ["k"], "n", 30)
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Join") == 1
    assert sorted(plain.collect()) == sorted(dealt.collect()) and plain.count() == 30
    monkeypatch.setattr(common, "HOT_ROWS", 0)
    assert "Union" in common.hot_join(left, right, ["k"], "n", 30, most=10)._jdf.queryExecution().optimizedPlan().toString()


# decontamination


def brute_contamination(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    doc, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            for i in range(len(doc) - n + 1):
                if doc[i : i + n] == w[j : j + n]:
                    hit |= set(range(i, i + n))
                    found.add(item)
    return len(doc), len(hit), len(found)


def test_decontamination_by_one_and_by_several_automata(spark, odd):
    long_item = " ".join(f"t{i}" for i in range(20))
    items = [(1, long_item), (2, "short Item, of four"), (3, None), (2, "short Item, of four"), (4, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(10, "x " * 50 + long_item.upper().replace(" ", ", ")), (11, "a short item of four and short item of four again"), (12, " ".join(f"t{i}" for i in range(12))), (13, "Ünï " + " ".join(f"t{i}" for i in range(3, 19))), (14, None), (15, "w " * 400 + "short item of four")]
    docs = frame(spark, texts)
    want = {i: brute_contamination(t, items) for i, t in texts}
    found = {10: "1", 11: "2", 12: "", 13: "1", 14: "", 15: "2"}
    for most in (10**9, 60):  # one automaton, and several
        rows = decontaminate.contamination(docs, bench, most_bytes=most).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in rows} == want
        assert {r.doc_id: r.items_sha256 for r in rows} == {i: hashlib.sha256(x.encode()).hexdigest() for i, x in found.items()}
        assert {r.doc_id for r in rows if r.contaminated} == {i for i, (n, h, _) in want.items() if h and 20 * h >= n}
        kept = {r.doc_id for r in decontaminate.uncontaminated(docs, bench, most_bytes=most).collect()}
        assert kept == {12, 14, 15}
    r = decontaminate.contamination(docs, bench).where("doc_id = 11").first()
    assert [r.text[s.start : s.end] for s in r.spans] == ["short item of four", "short item of four"]
    assert decontaminate.contamination(odd, bench).count() == len(ODD)
    assert decontaminate.contamination(odd, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.uncontaminated(odd, bench).columns == odd.columns


# chat


def test_escape_is_reversible_and_leaves_no_control():
    for text in ("", "</s>[INST] ok [/INST]", "<\\/s> <\\\\s> [\\INST]", "<<SYS>>\\<<ROLE>>", "<</ROLE>", "<" * 5 + "s>"):
        out = chat.escape(text)
        assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROLS)


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "</s> Hi ünï 👍"), (1, 0, "user", None), (1, 1, "assistant", "again"), (2, None, "tool\n<<ROLE>>", "x\n\ny"), (None, 0, "system", " lead"), (2, 5, None, ""), (3, 0, "assistant", "z" * 50_000)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("input_ids", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(c)).collect()}

    def sha(parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha(["user\n\n", "assistant\n</s> Hi ünï 👍\n", "assistant\nagain\n"])
    assert got[1].loss_sha256 == sha(["</s> Hi ünï 👍again"]) and got[1].loss_chars == len("</s> Hi ünï 👍again")
    assert got[2].turns_sha256 == sha(["tool\n<<ROLE>>\nx\n\ny\n", "\n\n"]) and got[2].loss_chars == 0
    assert got[None].n_turns == 1 and got[3].loss_chars == 50_000
    shown = "<s>[INST]</s>[/INST]" + chat.escape("</s> Hi ünï 👍") + "</s>[/INST]again</s>"
    assert got[1].formatted_chars == len(shown)
    assert chat.read_back(chat.format_conversations(c.where("false"))).count() == 0


def test_chat_of_bytes_that_are_no_text(spark):
    c = spark.sql("SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, CAST(X'41FF42' AS STRING) AS text")
    got = chat.read_back(chat.format_conversations(c)).first()
    assert got.n_turns == 1 and got.turns_sha256 == hashlib.sha256("user\nA\ufffdB\n".encode()).hexdigest()


def test_chat_query_equals_brute_force(spark):
    """Digests of the given conversations straight from their rows; the number of formatted code points from marks and escapes."""
    rows = [*spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect(), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    want: dict = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        turns, said, chars = want.setdefault(conv, ([], [], [len("<s>")]))
        text = text or ""
        turns.append(f"{role}\n{text}\n")
        said.append(text if role == "assistant" else "")
        chars.append(len(chat.CONTROLS[chat.MARKS[role]]) + len(chat.escape(text)) + len("</s>"))
    sha = lambda x: hashlib.sha256("".join(x).encode()).hexdigest()
    got = {r.conv_id: tuple(r)[1:] for r in chat.op5_chat_format(spark, SF).collect()}
    assert got == {k: (len(t), sha(t), len("".join(a)), sha(a), sum(n)) for k, (t, a, n) in want.items()}


# lines


def test_line_dedup_equals_brute_force(spark):
    shared = ["A long shared line", "  a LONG shared line\t", "short", "Another line that is shared"]
    rows = [(i, "\n".join([shared[i % 4], f"own line number {i}", shared[(i * 7) % 4], shared[i % 4]])) for i in range(40)] + [(50, None), (51, ""), (None, shared[0])]
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(" \t\n\r\x0b\x0c").lower()
            if i is not None and len(k) >= 10:
                first[k] = min(first.get(k, i), i)
    want = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or first.get(x.strip().lower(), i) == i]
        want[i] = (len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept))
    docs = frame(spark, rows).withColumn("n_lines", F.lit("clash"))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == want
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def test_line_runs_merge(spark):
    runs = line_dedup.LineRuns(spark, buckets=2, fanout=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(i, i, 10 + i), (99, 99, 10 + i)], "h1 long, h2 long, first_doc long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {(r.h1, r.first_doc) for r in spark.table(runs.levels[2][0]).collect()} == {(0, 10), (1, 11), (2, 12), (3, 13), (99, 10)}
    runs.close()


def test_lines_of_all_batches_are_dropped_by_one_join(spark, monkeypatch):
    joins = []
    monkeypatch.setattr(line_dedup, "hot_join", lambda *a, **b: joins.append(1) or common.hot_join(*a, **b))
    rows = [(i, f"a line of everyone\nthe line of {i // 2} alone\nonly document {i} has this") for i in range(40)] + [(7, "a line of everyone")]
    got = sorted((r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    assert got == sorted([(i, 3, (i > 0) + i % 2) for i in range(40)] + [(7, 1, 1)])
    assert len(joins) == 1


# licences


def test_license_templates(spark, odd):
    texts = {
        1: "Released under the MIT License.", 2: "This work is licensed under the GNU General Public License, version 3.", 3: "Licensed under CC BY-NC 4.0.",
        4: "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        5: "MIT License\n\nCopyright (c) 2020 A. Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        6: "permission is hereby granted free of charge to any dog obtaining a copy", 7: "the license of the committee",
    }
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, texts.items())).collect()}
    assert [got[i].labels for i in texts] == ["mit", "gpl-3", "cc-by-nc", "apache-2", "mit", "", ""]
    assert (got[1].base_labels, got[1].n_base, got[1].first_word) == ("mit", 1, 1) and got[2].base_labels == "" and got[6].score == got[7].score == 0
    assert licenses.license_scan(odd).count() == len(ODD) and licenses.license_scan(odd.where("false")).count() == 0


def test_license_base_equals_a_word_scan(spark):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    r = np.random.default_rng(9)
    parts = ["under the MIT License", "the MIT license", "Apache License, Version 2.0", "apache license version", "CC BY-NC", "cc", "by", "under", "the", "word", "é", "2"]
    texts = [(i, " ".join(parts[j] for j in r.integers(0, len(parts), r.integers(0, 30)))) for i in range(120)] + [(200, None), (201, "")]
    got = {x.doc_id: x for x in licenses.license_scan(frame(spark, texts)).collect()}
    for i, t in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = sorted((k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        labels = {label for _, label in places}
        g = got[i]
        assert (g.n_words, g.n_base, g.base_labels) == (len(words), len(places), ",".join(sorted(labels)))
        assert (g.first_word, g.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        found = {a.label for a in licenses.AUTOMATA for k in range(len(words)) if a.longest([w.encode() for w in words], k)}
        assert g.labels == ",".join(sorted(labels | found)) and 0 <= g.score <= 1


def test_optional_and_replaceable_regions():
    a = licenses.Automaton("x", "one [[two [[three]]]] {{0-2}} four")
    ends = [a.longest(t.encode().split(), 0) for t in ("one four", "one two four", "one two three x y four", "one three four", "one x y z four", "two four")]
    assert ends == [2, 3, 6, 3, 0, 0]


# quality rules


def test_repeated_words(spark):
    window = "a b c d e f g h"
    texts = [f"{window} x {window}", f"{window} {window}", "a " * 9, "a " * 7, f"{window} i x {window} i", ""]
    d = frame(spark, enumerate(texts))

    def brute(t):
        w = t.split()
        seen: dict = {}
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        return len({j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)})

    got = [r[0] for r in quality_rules.measured(d).orderBy("doc_id").select("n_repeat_words").collect()]
    assert got == [brute(t) for t in texts]


def test_host_rates_are_shrunk(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good if i % 50 else "bad", "en", "good", 1) for i in range(200)] + [(300 + i, "bad" if i % 10 else good, "en", "poor", 1) for i in range(100)] + [(500, "bad", "en", "tiny", 1), (501, good, "en", "tiny", 1), (502, good, "en", None, 1)]
    out = {r.doc_id: r.kept for r in quality_rules.judged(spark.createDataFrame(rows, DOC)).collect()}
    assert out[1] and not out[300] and not out[301] and not out[310] and out[502]


def test_quality_rules_of_odd_rows(spark, odd):
    got = quality_rules.judged(odd.drop("n_words", "n_lines", "kept"))
    assert got.count() == len(ODD) and quality_rules.judged(odd.where("false")).count() == 0
    assert {r.doc_id: r.n_words for r in got.collect()}[4] == 30_000


# models


def attention(n, seed=0):
    return Attention(initial(np.full(n, 1 / n), seed))


def test_attention_is_causal_and_scores_each_token_once():
    r = np.random.default_rng(0)
    model = attention(12)
    text = r.integers(0, 11, 5 * STRIDE + 3)
    a = model.log_probs(*model.windows([text]))
    assert (a != 0).sum() == len(text) + 1
    other = text.copy()
    other[-1] = (other[-1] + 1) % 11
    b = model.log_probs(*model.windows([other]))
    assert np.allclose(a.ravel()[: len(text) - 1], b.ravel()[: len(text) - 1])


def test_attention_equals_position_by_position():
    """A plain loop over positions and windows gives the same probabilities, and those of all symbols sum to one."""
    r, model = np.random.default_rng(3), attention(9, 3)
    model.params["dist"] = r.standard_normal(len(model.params["dist"])).astype(np.float32)
    model.refresh()
    text = r.integers(0, 8, 150)
    line, p = [8, *text], model.params
    got = model.log_probs(*model.windows([text])).ravel()
    states = p["stats"] / p["stats"].sum(0)
    for t in range(len(line)):
        low = max(0, (t // STRIDE) * STRIDE - (WINDOW - STRIDE))
        e = p["emb"][line[low : t + 1]].astype(float)
        w = np.exp(e @ p["wk"] @ (e[-1] @ p["wq"]) / 4 + p["dist"][np.arange(t - low, -1, -1)])
        z = (w @ (e @ p["wv"]) / w.sum()) @ p["mix"] + p["bias"]
        pi = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        every = states @ pi
        assert abs(every.sum() - 1) < 1e-5
        assert abs(np.log(every[[*text, 8][t]]) - got[t]) < 1e-3


def test_steps_and_scores_do_not_depend_on_slices(monkeypatch):
    from fleetspan.llm import attention

    r = np.random.default_rng(5)
    texts = [r.integers(0, 30, size) for size in (700, 0, 1, 48, 300)]
    found = []
    for windows in (1, 7, 64):
        monkeypatch.setattr(attention, "SCORED", windows)
        monkeypatch.setattr(attention, "LEARNED_FROM", windows)
        model = Attention(initial(np.full(31, 1 / 31), 3))
        x, y = model.windows(texts)
        loss, g, seen = model.gradients(x, y)
        found.append([np.array(loss), *g.values(), seen, model.log_probs(x, y)])
    for other in found[1:]:
        assert all(np.allclose(a, b, rtol=1e-3, atol=1e-6) for a, b in zip(found[0], other, strict=True))


def test_steps_use_the_pages_of_the_steps_before():
    """Pages that are mapped anew at each step took a third of the time."""
    import resource

    model = attention(300)
    x, y = model.windows([np.random.default_rng(2).integers(0, 299, 20_000)])
    faults = []
    for _ in range(3):
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        model.train(x, y)
        model.log_probs(x, y)
        faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
    assert faults[-1] < 20 * model.steps / 3


def test_attention_gradients_and_learning():
    r = np.random.default_rng(1)
    model = attention(8, 1)
    x, y = model.windows([r.integers(0, 7, 60) for _ in range(3)])
    _, g, seen = model.gradients(x, y)
    assert abs(seen.sum() - 1) < 1e-4
    for name in ("emb", "wq", "wk", "wv", "dist", "mix", "bias"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        loss = []
        for step in (1e-2, -1e-2):
            model.params[name][at] += step
            model.refresh()
            loss.append(model.gradients(x, y)[0])
            model.params[name][at] -= step
        model.refresh()
        assert abs((loss[0] - loss[1]) / 2e-2 - g[name][at]) < 0.15 * abs(g[name][at]) + 1e-4
    texts = [np.full(40, k) for k in (1, 2, 3)] * 40
    x, y = model.windows(texts)
    before = model.log_probs(x, y).sum()
    model.train(x, y)
    assert model.log_probs(x, y).sum() > before


def test_language_model_base_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    rows = docs.collect()
    import math
    import zlib
    from collections import Counter

    counts: Counter = Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 10:
            counts.update([*r.text.encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in language_model.scored(docs).collect()}
    for r in rows:
        tokens = [*r.text.encode().lower().split(), None]
        want = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        g = got[r.doc_id]
        assert abs(g.base_score - want) < 1e-6 * abs(want) and g.n_known == sum(t in counts for t in tokens) and g.n_tokens == len(tokens) and g.train_tokens == n
        assert g.score < 0


def small_words(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    return language_model.Words(language_model.id_counts(words, language_model.VOCABULARY), 2)


def test_language_model_rest_of_a_word_sums_to_one(spark):
    """Given its first id, the chain's steps are distributions, and counts and what discounting leaves sum to one."""
    counts = {"the": 5, "then": 2, "theory": 1, "a": 3, "ünï": 1}
    w = small_words(spark, counts)
    assert np.allclose((10.0 ** w.chain.astype(float)).sum(1), 1, atol=2e-2) and abs(w.share.sum() - 1) < 1e-9
    sub = language_model.subwords(language_model.VOCABULARY)
    ids, first = sub.encode([k.encode() for k in counts])
    heads = ids[first]
    for head in set(heads.tolist()):
        own = sum(n - language_model.DISCOUNT for h, n in zip(heads, counts.values(), strict=True) if h == head) / w.total[head]
        assert abs(own + 10 ** w.left[head] - 1) < 1e-9


def test_language_model_spells_words_one_by_one(spark):
    w = small_words(spark, {"the": 5, "theory": 1})
    sub = language_model.subwords(language_model.VOCABULARY)
    words = [b"theory", b"the", "a\u00a0b".encode(), b"\xc2\x85", b"x" * 5000]
    ids, first = sub.encode(words)
    for word, got in zip(words, w.spelled(ids, first), strict=True):
        own = sub.bpe.encode_ordinary(" " + word.decode())
        assert abs(got - (w.left[own[0]] + sum(float(w.chain[a, b]) for a, b in zip(own, [*own[1:], sub.STOP], strict=True)))) < 1e-6 * len(own)


def test_language_model_scores_do_not_depend_on_the_common_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    got = [{r.doc_id: r for r in language_model.scored(docs, most_words=most).collect()} for most in (0, 50, 1 << 18)]
    for k in got[0]:
        assert max(abs(g[k].score - got[0][k].score) for g in got) < 1e-6 * abs(got[0][k].score) and len({g[k].n_known for g in got}) == 1


def test_language_model_learns_from_whole_texts(spark):
    w = small_words(spark, {"x": 30, "y": 10})
    reader = language_model.Reader(w, ([b"x"], np.array([30.0])), language_model.VOCABULARY)
    before = initial(w.share)
    got = list(language_model.local_steps(iter([(0, b"x y " * 10_000), (0, b"x " * 200), (0, None)]), before, reader))
    assert {w for *_, w in got} == {20_000 + 200 + 3} and [v for _, v, _ in got] != language_model.flat(before).tolist()


def test_language_model_learns_from_every_id(spark):
    """Not from words' first ids only: what attention knows of the ids after them changes, and each counts as often as it stands."""
    counts = {"theory": 30, "unbelievable": 10}
    w = small_words(spark, counts)
    sub = language_model.subwords(language_model.VOCABULARY)
    each = {k: sub.encode([k.encode()])[0].tolist() for k in counts}
    ids = {i for e in each.values() for i in e}
    assert len(ids) > len(each) and (w.symbol[sorted(ids)] >= 0).all() and len(w.share) == len(ids) + 3
    reader = language_model.Reader(w, ([b"theory"], np.array([30.0])), language_model.VOCABULARY)
    tokens = b"theory unbelievable theory other".split()
    got, first, at, rare = reader.read(tokens)
    assert got.tolist() == [i for t in tokens for i in sub.encode([t])[0].tolist()] and at.tolist() == [0, -1, 0, -1] and rare.tolist() == [1, 3]
    assert first.tolist() == np.cumsum([0, *[len(sub.encode([t])[0]) for t in tokens]]).tolist()
    before = initial(w.share)
    values = [v for _, v, _ in language_model.local_steps(iter([(0, b"theory unbelievable " * 20_000)]), before, reader)]
    after = language_model.shaped(np.array(values) / 40_001, before)
    seen = after["stats"].sum(1) / after["stats"].sum()
    total = sum(map(len, each.values()))
    assert all(abs(seen[w.symbol[i]] - sum(e.count(i) for e in each.values()) / total) < 0.02 for i in ids)


def test_language_model_score_by_hand(spark):
    """Each id by the model's own log probabilities, position by position."""
    w = small_words(spark, {"theory": 30, "unbelievable": 10, "the": 7})
    reader = language_model.Reader(w, ([b"theory", b"the"], np.array([30.0, 7.0])), language_model.VOCABULARY)
    model = Attention(initial(w.share, 3))
    texts = [b"theory unbelievable the zebra", b"", b"the " * 70 + b"unbelievably", b"theory"]
    words = [t.split() for t in texts]
    ids, first, *_ = reader.read([x for t in words for x in t])
    begun, rest, ended = language_model.attended(reader, model, ids, first, np.cumsum([len(t) for t in words]))
    sub, k = reader.sub, 0
    for t, text in enumerate(words):
        each = [sub.encode([x])[0].tolist() for x in text]
        x, y = model.windows([reader.symbol[[i for e in each for i in e]].astype(np.int32)])
        likely = np.stack([np.exp(model.log_probs(x, np.where(y >= 0, s, -1)).ravel().astype(float)) for s in range(model.n)])  # of every symbol at each position
        stops = likely[w.begins].sum(0)
        n = sum(map(len, each))
        assert np.allclose(likely.sum(0)[: n + 1], 1, atol=1e-4)
        at = 0
        for e in each:
            assert abs(begun[k] - np.log10(likely[reader.symbol[e[0]], at] / stops[at])) < 1e-4
            want = w.left[e[0]]
            for i, j in zip(e, [*e[1:], sub.STOP], strict=True):
                at += 1
                p = stops[at] if j == sub.STOP else likely[reader.symbol[j], at] * (w.unseen if w.symbol[j] < 0 else 1)
                want += np.log10(language_model.ATTENDED * p + (1 - language_model.ATTENDED) * 10.0 ** float(w.chain[i, j]))
            assert abs(rest[k] - want) < 1e-3
            k += 1
        assert at == n and abs(ended[t] - np.log10(likely[-1, n] / stops[n])) < 1e-4


def test_language_model_beats_the_base_on_held_out_texts(spark):
    got = language_model.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_language_model_of_odd_rows(spark, odd):
    got = language_model.scored(odd)
    assert got.count() == len(ODD) and {r.n_tokens for r in got.where("doc_id in (1, 2, 3)").collect()} == {1}
    assert language_model.scored(odd.where("false")).count() == 0


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    q = quality_model.scored(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert sum(r[0] == r[1] for r in q) / len(q) > 0.95
    t = toxicity.scored(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    assert sum(r[0] == r[1] for r in t) / len(t) > 0.94 and not any(r[0] and not r[1] for r in t)


def test_classifiers_of_odd_rows(spark, odd, labels):
    for part in (labels, labels.where("false")):
        for f in (quality_model.scored, toxicity.scored):
            got = f(odd, part).collect()
            assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
            assert f(odd.where("false"), part).count() == 0


def test_grammar_composes():
    g = toxicity.Grammar({"idiot$": 3.0, "fool$": 2.0})
    made = lambda t: [(m, w) for m, w, _ in g.outputs(t)[0]]
    assert made("what an idiot.") == [("I", 3.0)] and made("you idiot.") == [("aI", 3.0)]
    assert made("fool, idiot, you, you") == [("I", 2.0), ("I", 3.0), ("lI", 3.0)]
    assert made("you are not an idiot.") == [("nI", 3.0)] and made("not one two three idiot") == [("I", 3.0)]
    assert made("he said idiot. idiot") == [("rI", 3.0), ("I", 3.0)]
    assert made("i will kill them") == [("T", 1.0), ("lT", 1.0)] and made("never kill") == [("nT", 1.0)] and made("they said kill. them") == [("rT", 1.0)]
    assert made("you.\nidiot") == [("I", 3.0)] == made("you. idiot") and made(None) == []
    assert g.outputs("a b. c d\ne")[1] == 3
    plain, neg, said = (g.features(t) for t in ("you idiot.", "you are not an idiot.", "he said you idiot."))
    assert plain[0] > 0 == neg[0] == said[0] and plain[5] > 0 == neg[5] and neg[6] > 0 == plain[6] and said[7] > 0


def test_composed_grammar_equals_its_transducers_in_turn():
    r = np.random.default_rng(4)
    parts = [toxicity.negation(), toxicity.reported(), toxicity.insulted(), toxicity.threatened()]
    for _ in range(200):
        text = r.choice(list("ITGNRoC"), 30)
        states, state = [0] * len(parts), 0
        for symbol in text:
            out = symbol
            for i, part in enumerate(parts):
                states[i], out = part.step(states[i], out)
            state, made = toxicity.GRAMMAR.table[state][symbol]
            assert made == out


def test_mixing_meets_targets(spark, odd, labels):
    sf = "/root/testdata/sf0.01"
    docs, given = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = mixing.mixed(docs, given)
    names = list(mixing.TARGETS)
    got = m.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")) for d in names]).first()
    assert all(abs(g / sum(got) - mixing.TARGETS[d]) < 1e-3 for g, d in zip(got, names, strict=True))
    assert m.where("rate < 0 or abs(n_copies - rate) > 1").count() == 0
    assert mixing.mixed(odd.drop("rate"), labels).count() == len(ODD) and mixing.mixed(odd.where("false"), labels).count() == 0
    assert mixing.mixed(odd.drop("rate"), labels.where("false")).count() == len(ODD)


def posteriors(spark, rows):
    return spark.createDataFrame([(i, n, *p) for i, (n, p) in enumerate(rows)], "doc_id long, n_tokens long, p_en double, p_fr double, p_de double, p_es double")


def test_mixing_repeats_a_scarce_domain(spark):
    one = {"en": (1.0, 0.0, 0.0, 0.0), "fr": (0.0, 1.0, 0.0, 0.0), "de": (0.0, 0.0, 1.0, 0.0), "es": (0.0, 0.0, 0.0, 1.0)}
    m = posteriors(spark, [(100, one["en"])] * 5 + [(100, one["fr"])] * 60 + [(100, one["de"])] * 25 + [(100, one["es"])] * 10)
    gradients, got, _ = mixing.fit_rates(m, mixing.TARGETS)
    assert all(abs(got[d] / sum(got.values()) - t) < 1e-3 for d, t in mixing.TARGETS.items())
    assert m.select(mixing.rate(list(one), gradients).alias("r")).where("r < 1").count() == 0


def test_mixing_without_a_domain_keeps_the_others(spark):
    m = posteriors(spark, [(100, (0.0, 1.0, 0.0, 0.0))] * 8 + [(100, (0.0, 0.0, 1.0, 0.0))] * 8 + [(100, (0.0, 0.0, 0.0, 1.0))] * 4)
    with pytest.warns(UserWarning, match="misses its targets"):
        gradients, got, want = mixing.fit_rates(m, mixing.TARGETS)
    assert got["en"] == 0 < want["en"] and abs(got["fr"] - want["fr"]) < 1
    assert m.select(mixing.rate(list(mixing.TARGETS), gradients).alias("r")).where("r < 1").count() == 0


def test_mixing_without_labels_keeps_rates_at_one(spark, odd, labels):
    assert mixing.mixed(odd.drop("rate"), labels.where("false")).where("rate <> 1").count() == 0


def test_language_model_does_not_hang_on_partitions(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for chunk_tokens in (language_model.CHUNK_TOKENS, 50_000):  # one chunk a round, and several
        monkeypatch.setattr(language_model, "CHUNK_TOKENS", chunk_tokens)
        one, many = ({r.doc_id: r for r in language_model.scored(docs.repartition(n)).collect()} for n in (1, 32))
        assert max(abs(one[i].score - many[i].score) / max(1, one[i].n_tokens) for i in one) < 1e-3
        assert abs(sum(r.score for r in one.values()) / sum(r.score for r in many.values()) - 1) < 1e-5
        held = [r for r in many.values() if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_quality_without_difference_is_one_score():
    r = np.random.default_rng(8)
    x = np.array([[d, d * s] for d, s in zip(r.normal(size=200), r.uniform(0, 10, 200), strict=True)])
    model = quality_model.Model(b"", b"", quality_model.Logistic(x, (x[:, 0] > 0).astype(float)))  # equal dictionaries: no text has a difference
    score = model.scorer()
    assert len({score(t) for t in (None, b"", b"a few words", b"word " * 50_000)}) == 1
    by_hand = quality_model.Sizes(b"good words here " * 20, b"bad words there " * 20)
    text = b"good words here and there " * 30
    size = lambda c: sum(len(c.compress(text[i : i + quality_model.PIECE])) for i in range(0, len(text), quality_model.PIECE))
    assert by_hand.features(text)[0] == (size(by_hand.each[0]) - size(by_hand.each[1])) / len(text) > 0


@pytest.mark.parametrize("classes", [255, 2])
def test_scan_equals_all_windows(monkeypatch, classes):
    monkeypatch.setattr(decontaminate, "CLASSES", classes)  # with two classes of words nearly all that the automaton finds is wrong
    r = np.random.default_rng(9)
    text = lambda n, v: " ".join(f"w{x}" for x in r.integers(0, v, n))
    for size in (1, 2, 4, 13):
        items = [(int(r.integers(0, 12)), text(int(r.integers(0, 40)), int(r.choice([2, 60])))) for _ in range(20)]
        made = decontaminate.Tests([(i, t.encode()) for i, t in items], size)
        for _ in range(40):
            parts = [text(int(r.integers(0, 15)), 60)]
            for _ in range(3):
                words = items[int(r.integers(0, 20))][1].split()
                a = int(r.integers(0, len(words) + 1))
                parts += [" ".join(words[a : a + int(r.integers(0, 30))]), text(int(r.integers(0, 9)), 2)]
            doc = " ".join(parts).split()
            hit, found = set(), set()
            for item, t in items:
                w = t.split()
                n = min(size, len(w))
                for window in {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else ():
                    for i in range(len(doc) - n + 1):
                        if tuple(doc[i : i + n]) == window:
                            hit |= set(range(i, i + n))
                            found.add(item)
            n, runs, got = made.scan(" ".join(doc).upper().encode())
            assert n == len(doc) and {i for a, b in runs for i in range(a, b)} == hit and got == found
