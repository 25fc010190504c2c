"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.llm.common import map_rows, table
from fleetspan.llm.logistic import Logistic

# Words of the transducers' classes in English, French, German and Spanish. Insults are learned beside these.
INSULTS = "idiot moron scum trash loser clown stupid pathetic worthless disgusting imbecile dumb crétin débile connard idiota estúpido imbécil idioten dumm dummkopf".split()
THREATS = "kill hurt destroy murder burn shoot stab beat tuer frapper détruire töten schlagen vernichten matar golpear destruir".split()
TARGETS = "you your you're he she they him her them tu vous toi lui elle du dich ihr euch er sie ihn tú usted ustedes ellos".split()
NEGATIONS = "not no never isn't aren't don't won't jamais nicht kein keine nie nunca jamás".split()
REPORTS = "said says say told quoted claimed called wrote dit disait sagte sagt dijo dice".split()

#: Rows whose crc32(doc_id as text) mod FOLDS is HELD_OUT are never learned from; of the others at most SAMPLE labelled rows of the smallest hashes are.
FOLDS, HELD_OUT, SAMPLE = 5, 0, 8000
#: Stems that the insult transducer learns at most, their lengths, and the toxic texts that must hold one at least.
STEMS, STEM_CHARS, LEAST_TEXTS = 2000, (4, 9), 4
#: Counts that a task keeps before it hands them on.
COUNTS = 300_000
#: Words after a negation that it still reaches.
REACH = 3
EDGE = ".,!?;:#$%&*|\"'()[]{}«»„“”…-"
STOPS = (".", "!", "?", ";", ":", "|")


def bare(word: str) -> str:
    return word.strip(EDGE)


def stems(word: str) -> list[str]:
    """The word's beginnings, and the whole word marked by $."""
    low, high = STEM_CHARS
    return [word[:k] for k in range(low, min(len(word), high) + 1)] + ([word + "$"] if len(word) > 2 else [])


#: What the lexicon makes of words: insult, threat, target, negation, verb of saying, any other word, and the end of a clause.
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, END = "ITGNRoC"
#: What the grammar makes of insults and threats: as they stand, aimed at a target before, aimed by a target after, under a negation, in reported speech.
AIMED, LATE, NEGATED, REPORTED = "a", "l", "n", "r"


class Transducer:
    """moves: (state, symbol) -> (state, symbol put out); any other symbol comes out as it is and leads to fall[state], or stays. The first state is 0; END leads to it."""

    def __init__(self, moves: dict[tuple, tuple], fall: dict | None = None):
        self.moves, self.fall = moves, fall or {}

    def step(self, state, symbol: str) -> tuple:
        if symbol == END:
            return 0, END
        return self.moves.get((state, symbol)) or (self.fall.get(state, state), symbol)


class Composed:
    """One machine that does what the transducers do one after the other: each reads what the one before puts out. All its moves are in a table."""

    def __init__(self, *parts: Transducer, alphabet: str = INSULT + THREAT + TARGET + NEGATION + REPORT + OTHER + END):
        start = tuple(0 for _ in parts)
        number, self.table, todo = {start: 0}, [], [start]
        while todo:
            state, row = todo.pop(0), {}
            for symbol in alphabet:
                out, after = symbol, []
                for part, s in zip(parts, state, strict=True):
                    s, out = part.step(s, out)
                    after.append(s)
                if (to := tuple(after)) not in number:
                    number[to] = len(number)
                    todo.append(to)
                row[symbol] = (number[to], out)
            self.table.append(row)


def negation() -> Transducer:
    """Insults and threats up to REACH words after a negation come out as negated."""
    near = range(1, REACH + 1)
    moves = {(s, NEGATION): (REACH, NEGATION) for s in range(REACH + 1)}
    moves |= {(s, x): (s - 1, NEGATED + x) for s in near for x in (INSULT, THREAT)}
    return Transducer(moves, {s: s - 1 for s in near})


def reported() -> Transducer:
    """After a verb of saying, to the clause's end, insults and threats come out as reported."""
    return Transducer({(0, REPORT): (1, REPORT)} | {(1, x): (1, REPORTED + x) for x in (INSULT, THREAT)})


def insulted() -> Transducer:
    """An insult after a target comes out as aimed; the first target after insults without one comes out as aiming the last of them."""
    return Transducer({(0, TARGET): (1, TARGET), (0, INSULT): (2, INSULT), (1, INSULT): (1, AIMED + INSULT), (2, TARGET): (1, LATE + INSULT)})


def threatened() -> Transducer:
    """A target after a threat comes out as threatened, whether it aims an insult or not."""
    return Transducer({(0, THREAT): (1, THREAT), (1, TARGET): (0, LATE + THREAT), (1, LATE + INSULT): (0, LATE + INSULT)})


#: Negation, then reported speech, then insults and threats with their targets.
GRAMMAR = Composed(negation(), reported(), insulted(), threatened())


class Grammar:
    """The composed grammar behind a lexicon of insult stems with weights."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.classes = {w: c for c, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in ws}
        self.known: dict[str, tuple | None] = {}

    def read(self, raw: str) -> tuple | None:
        """Symbol of a word as it stands in the text, its weight, and whether a clause ends there; None if it is any other word inside a clause."""
        word = bare(raw)
        weight = max((self.weights[s] for s in stems(word) if s in self.weights), default=0.0)
        symbol, ends = INSULT if weight else self.classes.get(word, OTHER), raw.endswith(STOPS)
        got = (symbol, weight, ends) if ends or symbol != OTHER else None
        if len(self.known) > COUNTS:
            self.known.clear()
        self.known[raw] = got
        return got

    def outputs(self, text: str | None) -> tuple[list[tuple[str, float, int]], int]:
        """What the grammar puts out of insults and threats, with its weight (of an insult aimed late, that insult's) and its clause's number; and the number of clauses."""
        out, clause, table, known, read = [], 0, GRAMMAR.table, self.known, self.read
        for line in (text or "").lower().split("\n"):
            state, last, after = 0, 0.0, -1
            for at, raw in enumerate(words := line.split()):
                got = known[raw] if raw in known else read(raw)
                if got is None:
                    continue
                symbol, weight, ends = got
                for _ in range(min(at - after - 1, REACH)):  # beyond that, other words change nothing
                    state = table[state][OTHER][0]
                after = at
                state, made = table[state][symbol]
                if made[-1] in (INSULT, THREAT):
                    if symbol == INSULT:
                        last = weight
                    out.append((made, weight if symbol == INSULT else last if made[-1] == INSULT else 1.0, clause))
                if ends:
                    state, clause = 0, clause + 1
            if words and after < len(words) - 1 or words and state:
                clause += 1
        return out, max(clause, 1)

    def features(self, text: str | None) -> list[float]:
        """Of clauses: weight of insults that stand, the largest, their clauses, also by all clauses; weight that is aimed, negated, reported; threats, those at a target, those negated or reported."""
        out, clauses = self.outputs(text)
        by: dict[str, float] = {}
        for made, weight, _ in out:
            by[made] = by.get(made, 0.0) + weight
        get = lambda *made: sum(by.get(m, 0.0) for m in made)
        stand = [(w, c) for m, w, c in out if m in (INSULT, AIMED + INSULT)]
        standing, hit = sum(w for w, _ in stand), len({c for _, c in stand})
        return [
            math.log1p(standing), max((w for w, _ in stand), default=0.0), math.log1p(hit), standing / math.sqrt(clauses), hit / clauses,
            *(math.log1p(x) for x in (get(AIMED + INSULT, LATE + INSULT), get(NEGATED + INSULT), get(REPORTED + INSULT), get(THREAT), get(LATE + THREAT), get(NEGATED + THREAT, REPORTED + THREAT))),
        ]


class Model:
    """With labels of one kind only, every score is n1 / (n + 1)."""

    def __init__(self, weights: dict[str, float], calibration: Logistic | None, constant: float = 0.0):
        self.weights, self.calibration, self.constant = weights, calibration, constant


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def stem_counts(sample: DataFrame) -> DataFrame:
    """stem, n0, n1: labelled texts of either kind that hold it."""

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        counts: Counter = Counter()
        for toxic, text in it:
            words = {bare(w) for w in (text or b"").decode("utf-8", "replace").lower().split()}
            counts.update((s, toxic) for s in {s for w in words for s in stems(w)})
            if len(counts) > COUNTS:
                yield from ((s, n if not t else 0, n if t else 0) for (s, t), n in counts.items())
                counts.clear()
        yield from ((s, n if not t else 0, n if t else 0) for (s, t), n in counts.items())

    return map_rows(sample, "stem string, n0 long, n1 long", rows).groupBy("stem").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Learns insult stems and the clause weights from at most `most` labelled rows outside the held-out fold."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64(F.lit("toxic"), F.col("doc_id")), "doc_id").limit(most)
    sample = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("toxic", "text")
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    given = {w + "$": 3.0 for w in INSULTS}
    if not n0 or not n1:
        return Model(given, None, n1 / (n0 + n1 + 1))
    a, b = F.col("n1") + 0.5, F.col("n0") + 0.5
    odds, error = F.log(a / (n1 + 1)) - F.log(b / (n0 + 1)), F.sqrt(1 / a + 1 / b)
    learned = stem_counts(sample).where(F.col("n1") >= LEAST_TEXTS).withColumn("weight", odds - error).where(odds - 2 * error > 1.2)
    weights = given | {r[0]: r[1] for r in learned.orderBy(F.desc("weight"), "stem").limit(STEMS).select("stem", "weight").collect()}

    def measure(it: Iterator[tuple]) -> Iterator[tuple]:
        grammar = Grammar(weights)
        for toxic, text in it:
            yield toxic, grammar.features(None if text is None else text.decode("utf-8", "replace"))

    got = sorted((r[0], tuple(r[1])) for r in map_rows(sample, "toxic int, x array<double>", measure).collect())
    return Model(weights, Logistic(np.array([r[1] for r in got]), np.array([r[0] for r in got], float)))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted.

    A null text is empty and has no matches. A null doc_id isn't held out and never learned from; labels other than 0 and 1 are skipped, of repeated labels the largest
    counts. Only doc_id and text are read of documents; an empty table gives no rows.
    """
    model = fit(docs, labels)

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        grammar = Grammar(model.weights)
        for doc, text in it:
            s = model.constant
            if model.calibration is not None:
                s = float(model.calibration.score(np.array([grammar.features(None if text is None else text.decode("utf-8", "replace"))]))[0])
            yield doc, s, int(s >= 0.5)

    out = map_rows(docs.select("doc_id", "text"), "doc_id long, score double, predicted int", rows)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
