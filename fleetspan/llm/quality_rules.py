"""Quality rules with host verdicts, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.llm.common import discard, hot_join, saved, table

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words of a window that counts as repeated text.
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEAT_PERCENT = 30
#: Rules beside the base ones; they count against the host only.
MOST_SYMBOLS_A_WORD = 0.5
MOST_DUP_LINES = 0.3
WORD_CHARS = (2, 30)
#: A host whose shrunken failure rate is above this is rejected.
MOST_HOST_RATE = 0.5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once; a plain reference inside a lambda would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words inside windows of `size` words that occur twice or more in the array, the first one included.

    Windows are compared by 64-bit hash. Sorted (hash, place) pairs bring equal windows together, so the cost is n log n a text.
    """

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).cast("long").alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(size).cast("long"), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    def of_sorted(s: Column) -> Column:
        n = F.size(s)
        same = F.zip_with(F.slice(s, F.lit(1), n - 1), F.slice(s, F.lit(2), n - 1), lambda a, b: a["h"] == b["h"])
        return let(same, lambda e: covered(F.array_sort(F.filter(F.zip_with(F.zip_with(F.concat(F.array(F.lit(False)), e), F.concat(e, F.array(F.lit(False))), lambda x, y: x | y), s, lambda d, x: F.when(d, x["p"])), lambda p: p.isNotNull()))))

    def of_windows(win: Column) -> Column:
        ordered = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("p"))))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(let(ordered, of_sorted))

    def of_hashes(h: Column) -> Column:
        n = F.size(h)
        return F.when(n < size + 1, F.lit(0).cast("long")).otherwise(let(F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(size)))), of_windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source and the rules' measures of each document row; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    by_words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    out = docs.select(
        "doc_id",
        "source",
        by_words.alias("m"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
        F.size(F.split(text, "\n")).alias("n_lines"),
    )
    return out.select("doc_id", "source", "m.n_words", "word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))


def any_failed() -> Column:
    chars = F.try_divide("word_chars", "n_words")
    return base_failed() | (F.col("n_symbols") > MOST_SYMBOLS_A_WORD * F.col("n_words")) | (F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines")) | ~chars.between(*WORD_CHARS)


def host_verdicts(rows: DataFrame) -> DataFrame:
    """source, n_docs, n_failed, rate (shrunken), host_failed. The beta prior is fitted to the hosts' raw rates by moments.

    With mean m and variance v of the rates, its strength is m(1-m)/v - 1, at least 1; with one host, or rates all alike, 100 documents' worth.
    """
    hosts = rows.where("source is not null").groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(any_failed()).alias("n_failed"))
    prior = hosts.agg(F.avg(F.col("n_failed") / F.col("n_docs")).alias("m"), F.var_samp(F.col("n_failed") / F.col("n_docs")).alias("v"))
    strength = F.when(F.col("v") > 0, F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).otherwise(100.0)
    hosts = hosts.crossJoin(F.broadcast(prior.select("m", strength.alias("k"))))  # one row of two numbers
    rate = (F.col("n_failed") + F.col("m") * F.col("k")) / (F.col("n_docs") + F.col("k"))
    return hosts.select("source", "n_docs", "n_failed", rate.alias("rate"), (rate > MOST_HOST_RATE).alias("host_failed"))


def judged(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, the measures, base_failed, kept.

    kept is false if the base rules fail or the host's shrunken failure rate is above MOST_HOST_RATE. A null text has no words and fails; a null source
    has no host and so no host verdict; null or repeated doc_ids are rows like others; an empty table gives no rows; other columns are not read.
    """
    rows = saved(measured(docs), "quality-rules")
    hosts = saved(host_verdicts(rows), "quality-hosts")
    total = rows.count()
    out = hot_join(rows, hosts.select("source", "n_docs", "host_failed"), ["source"], "n_docs", total, "left")
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = """
WITH texts AS (
  SELECT doc_id, source, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines,
         list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS words
  FROM documents
), windows AS (
  SELECT doc_id, i AS pos, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM texts)
), twice AS (
  SELECT doc_id, pos FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), steps AS (
  SELECT doc_id, least(8, pos - coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), pos - 8)) AS n FROM twice
), repeats AS (
  SELECT doc_id, sum(n) AS n FROM steps GROUP BY doc_id
), dup AS (
  SELECT doc_id, sum(n - 1) AS n FROM (
    SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(lines) AS line FROM texts)
    WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY doc_id, line) GROUP BY doc_id
), measures AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
  FROM texts LEFT JOIN dup USING (doc_id) LEFT JOIN repeats USING (doc_id)
), base AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measures
), failed AS (
  SELECT *, base_failed OR n_symbols > 0.5 * n_words OR n_dup_lines > 0.3 * n_lines OR word_chars / n_words NOT BETWEEN 2 AND 30 AS failed FROM base
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (failed) AS f FROM failed WHERE source IS NOT NULL GROUP BY source
), prior AS (
  SELECT m, CASE WHEN v > 0 THEN greatest(1.0, least(1e6, m * (1 - m) / v - 1)) ELSE 100.0 END AS k
  FROM (SELECT avg(f / n) AS m, var_samp(f / n) AS v FROM hosts)
), verdicts AS (
  SELECT source, (f + m * k) / (n + k) > 0.5 AS host_failed FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(host_failed, false) AS kept
FROM failed LEFT JOIN verdicts USING (source)
"""
