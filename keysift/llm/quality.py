"""Quality rules by host: failures counted per domain, rates shrunk with an empirical beta prior, verdicts joined back.

All in DataFrame functions. One narrow pass turns each text into a row of numbers, which is written once; only
those rows are shuffled. Counts per host are partial sums, so that a host with a third of all rows costs no more than
another; the join back is on the host with one row per host on the small side.

A host's rate is that of its documents failing any rule. The prior's mean and strength come from the hosts'
rates by the method of moments, and the host fails if its posterior mean, less one posterior deviation,
is over ``HOST_LIMIT``: a few bad documents never condemn a host, and clean documents of others stay.

A window of five words counts as repeated if its 64-bit digest occurs again in the text.

Defined results: null text has no words and fails; a null host is a host of its own; a null doc_id and repeated rows are
judged and counted each; ties don't arise, as every row has its own verdict; texts of any length are counted whole; an
empty table gives no row; other columns don't matter, whatever their names, and ``keep_good`` gives them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import SPACE, let, shared_dir, written

MIN_WORDS = 10
REPEAT_PERCENT = 20
SYMBOL_PERCENT = 10
DUP_LINE_PERCENT = 50
WINDOW = 5
HOST_LIMIT = 0.5
#: Hosts of at most this number are broadcast (about 50 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 200_000
RULES = ("few_words", "repeats", "symbols", "dup_lines")


def _repeat_words(digests: Column) -> Column:
    """Words covered by windows whose digest occurs twice or more; ``digests`` is per word."""
    size = F.size(digests)
    windows = F.transform(
        F.sequence(F.lit(1), size - WINDOW + 1),
        lambda i: F.xxhash64(*[F.element_at(digests, (i + k).cast("int")) for k in range(WINDOW)]),
    )

    def covered(hashes: Column) -> Column:
        sorted_pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(pairs: Column) -> Column:
            again = F.filter(pairs, lambda p, k: (F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"]))
            return F.array_sort(F.transform(again, lambda p: p["i"]))

        def union(at: Column) -> Column:
            gaps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)

        return let(let(sorted_pairs, positions), union)

    return F.when(size < WINDOW + 1, F.lit(0).cast("long")).otherwise(
        let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    )


def text_numbers(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of the contract and drops the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    split = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.ltrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    words = let(
        split,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _let_digests(w).alias("n_repeat_words"),
        ),
    )
    solid = F.length(F.regexp_replace(t, SPACE, "")).cast("long")
    symbols = (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long")
    dup = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return docs.select(*[c for c in docs.columns if c != text], words.alias("__w"), solid.alias("word_chars"), symbols.alias("n_symbols"), dup.alias("__l")).select(
        *[c for c in docs.columns if c != text], F.col("__w.n_words"), "word_chars", "n_symbols", F.col("__l.dup").alias("n_dup_lines"), F.col("__w.n_repeat_words"), F.col("__l.n").alias("n_lines")
    )


def _let_digests(words: Column) -> Column:
    return let(F.transform(words, lambda w: F.xxhash64(w)), _repeat_words)


def judge(docs: DataFrame, host: str = "source", text: str = "text", folder: str | None = None) -> DataFrame:
    """Per document its numbers, ``base_failed``, each rule, the host's shrunk rate and ``kept``. The numbers are written to ``folder``."""
    rows = _failures(docs.select("doc_id", F.col(host).alias("host"), F.col(text).alias("text")))
    folder = folder or shared_dir(docs.sparkSession)
    rows = written(rows, folder, "numbers")
    hosts = _spread(_hosts(rows), folder)
    return rows.join(hosts, F.expr("host <=> of_host")).withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("of_host")


def _spread(hosts: DataFrame, folder: str) -> DataFrame:
    """Verdicts by host, broadcast if their checked number allows: a host with a third of all rows then stays where it is."""
    hosts = written(hosts, folder, "hosts")
    return F.broadcast(hosts) if hosts.count() <= BROADCAST_ROWS else hosts


def _failures(docs: DataFrame) -> DataFrame:
    """Adds the numbers of ``text``, each rule and ``base_failed``; drops the text."""
    rows = text_numbers(docs)
    rules = {
        "few_words": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars"),
        "dup_lines": 100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines"),
    }
    return rows.withColumns(rules).withColumn("base_failed", F.col("few_words") | F.col("repeats"))


def _hosts(rows: DataFrame) -> DataFrame:
    failed = F.greatest(*[F.col(r).cast("int") for r in RULES])
    return host_rates(rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(failed).alias("failed"), *[F.sum(F.col(r).cast("int")).alias(f"host_{r}") for r in RULES]))


def host_rates(hosts: DataFrame) -> DataFrame:
    """Shrinks ``failed``/``n`` by host. With mean m and variance v of the rates, the prior's strength is m(1-m)/v - 1,
    kept within [1, 1000]; without spread (one host, equal rates) it is 1000."""
    rate = F.col("failed") / F.col("n")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"))
    strength = F.when(F.coalesce(F.col("v"), F.lit(0.0)) <= 0, F.lit(1000.0)).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)))
    prior = moments.select((F.col("m") * strength).alias("a"), ((1 - F.col("m")) * strength).alias("b"))
    # One row of two numbers.
    both = hosts.join(F.broadcast(prior))
    a, b = F.col("a") + F.col("failed"), F.col("b") + F.col("n") - F.col("failed")
    mean = a / (a + b)
    both = both.withColumn("host_rate", mean).withColumn("host_failed", mean - F.sqrt(mean * (1 - mean) / (a + b + 1)) > HOST_LIMIT)
    return both.drop("a", "b").withColumnRenamed("host", "of_host")


def keep_good(docs: DataFrame, host: str = "source", folder: str | None = None) -> DataFrame:
    """The documents that are kept, with their columns. Each row has its own verdict and is written along with it, so that
    null and repeated ids don't matter and no text is looked at twice or shuffled."""
    rows = _failures(docs.select(F.struct(*docs.columns).alias("__row"), F.col(host).alias("host"), "text"))
    folder = folder or shared_dir(docs.sparkSession)
    rows = written(rows, folder, "judged")
    bad = _spread(_hosts(rows).where("host_failed").select("of_host"), folder)
    return rows.where(~F.col("base_failed")).join(bad, F.expr("host <=> of_host"), "left_anti").select("__row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), win AS (
  SELECT doc_id, i, list_aggregate(list_slice(ws, i, i + 4), 'string_agg', ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
), again AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS r FROM again GROUP BY doc_id
), num AS (
  SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         (100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 50 * n_lines) AS other FROM num
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed OR other) AS f FROM b GROUP BY source
), m AS (
  SELECT avg(f / n) AS m, coalesce(var_samp(f / n), 0) AS v FROM h
), prior AS (
  SELECT m, CASE WHEN v <= 0 THEN 1000 ELSE greatest(1, least(1000, m * (1 - m) / v - 1)) END AS k FROM m
), post AS (
  SELECT source, m * k + f AS a, (1 - m) * k + n - f AS b FROM h, prior
), bad AS (
  SELECT source, a / (a + b) - sqrt(a / (a + b) * (b / (a + b)) / (a + b + 1)) > 0.5 AS host_failed FROM post
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept
FROM b JOIN bad ON b.source IS NOT DISTINCT FROM bad.source
"""
