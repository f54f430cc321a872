"""Version history as tables: commits, changes and blobs to findings with provenance and ``in_head``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysift.functions import text as T
from keysift.operators.detect import Options, detect, file_context
from keysift.plans.catalogue import RULES, Rule

SNIFF = 512


def visited(commits: DataFrame, since: Column | None = None, stop: str | None = None, most: int | None = None) -> DataFrame:
    """Commits (``hash``, ``committed``), each once: from ``since`` on, newer than the commit ``stop``, the newest ``most``."""
    rows = commits.dropDuplicates(["hash"])
    if since is not None:
        rows = rows.where(F.col("committed") >= since)
    if stop is not None:
        bound = commits.where(F.col("hash") == stop).agg(F.max("committed").alias("bound"))
        rows = rows.join(F.broadcast(bound)).where("bound is null or committed > bound").drop("bound")
    if most is not None:
        rows = rows.orderBy(F.desc("committed"), "hash").limit(most)
    return rows


def blob_sites(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Per blob the path and commit that had it first; of equal times the commit with the greatest hash, which newest-first order meets first."""
    sites = changes.withColumnRenamed("commit", "hash").join(commits, "hash")
    first = Window.partitionBy("blob_hash").orderBy("committed", F.desc("hash"), "path")
    return sites.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def counts(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: distinct commits, and distinct blobs that their changes bring."""
    blobs = changes.withColumnRenamed("commit", "hash").join(commits.select("hash").distinct(), "hash", "left_semi").agg(F.count_distinct("blob_hash").alias("blobs"))
    # One row each.
    return commits.agg(F.count_distinct("hash").alias("commits")).join(F.broadcast(blobs))


def texts(blobs: DataFrame, max_size: int = 1 << 20) -> DataFrame:
    """``content`` of blobs within the size that show no NUL in their head."""
    raw = F.col("content").cast("binary")
    clean = ~F.hex(F.substring(raw, 1, SNIFF)).rlike(r"\A(?:..)*00")
    return blobs.where((F.octet_length(raw) <= max_size) & clean).withColumn("content", T.valid(raw))


def scan(commits: DataFrame, changes: DataFrame, blobs: DataFrame, head: DataFrame, rules: Iterable[Rule] = RULES, options: Options = Options(), max_size: int = 1 << 20) -> DataFrame:
    """Findings of every distinct blob once, at its earliest site, with ``commit``, ``author``, ``date``, ``in_head``."""
    rules = list(rules)
    sites = blob_sites(commits, changes)
    extra = ["commit", "author", "author_email", "date"]
    readable = texts(blobs, max_size)
    files = sites.join(readable, "blob_hash").select("path", "content", F.col("hash").alias("commit"), "author", "author_email", F.date_format("authored", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    found = detect(file_context(files, header_lines=None, head_bytes=SNIFF), rules, options, extra)
    now = detect(file_context(head.join(readable, "blob_hash").select("path", "content"), header_lines=None, head_bytes=SNIFF), rules, options)
    return mark(found, now)


def mark(found: DataFrame, now: DataFrame) -> DataFrame:
    """``in_head``: whether the secret is among those of the head; fingerprints take the commit in."""
    still = now.select("secret_hash").distinct().withColumn("in_head", F.lit(True))
    site = F.concat("path", F.lit("@"), F.substring("commit", 1, 12))
    return found.join(still, "secret_hash", "left").withColumn("in_head", F.coalesce("in_head", F.lit(False))).withColumn("fingerprint", T.fingerprint(F.col("rule_id"), site, F.col("secret"))).select(*found.columns, "in_head")


def live(findings: DataFrame) -> DataFrame:
    """Findings whose secret is still in the head."""
    return findings.where("in_head")


def by_date(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc("date"), "path", "line")
