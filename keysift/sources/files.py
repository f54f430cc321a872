"""Sources of texts: file trees, tables, explicit paths; filters before content is read where they can be."""

from __future__ import annotations

import re
from collections.abc import Iterable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.functions.text import valid
from keysift.operators.allow import segment_pattern

MAX_SIZE = 1 << 20
HEAD = 8192
SKIPPED = r"(^|/)\.(git|hg|svn|bzr)/"
INTERESTING = r"\A(?:\.env.*|\.(?:npmrc|pypirc|netrc|dockercfg|htpasswd|pgpass|my\.cnf))\z"


def shown(path: Column, hidden: bool = False) -> Column:
    """Whether a walk reaches a file: no version-control folder, and no dot folder or dull dot file unless ``hidden``."""
    base = F.regexp_extract(path, r"[^/]*\z", 0)
    out = ~path.rlike(SKIPPED)
    return out if hidden else out & ~path.rlike(r"(^|/)\.[^/]+/") & (~base.startswith(".") | base.rlike(INTERESTING))


def is_binary(content: Column, head: int = HEAD) -> Column:
    return F.hex(F.substring(content, 1, head)).rlike(r"\A(?:..)*?00")


def ignore_rules(texts: Iterable[tuple[str, str]]) -> list[tuple[str, bool]]:
    """From (folder, text) of ignore files, shallow ones first, to (pattern, ignored): the last that fits decides."""
    out = []
    for folder, text in texts:
        prefix = re.escape(folder.strip("/") + "/") if folder.strip("/") else ""
        for line in text.splitlines():
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            ignored = not line.startswith("!")
            line = line.removeprefix("!")
            only_dir, rooted = line.endswith("/"), "/" in line.rstrip("/")
            parts = [p for p in line.strip("/").split("/") if p]
            body = "/".join("\0" if p == "**" else segment_pattern(p) for p in parts)
            body = re.sub("^\0/", "(?:.*/)?", body).replace("/\0/", "/(?:.*/)?").replace("/\0", "/.*").replace("\0", ".*")
            out.append((rf"(?s)\A{prefix}{'' if rooted else '(?:.*/)?'}{body}{'/.*' if only_dir else '(?:/.*)?'}\z", ignored))
    return out


def is_ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that fits a file ignores it, or ignores a folder above it: nothing brings back a file in there."""
    if not rules:
        return F.lit(False)

    def last(at: Column, folder: bool) -> Column:
        out = F.lit(False)
        for pattern, ignored in rules:
            only = not pattern.endswith(r"(?:/.*)?\z")
            out = F.when((F.concat(at, F.lit("/")) if only and folder else at).rlike(pattern), F.lit(ignored)).otherwise(out)
        return out

    parts = F.split(path, "/", -1)
    above = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))
    return last(path, False) | F.exists(above, lambda x: last(x, True))


#: Bytes of files that one task reads.
TASK_BYTES = 32 << 20


def _local(root: str) -> str | None:
    """The path of a root on a mounted file system; None for others."""
    scheme, _, rest = root.partition("://") if "://" in root else ("", "", root)
    if scheme in ("", "file"):
        return rest.removeprefix("file:") or "."
    return None


def read_files(listing: DataFrame, root: str, max_size: int, tasks: int) -> DataFrame:
    """``path``, ``content`` (bytes) of the regular files that ``listing`` (``path``) names below a mounted root, up to a size."""

    def read(batches):
        import os
        import stat

        import pyarrow as pa

        for batch in batches:
            names, found, held = [], [], 0
            for name in batch.column(0).to_pylist():
                try:
                    at = os.lstat(full := os.path.join(root, name))
                    if not stat.S_ISREG(at.st_mode) or at.st_size > max_size:
                        continue
                    with open(full, "rb") as f:
                        data = f.read()
                except OSError:
                    continue
                names.append(name)
                found.append(data)
                held += len(data)
                if held > TASK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.binary())], ["path", "content"])
                    names, found, held = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.binary())], ["path", "content"])

    return listing.select("path").repartition(tasks).mapInArrow(read, "path string, content binary")


def tree(
    spark: SparkSession, root: str, max_size: int = MAX_SIZE, hidden: bool = False, ignore: Iterable[tuple[str, str]] | None = None, skip: Column | None = None, paths: DataFrame | None = None, respect_ignore: bool = True,
) -> DataFrame:
    """``path`` (below ``root``), ``content`` of the files of a tree. Names and sizes are filtered before contents are read.

    The driver walks a mounted root; ``ignore``: (folder, text) of ignore files, else those found in the tree, none with
    ``respect_ignore`` off. ``paths``: only these, without the walk and its filters. ``skip``: a predicate on ``path``.
    Roots on other file systems are listed by Spark, which leaves out names that begin with a dot or underscore.
    """
    from keysift.sources import walk

    most, at = max_size if max_size > 0 else MAX_SIZE, _local(root)
    if at is None:
        return _listed_by_spark(spark, root, most, hidden, ignore or (), skip, paths)
    if paths is not None:
        listing, tasks = paths.select("path").distinct(), spark.sparkContext.defaultParallelism
    else:
        texts = list(ignore) if ignore is not None else walk.ignore_texts(at) if respect_ignore else []
        found = [(p, n) for p, n in walk.walk(at, hidden, walk.Ignore.of(texts)) if n <= most]
        listing = spark.createDataFrame(found, "path string, size long")
        tasks = max(1, -(-sum(n for _, n in found) // TASK_BYTES), min(len(found), spark.sparkContext.defaultParallelism))
    if skip is not None:
        listing = listing.where(~skip)
    return read_files(listing, at, most, tasks).where(~is_binary(F.col("content"))).select("path", valid(F.col("content")).alias("content"))


def _listed_by_spark(spark: SparkSession, root: str, max_size: int, hidden: bool, ignore: Iterable[tuple[str, str]], skip: Column | None, paths: DataFrame | None) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.regexp_replace(F.regexp_replace("path", r"\A\w+:/+", "/"), r"\A" + re.escape(str(PurePosixPath("/" + root.split(":", 1)[-1].lstrip("/")))) + "/", "")
    files = raw.where(F.col("length") <= max_size).select(at.alias("path"), "content", "length")
    if paths is not None:
        files = files.join(paths.select("path").distinct(), "path", "left_semi")
    else:
        files = files.where(shown(F.col("path"), hidden) & ~is_ignored(F.col("path"), ignore_rules(ignore)))
    if skip is not None:
        files = files.where(~skip)
    return files.where(~is_binary(F.col("content"))).select("path", valid(F.col("content")).alias("content"))


def stdin(spark: SparkSession, data: bytes, name: str = "<stdin>") -> DataFrame:
    """One text under a name, without checks of size or kind; a line of 1 MiB or more is an error, as nothing would be scanned."""
    if any(len(x) >= 1 << 20 for x in data.split(b"\n")):
        raise ValueError(f"{name}: a line is too long")
    rows = spark.createDataFrame([(name, bytearray(data))], "path string, content binary")
    return rows.select("path", valid(F.col("content")).alias("content"))


def dispositions(files: DataFrame, max_size: int = MAX_SIZE, skip: Column | None = None) -> DataFrame:
    """Counts of a scan: walked, scanned, skipped by reason, bytes scanned."""
    raw = F.encode(F.coalesce("content", F.lit("")), "UTF-8")
    state = F.when(skip if skip is not None else F.lit(False), "ignored").when(F.octet_length(raw) > max_size, "too_big").when(is_binary(raw), "binary").otherwise("scanned")
    rows = files.select(state.alias("state"), F.octet_length(raw).alias("size"))
    is_ = lambda s: F.col("state") == s
    return rows.agg(
        F.count("*").alias("walked"), F.count_if(is_("scanned")).alias("scanned"), F.count_if(~is_("scanned")).alias("skipped"), F.count_if(is_("binary")).alias("binary"),
        F.count_if(is_("too_big")).alias("too_big"), F.count_if(is_("ignored")).alias("ignored"), F.coalesce(F.sum(F.when(is_("scanned"), F.col("size"))), F.lit(0)).cast("long").alias("bytes"),
    )


#: Bytes of a table, by the optimizer's estimate, that one task scans. An estimate of UNKNOWN or more is none.
SCAN_BYTES, UNKNOWN = 8 << 20, 1 << 44


def spread(texts: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Rows dealt out over tasks of ``SCAN_BYTES``, two for each core at least. ``like``: whose size counts, if not that of the rows.

    Patterns take far longer than reading, and a table as it lies is cut at its row groups and by the cores: a task would grow with it.
    """
    sized = texts if like is None else like
    held = int(str(sized._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if held >= UNKNOWN:
        return texts
    return texts.repartition(max(2 * texts.sparkSession.sparkContext.defaultParallelism, -(-held // SCAN_BYTES)))


def documents(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", "text")
    return (spread(rows) if dealt else rows).select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
