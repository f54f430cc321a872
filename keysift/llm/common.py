"""Helpers shared by the training-data operators: the shared folder, written tables, tokens, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this package.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that all executors see, below ``spark.checkpoint.dir``.

    Only where the session names none (tests, local mode) a temporary one is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='keysift-')}"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/keysift-{uuid.uuid4().hex}"
    system, inner = open_fs(path)
    system.create_dir(inner, recursive=True)
    atexit.register(remove, path)
    return path


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def remove(uri: str) -> None:
    system, path = open_fs(uri)
    if system.get_file_info(path).type != pafs.FileType.NotFound:
        system.delete_dir(path)


def put(uri: str, data: bytes) -> None:
    """Writes a file under another name and then moves it, so that a repeated task leaves one whole file."""
    system, path = open_fs(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(aside, compression=None) as out:
        out.write(data)
    system.move(aside, path)


def written(df: DataFrame, folder: str, name: str, codec: str = "zstd") -> DataFrame:
    """Cuts the lineage by a table in the shared folder: it outlives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and binds it: a lambda over a one-element array."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; an empty array for null or blank texts. Lower-casing is left to the caller."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(links: DataFrame, folder: str, name: str = "cc") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``links`` has columns ``a`` and ``b`` of any one orderable type; rows with a null or with a = b are
    dropped. Returns ``id``, ``component`` (smallest id reachable) for every id that has a link. Each step
    groups with partial aggregation and joins back, so that a star around one hot node is never collected;
    every round is written to the shared folder. Rounds grow with the logarithm of the longest path.
    """
    spark = links.sparkSession
    edges = links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, folder, f"{name}-0")
    before, turn = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        turn += 1
        edges = written(small, folder, f"{name}-{turn}")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        state = (state["n"], state["h"])
        if state == before or not state[0]:
            break
        if turn > 1:
            remove(f"{folder}/{name}-{turn - 2}")
        before = state
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
