"""Near copies among documents: one row stays of each component of documents at Jaccard ``SIMILAR`` or more.

1. A text is the set of its shingles of ``SHINGLE`` words (ASCII lower case), known by 64-bit digests; a text of
   fewer words is one shingle. Rows with equal sets are one class, and its first row stands for it.
2. SimHash: a set's fingerprint has the bits that over half of its digests have. Fingerprints of at most four
   differing bits meet at their anchors, exactly (``simhash``); those that such steps join are one bucket.
3. MinHash, for similar sets whose fingerprints are further apart (at 0.8 most are): ``BANDS`` bands of ``ROWS``
   minima are buckets too. A pair at similarity 0.8 shares a band with probability above 0.999.
4. In each bucket every document is compared with the bucket's first. Where that leaves a bucket in several
   components, every document outside its largest component is compared with all of other components there.
   Two documents left uncompared are thus in one component already, and no bucket is expanded into all pairs.
5. Every candidate is verified by its exact Jaccard similarity before it becomes a link; then distributed union-find.

Rows are known by a written row key, so that null and repeated ids take part: of each component the row with the
smallest id stays (rows without an id come last; of equal ids the first row). Null and blank texts are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.llm.common import components, written
from keysift.llm.simhash import link_fingerprints, majority

SHINGLE = 5
#: Similarity as a fraction, so that the comparison is exact.
SIMILAR = (4, 5)
BANDS, ROWS = 20, 5
CHUNK = 1 << 12
_RNG = np.random.default_rng(17)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, "u8")[:, None] * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, "u8")[:, None]


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct digests of a text's shingles; none for null and blank texts."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts[:n].tolist(), last)], "<u8"))


def band_keys(digests: np.ndarray) -> np.ndarray:
    """A digest per band of the minima of a set; none for the empty set."""
    if not len(digests):
        return np.zeros(0, "<i8")
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(digests), CHUNK):
        np.minimum(least, (digests[None, at : at + CHUNK] * _TIMES + _PLUS).min(1), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), b) for b, x in enumerate(least.reshape(BANDS, ROWS))], "<u8").view("<i8")


def similar(p: np.ndarray, q: np.ndarray) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both * SIMILAR[1] >= SIMILAR[0] * (len(p) + len(q) - both)


def signatures(keyed: DataFrame, bands: int = BANDS) -> DataFrame:
    """``row``, ``doc_id``, ``same`` (a digest of the whole set), ``fp`` (its fingerprint, null for the empty set) and
    ``keys`` (a digest for each of the first ``bands``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, fps, keys = [], [], []
            for t in batch.column(2):
                s = shingles(t.as_py())
                same.append(xxhash.xxh3_128_digest(s.tobytes()))
                fps.append(np.uint64(majority(s)).view("<i8") if len(s) else None)
                keys.append(band_keys(s)[:bands].tolist() if bands else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["row", "doc_id", "same", "fp", "keys"])

    return keyed.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "row long, doc_id long, same binary, fp long, keys array<long>")


def _verified(pairs: DataFrame, keyed: DataFrame, folder: str, name: str) -> DataFrame:
    """Of the pairs (a, b) of rows, those at exact Jaccard similarity of ``SIMILAR`` or more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, np.ndarray] = {}
            a, b, x, y = (batch.column(k) for k in range(4))
            ok = []
            for i in range(len(a)):
                for rows, texts in ((a, x), (b, y)):
                    if rows[i].as_py() not in held:
                        held[rows[i].as_py()] = shingles(texts[i].as_py())
                ok.append(similar(held[a[i].as_py()], held[b[i].as_py()]))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = written(pairs, folder, f"near-pairs-{name}")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    texts = written(keyed.select("row", "text").join(wanted, "row", "left_semi"), folder, f"near-texts-{name}")
    both = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("row").alias("b"), F.col("text").alias("y")), "b")
    return written(both.select("a", "b", "x", "y").mapInArrow(work, "a long, b long"), folder, f"near-links-{name}")


def near_fingerprints(heads: DataFrame, folder: str) -> DataFrame:
    """``row`` and ``key``: the component of its fingerprint (``fp``), of those that have others in it."""
    alike = heads.where("fp is not null").groupBy("fp").agg(F.count("*").alias("n"))
    classes = written(alike, folder, "near-fingerprints")
    stars = components(link_fingerprints(classes), folder, "near-cc-fingerprints").withColumnRenamed("id", "fp")
    shared = classes.join(stars, "fp", "left").where("component is not null or n > 1").select("fp", F.coalesce("component", "fp").alias("component"))
    return heads.join(shared, "fp").select("row", F.xxhash64(F.lit(-1), "component").alias("key"))


def kept_rows(keyed: DataFrame, folder: str, bands: int = BANDS) -> DataFrame:
    """``row`` of the one row that stays of each component; ``keyed`` has ``row``, ``doc_id`` and ``text``."""
    first_of = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "fp", "keys"))
    heads = written(signatures(keyed, bands).groupBy("same").agg(first_of.alias("head")).select("head.*"), folder, "near-heads")

    by_bucket = "partition by key order by row rows between unbounded preceding and current row"
    buckets = heads.select("row", F.posexplode("keys").alias("band", "key")).select("row", F.xxhash64("band", "key").alias("key"))
    buckets = buckets.unionByName(near_fingerprints(heads, folder))
    followers = written(buckets.withColumn("first", F.expr(f"min(row) over ({by_bucket})")).where("row != first"), folder, "near-followers")
    links = _verified(followers.select(F.col("first").alias("a"), F.col("row").alias("b")).distinct(), keyed, folder, "first")
    stars = written(components(links, folder, "near-cc-first"), folder, "near-stars-first")

    members = followers.select("key", "row").unionByName(followers.select("key", F.col("first").alias("row"))).distinct()
    named = members.join(stars.withColumnRenamed("id", "row"), "row", "left").select("key", "row", F.coalesce("component", "row").alias("component"))
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("top.component").alias("top"))
    leaders = followers.select("key", "first").distinct()
    # The bucket's first has met all others already.
    rest = written(named.join(largest, "key").join(leaders, "key").where("row != first").select("key", "row", "component", "top"), folder, "near-open")
    minor = rest.where("component != top").select("key", F.col("row").alias("p"), F.col("component").alias("cp"))
    again = minor.join(rest.select("key", "row", "component"), "key").where("component != cp").select(F.least("p", "row").alias("a"), F.greatest("p", "row").alias("b")).distinct()
    links = links.unionByName(_verified(again, keyed, folder, "second"))
    stars = components(links, folder, "near-cc-second")

    labelled = heads.drop("fp", "keys").join(stars.withColumnRenamed("id", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    return labelled.groupBy("component").agg(F.min(F.struct("none", "doc_id", "row")).alias("k")).select("k.row")


def drop_near_copies(docs: DataFrame, folder: str) -> DataFrame:
    """The documents without near copies, one row of each component."""
    keyed = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("all")), folder, "near-rows")
    stay = kept_rows(keyed.select("row", "all.doc_id", "all.text"), folder)
    return keyed.join(stay, "row", "left_semi").select("all.*")
