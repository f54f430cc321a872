"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two link when at most four differ. The bits are cut into blocks of 22, 21 and 21.
Each block, padded to 23 bits, is covered by the perfect binary Golay code, whose 4096 words are the anchors and
whose covering radius is 3. A fingerprint's home is its nearest anchor (within 3); it is replicated to every anchor
within 3 and the number of bits that a linked partner may differ in there. The home of one of a linked pair thus
meets the other, and pairs are compared per anchor, exactly. No pair is lost, whatever the fingerprints.

Anchors grow with the corpus. Up to ``WIDE`` distinct fingerprints, an anchor is a code word of one block: some block
of a linked pair differs in at most one bit, so a fingerprint has about 16 replicas at 3 * 2^12 anchors. Beyond, it is
a pair of code words of two blocks: some two of the blocks differ in at most one bit each, or in none and at most
two. That makes about 190 replicas at 3 * 2^24 anchors, and keeps an anchor's list short at any size.
An anchor with many homes is split into groups of about ``HOMES`` homes, each of which meets the anchor's whole list
in bounded chunks; only such anchors are listed on the driver, at most one for every ``HOMES`` fingerprints and block.

Rows with equal fingerprints are one class before any of this; pairs are between classes. Links go through
label propagation per task to a spanning forest, then through distributed components.

Defined results: null or blank texts have fingerprint 0 and link like any other; rows with a null doc_id
get a fingerprint and the component of their class (null if no row of it has an id); rows that repeat an id stay rows,
each with its own fingerprint; ties can't arise, as a component's id is its smallest; texts of any length are hashed
whole; an empty table gives no row; columns other than the named ones don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import components, shared_dir, written

NEAR = 4
SHINGLE = 4
BLOCKS = ((0, 22), (22, 21), (43, 21))
RADIUS, WITHIN = 3, 1
HOMES = 1 << 14
CHUNK = 1 << 21
#: Distinct fingerprints from which on anchors are pairs of code words.
WIDE = 1 << 24
#: Two of three blocks of a linked pair differ in no more than one of these pairs of bits.
SPLITS = ((1, 1), (0, 2), (2, 0))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last)], "<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that over half of the digests have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("t")).mapInArrow(work, "doc_id long, fp long")


_POLY = 0b101011100011


def _syndrome(v: np.ndarray) -> np.ndarray:
    for bit in range(22, 10, -1):
        v = np.where(v >> bit & 1, v ^ (_POLY << (bit - 11)), v)
    return v


@cache
def _errors(weight: int) -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome, the errors of at most ``weight`` bits that have it, lightest first and padded; their number."""
    shells = [np.zeros(1, np.int64)]
    for w in range(weight):
        more = np.unique((shells[-1][:, None] ^ (1 << np.arange(23))).ravel())
        shells.append(more[np.bitwise_count(more) == w + 1])
    near = np.concatenate(shells)
    of = _syndrome(near)
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=2048)
    wide = np.zeros((2048, counts.max()), np.int64)
    wide[of[order], np.arange(len(near)) - np.repeat(np.cumsum(counts) - counts, counts)] = near[order]
    return wide, counts


def _parts(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per block, its bits and their syndrome."""
    parts = [(fps >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1) for low, width in BLOCKS]
    return [(p, _syndrome(p)) for p in parts]


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with so many entries each: the row and the number of every entry."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


def _near(part: tuple[np.ndarray, np.ndarray], within: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code word) of every anchor of a block within the covering radius and ``within``."""
    wide, counts = _errors(RADIUS + within)
    bits, s = part
    rows, slot = _spread(counts[s])
    return rows, (bits[rows] ^ wide[s[rows], slot]) >> 11


def home_words(fps: np.ndarray, pairs: bool = False) -> list[np.ndarray]:
    """Per block (or pair of blocks), each fingerprint's home."""
    leader = _errors(RADIUS)[0][:, 0]
    own = [(bits ^ leader[s]) >> 11 for bits, s in _parts(fps)]
    return [(own[i] << 12) | own[j] for i, j in ((0, 1), (0, 2), (1, 2))] if pairs else own


def replicas(fps: np.ndarray, pairs: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per block (or pair of blocks): its number, and (row, anchor) of every replica, each once."""
    parts = _parts(fps)
    if not pairs:
        for k, part in enumerate(parts):
            yield k, *_near(part, WITHIN)
        return
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        found = []
        for first, second in SPLITS:
            (r1, a1), (r2, a2) = _near(parts[i], first), _near(parts[j], second)
            n2 = np.bincount(r2, minlength=len(fps))
            begin = np.cumsum(n2) - n2
            at, slot = _spread(n2[r1])
            row = r1[at]
            found.append(np.stack([row, (a1[at] << 12) | a2[begin[row] + slot]]))
        both = np.concatenate(found, axis=1)
        key = np.unique((both[0] << 24) | both[1])
        yield k, key >> 24, key & ((1 << 24) - 1)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From links to those that join each value with the least of its component."""
    if not len(a):
        return a, b
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = at[: len(a)], at[len(a) :], np.arange(len(values))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = np.minimum(new, new[new])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    apart = label != np.arange(len(values))
    return values[apart], values[label[apart]]


def near_pairs(held: np.ndarray, others: np.ndarray, near: int = NEAR) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different values of at most ``near`` differing bits, from blocks of bounded size."""
    step = max(1, CHUNK // max(1, len(others)))
    for at in range(0, len(held), step):
        differ = np.bitwise_count(held[at : at + step, None] ^ others[None, :])
        i, j = np.nonzero((differ <= near) & (differ > 0))
        if len(i):
            yield held[at + i], others[j]


def link_fingerprints(classes: DataFrame, homes: int = HOMES, wide: int = WIDE) -> DataFrame:
    """Links (a, b) that span the graph of distinct fingerprints ``fp`` at up to four differing bits."""
    pairs = classes.count() > wide
    shift = 24 if pairs else 12

    def home_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for k, home in enumerate(home_words(fps.view("<u8"), pairs)):
                yield pa.RecordBatch.from_arrays([pa.array((k << shift) | home)], ["anchor"])

    groups = classes.select("fp").mapInArrow(home_rows, "anchor long").groupBy("anchor").count()
    # One anchor at most for every ``homes`` fingerprints and block, and no more than there are anchors.
    split = {r["anchor"]: -(-r["count"] // homes) for r in groups.where(F.col("count") > homes).toLocalIterator()}
    crowded = np.array(sorted(split), np.int64)
    times = np.array([split[x] for x in crowded.tolist()], np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(whole), 4096):
                fps = whole[start : start + 4096]
                mixed = ((fps.view("<u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
                own = home_words(fps.view("<u8"), pairs)
                for k, row, at in replicas(fps.view("<u8"), pairs):
                    anchor = (k << shift) | at
                    parts = np.ones(len(row), np.int64)
                    if len(crowded):
                        place = np.minimum(np.searchsorted(crowded, anchor), len(crowded) - 1)
                        parts = np.where(crowded[place] == anchor, times[place], 1)
                    copy, part = _spread(parts)
                    row, anchor, parts = row[copy], anchor[copy], parts[copy]
                    is_home = (anchor == ((k << shift) | own[k][row])) & (part == mixed[row] % parts)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part.astype(np.int32)), pa.array(is_home), pa.array(fps[row])], ["anchor", "part", "home", "fp"])

    rows = classes.select("fp").mapInArrow(spread, "anchor long, part int, home boolean, fp long")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by anchor and part, homes first: homes are held (at most about HOMES), others stream by.
        now, held = None, np.zeros(0, "<u8")
        left, right, kept = [], [], 0
        for batch in batches:
            anchor, part, home, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            fps = fps.view("<u8")
            cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
            for lo, hi in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(fps)]]).tolist()):
                if lo == hi:
                    continue
                if (key := (anchor[lo], part[lo])) != now:
                    now, held = key, np.zeros(0, "<u8")
                others, own = fps[lo:hi], home[lo:hi]
                if own.any():
                    held = np.concatenate([held, others[own]])
                for a, b in near_pairs(held, others):
                    left.append(a)
                    right.append(b)
                    kept += len(a)
                    if kept > CHUNK:
                        # What is held is a forest: no larger than the task's distinct fingerprints.
                        a, b = spanning(np.concatenate(left), np.concatenate(right))
                        left, right, kept = [a], [b], 0
        a, b = spanning(np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, "<u8"),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(a.view("<i8")), pa.array(b.view("<i8"))], ["a", "b"])

    return rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.desc("home")).mapInArrow(compare, "a long, b long")


def simhash_components(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row."""
    fps = written(fingerprints(docs, doc_id, text), folder, "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), folder, "classes")
    stars = components(link_fingerprints(classes), folder)
    labelled = classes.join(stars.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = labelled.join(least, "component").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_components(docs, shared_dir(spark))
