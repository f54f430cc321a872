"""Benchmark decontamination: every training passage queries a BM25 inverted index of the test items by block-max WAND.

Index: items (long ones in segments of ``SEGMENT`` words) with impacts of their terms, each divided by the
segment's own score with itself, so that one threshold holds for all. A term's postings go by segment, in
blocks of ``BLOCK`` segments, each with its largest impact there. Segments are ordered by the common terms they
hold, so that a block is of one language or topic and its maxima are sharp. The index is as large as the
benchmark, not the corpus; it is written once to the shared folder and read by each task.

Passages: windows of two segments' words, a step of one apart, so that any segment's length of text lies whole
in one; of a passage, distinct terms count. All passages of a batch go through WAND's cascade at once:
1. the sum of their terms' largest impacts must reach the threshold; 2. for each block, so must the sum of the
terms' maxima in the block, else the block's postings are skipped; 3. postings of the blocks left are
scored. Every segment that reaches the threshold is found; no other pruning takes place.

Verification on the passage, widened by the item's length on both sides: of the question's shingles of
five words, and of the answer's, ``OVERLAP`` must be there. The question is the item's text to its first
sentence end, the answer the rest; where the rest has no word the question alone decides. A part of fewer than
five words is one shingle of its own length. Words are lower-cased runs of letters and digits.

Words and shingles are known by 64-bit digests.

Defined results: null or blank texts match nothing; blank items are never matched, items that repeat are
each matched; rows with a null doc_id are reported with it; repeated rows are each reported; of passages with equal
scores the first that passes counts; texts of any length are searched whole, passage by passage; an empty table or
benchmark gives no row; other columns don't matter, whatever their names, and ``drop_contaminated`` gives them back.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import open_fs, put, shared_dir

K1, B = 1.2, 0.75
SEGMENT, BLOCK = 64, 16
THRESHOLD = 0.6
SHINGLE, OVERLAP = 5, 0.8
#: Words that are put through the cascade at once.
BATCH = 200_000


def word_digests(text: Column) -> Column:
    """A 64-bit digest per word."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(found, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(ids: np.ndarray, width: int) -> np.ndarray:
    """A digest per run of ``width`` words."""
    if not width or len(ids) < width:
        return np.zeros(0, np.uint64)
    mixed = np.zeros(len(ids) - width + 1, np.uint64)
    for k in range(width):
        mixed = (mixed ^ ids.view("<u8")[k : len(ids) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of ranges, and the range of each."""
    sizes = ends - starts
    of = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[of], of


def totals(keys: np.ndarray, values: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key, of the keys whose sum is ``least`` or more."""
    if not len(keys):
        return keys, values
    top = int(keys.max()) + 1
    if top <= 4 * len(keys) + 1_000_000:
        sums = np.bincount(keys, values, top)
        found = np.flatnonzero(sums >= least)
        return found, sums[found]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sums = np.add.reduceat(values[order], first)
    return keys[first][sums >= least], sums[sums >= least]


class Index:
    """Postings of all terms in one array, cut by term and block."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """``items``: id, word digests of the question, of the answer."""
        segments: list[tuple[int, np.ndarray]] = []
        self.ids = [i for i, _, _ in items]
        self.parts: list[list[tuple[int, np.ndarray]]] = []
        for k, (_, question, answer) in enumerate(items):
            found = np.concatenate([question, answer])
            segments += [(k, found[at : at + SEGMENT]) for at in range(0, len(found), SEGMENT)]
            self.parts.append([(w, np.unique(shingles(x, w))) for x in (question, answer) if (w := min(SHINGLE, len(x)))])
        df = Counter(t for _, s in segments for t in np.unique(s).tolist())
        common = [t for t, _ in df.most_common(24)]
        segments.sort(key=lambda x: ([t in set(x[1].tolist()) for t in common], x[0]))
        self.item = np.array([k for k, _ in segments], np.int64)
        n = len(segments)
        mean = sum(len(s) for _, s in segments) / n if n else 1.0
        rows: list[tuple[int, int, float]] = []
        self.terms = np.array(sorted(df), "<i8")
        place = {t: i for i, t in enumerate(self.terms.tolist())}
        for k, (_, s) in enumerate(segments):
            tf = Counter(s.tolist())
            impact = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(s) / mean)) for t, c in tf.items()}
            own = sum(impact.values())
            rows += [(place[t], k, x / own) for t, x in impact.items()]
        rows.sort()
        term, self.segment, self.impact = (np.array([r[i] for r in rows], kind) for i, kind in enumerate((np.int64, np.int64, float)))
        block = self.segment // BLOCK
        cut = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if rows else term
        self.block, self.block_start, self.block_end = block[cut], cut, np.append(cut[1:], len(rows))[: len(cut)]
        self.block_most = np.maximum.reduceat(self.impact, cut) if rows else self.impact
        self.term_start = np.searchsorted(term[cut], np.arange(len(self.terms)))
        self.term_end = np.searchsorted(term[cut], np.arange(len(self.terms)), "right")
        self.most = np.maximum.reduceat(self.block_most, self.term_start) if rows else self.impact
        self.blocks = n // BLOCK + 1

    def search(self, passage: np.ndarray, term: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages, segments and scores of all pairs that reach the threshold; input: distinct (passage, term) pairs."""
        slack = threshold - 1e-9
        alive, _ = totals(passage, self.most[term], slack)
        keep = np.isin(passage, alive)
        passage, term = passage[keep], term[keep]
        at, of = spread(self.term_start[term], self.term_end[term])
        key = passage[of] * self.blocks + self.block[at]
        alive, _ = totals(key, self.block_most[at], slack)
        keep = np.isin(key, alive)
        at, passage = at[keep], passage[of[keep]]
        posting, of = spread(self.block_start[at], self.block_end[at])
        width = len(self.item)
        key, score = totals(passage[of] * width + self.segment[posting], self.impact[posting], slack)
        return key // max(1, width), key % max(1, width), score

    def matches(self, found: np.ndarray, offsets: np.ndarray, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, int, float, float, float]]:
        """Document (by place), item, best score and overlaps, for texts' word digests, one after another."""
        if not len(found) or not len(self.terms):
            return []
        at = np.minimum(np.searchsorted(self.terms, found), len(self.terms) - 1)
        where = np.flatnonzero(self.terms[at] == found)
        sizes = np.diff(offsets)
        windows = np.maximum(1, -(-sizes // SEGMENT) - 1)
        first = np.cumsum(windows) - windows
        doc = np.searchsorted(offsets, where, "right") - 1
        step = (where - offsets[doc]) // SEGMENT
        later, earlier = step < windows[doc], step > 0
        passage = np.concatenate([(first[doc] + step)[later], (first[doc] + step - 1)[earlier]])
        key = np.unique(passage * len(self.terms) + np.concatenate([at[where][later], at[where][earlier]]))
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for p, s, score in zip(*(x.tolist() for x in self.search(key // len(self.terms), key % len(self.terms), threshold))):
            d, i = int(np.searchsorted(first, p, "right")) - 1, int(self.item[s])
            while not sizes[d]:
                d -= 1
            if score <= best.get((d, i), (-1.0,))[0]:
                continue
            begin = offsets[d] + (p - first[d]) * SEGMENT
            wide = sum(len(x) + w for w, x in self.parts[i])
            text = found[max(offsets[d], begin - wide) : min(offsets[d + 1], begin + 2 * SEGMENT + wide)]
            shares = [float(np.isin(x, shingles(text, w)).mean()) for w, x in self.parts[i]]
            if min(shares) >= overlap:
                best[d, i] = (score, shares[0], shares[-1])
        return [(d, self.ids[i], *x) for (d, i), x in sorted(best.items())]


def build_index(benchmark: DataFrame, folder: str) -> str:
    """Reads the items, whose number and size the benchmark bounds, and writes the index."""
    parts = F.split(F.coalesce("text", F.lit("")), r"(?<=[.?!])[\x20\x09-\x0D]+", 2)
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), word_digests(parts[0]).alias("q"), word_digests(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("a")).orderBy("i", "q", "a")
    put(f"{folder}/index.bin", pickle.dumps(Index([(r["i"], np.array(r["q"], "<i8"), np.array(r["a"], "<i8")) for r in rows.toLocalIterator()])))
    return f"{folder}/index.bin"


def _groups(lists: pa.ListArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about BATCH words at most: first and last row, words, and where rows start."""
    flat, offsets, a = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64), 0
    while a < len(lists):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BATCH, "right")) - 1)
        yield a, b, flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def _open_index(path: str) -> Index:
    system, inner = open_fs(path)
    with system.open_input_stream(inner, compression=None) as f:
        return pickle.loads(f.read())


def contaminated(docs: DataFrame, benchmark: DataFrame, folder: str) -> DataFrame:
    """``doc_id``, ``item_id``, ``score`` (share of the item's own), ``question_overlap``, ``answer_overlap``."""
    path = build_index(benchmark, folder)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _open_index(path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, _, flat, offsets in _groups(batch.column(1)):
                rows = [(ids[a + d], *m) for d, *m in index.matches(flat, offsets)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_digests(F.col("text")).alias("w"))
    return hashed.mapInArrow(work, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, folder: str, keep_unnamed: bool = True) -> DataFrame:
    """The documents without a match, and those without an id where ``keep_unnamed``. Each row is judged by its own text and
    passed on or not where it is read, so that repeated ids don't matter and nothing is shuffled."""
    path, words = build_index(benchmark, folder), "".join(docs.columns) + "_words"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _open_index(path)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for a, _, flat, offsets in _groups(batch.column(batch.num_columns - 1)):
                clean[[a + d for d, *_ in index.matches(flat, offsets)]] = False
            if keep_unnamed:
                clean |= batch.column(ids).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(clean))

    ids = docs.columns.index("doc_id")
    return docs.select(*docs.columns, word_digests(F.col("text")).alias(words)).mapInArrow(work, docs.schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shared_dir(spark))
    return found.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")])
