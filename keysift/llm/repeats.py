"""Exact substring dedup: bytes covered by a 200-byte string that also starts anywhere else are removed.

The method asked for, merging the Burrows-Wheeler transforms of shards by interleave refinement, needs a pass
over all suffixes per byte of depth, 200 here; it isn't built (see the README). This operator gives the same
result by settling most places without sorting:

1. A window is 200 bytes of a text. Its anchor is the least-hashed of its 64-byte strings (the leftmost of
   equal ones), so that equal windows have equal anchors at equal places; about one byte in 69 is an anchor.
   Anchor strings are counted. A window whose anchor string is unique is unique.
2. The windows of one anchor are neighbours; their extent is the bytes they cover together. Where an extent
   is found twice all its windows are repeats: that settles the inside of long matches, a digest per anchor.
3. The windows of anchor strings that still have an unsettled extent are counted one by one, once per
   extent and task; those found twice are repeats.

Sets of repeated digests are sorted files in the shared folder that tasks map and search; nothing but their
piece sizes comes to the driver. Each step is a narrow pass over the texts and a count of digests with
partial sums. Windows and extents are compared by 64-bit digests of two polynomials.

Defined results: null and empty texts have no bytes and keep none; texts under 200 bytes lose nothing; rows with
a null doc_id take part; repeated rows repeat each other; ties go to the leftmost; texts of any length are treated whole,
in overlapping parts; an empty table gives no row; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import shared_dir, written
from keysift.llm.lm_score import Opened, save

LENGTH, GRAM = 200, 64
#: Bytes of a buffer; longer texts go through in overlapping parts. A place in it fits 20 bits.
BUFFER = 1 << 20
PIECE = 1_000_000

_RNG = np.random.default_rng(20240229)
_CODES = _RNG.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base, np.uint64))), dtype=np.uint64)


class Powers:
    """Powers of the bases and of their inverses modulo 2**64, made once per task."""

    def __init__(self) -> None:
        self.up = [_powers(b, BUFFER + 1) for b in _BASES]
        self.down = [_powers(np.uint64(pow(int(b), -1, 1 << 64)), BUFFER + 1) for b in _BASES]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x9FB21C651E98DF25)
    return x ^ x >> np.uint64(32)


class Buffer:
    """Anchors and digests of some texts laid end to end, at most BUFFER bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> None:
        """``starts`` and ``ends``: first and last + 1 window start of each text in ``data``."""
        self.data, self.powers = data, powers
        self.sums = [np.concatenate(([np.uint64(0)], np.cumsum(c[data] * p[: len(data)], dtype=np.uint64))) for c, p in zip(_CODES, powers.up)]
        n = len(data) - LENGTH + 1
        valid = np.zeros(max(n, 0) + 1, np.int8)
        np.add.at(valid, starts[starts < ends], 1)
        np.add.at(valid, ends[starts < ends], -1)
        at = np.flatnonzero(np.cumsum(valid[:-1]))
        if not len(at):
            self.first = self.last = self.anchor = np.zeros(0, np.int64)
            self.gram = np.zeros(0, np.uint64)
            return
        grams = self._digest(0, np.arange(len(data) - GRAM + 1), GRAM)
        least = _sliding_min(_mix(grams) & ~np.uint64((1 << 20) - 1) | np.arange(len(grams), dtype=np.uint64), LENGTH - GRAM + 1)[at]
        place = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1))))
        self.first, self.last, self.anchor = at[cut], at[np.append(cut[1:], len(at)) - 1], place[cut]
        self.gram = _mix(grams[self.anchor])

    def _digest(self, k: int, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        s = self.sums[k]
        return (s[start + size] - s[start]) * self.powers.down[k][start]

    def digest(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return _mix(self._digest(0, start, size) ^ _mix(self._digest(1, start, size) + np.uint64(1) * np.asarray(size, np.uint64)))

    def extents(self, some: np.ndarray) -> np.ndarray:
        return self.digest(self.first[some], self.last[some] - self.first[some] + LENGTH)

    def windows(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the anchors' windows, and which of ``some`` each belongs to."""
        sizes = self.last[some] - self.first[some] + 1
        of = np.repeat(np.arange(len(some)), sizes)
        return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.first[some][of], of


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from running minima of blocks to both sides."""
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def buffers(texts: list[bytes], powers: Powers) -> Iterator[tuple[Buffer, list[tuple[int, int, int]]]]:
    """Buffers over all texts of at least LENGTH bytes, with (text, offset in it, offset in the buffer) of their parts."""
    parts, size = [], 0

    def made() -> tuple[Buffer, list[tuple[int, int, int]]]:
        data = np.frombuffer(b"".join(texts[t][a : a + n] for t, a, n in parts), np.uint8)
        at = np.cumsum([0] + [n for _, _, n in parts])
        starts = at[:-1]
        return Buffer(data, starts, at[1:] - LENGTH + 1, powers), [(t, a, int(s)) for (t, a, _), s in zip(parts, starts)]

    for t, text in enumerate(texts):
        for a in range(0, max(0, len(text) - LENGTH + 1), BUFFER - LENGTH + 1):
            n = min(BUFFER, len(text) - a)
            if parts and size + n > BUFFER:
                yield made()
                parts, size = [], 0
            parts.append((t, a, n))
            size += n
    if parts:
        yield made()


class DigestSet:
    """A sorted set of digests in mapped pieces."""

    def __init__(self, folder: str, name: str, sizes: list[int]) -> None:
        self.bits = len(sizes).bit_length() - 1
        self.names = [f"{folder}/{name}-{i}" if n else None for i, n in enumerate(sizes)]
        self.files = Opened()

    def has(self, digests: np.ndarray) -> np.ndarray:
        order = np.argsort(digests)
        values, out = digests[order], np.zeros(len(digests), bool)
        cuts = np.searchsorted(values >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(values), np.uint64), np.arange(len(self.names) + 1, dtype=np.uint64))
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            part = values[cuts[i] : cuts[i + 1]]
            if self.names[i] is not None:
                p = self.files[self.names[i]]["digest"]
                out[order[cuts[i] : cuts[i + 1]]] = p[np.minimum(np.searchsorted(p, part), len(p) - 1)] == part
        return out


def write_set(digests: DataFrame, folder: str, name: str) -> tuple[str, str, list[int]]:
    """Writes the distinct values of the only column as sorted pieces; gives what ``DigestSet`` needs."""
    column = digests.columns[0]
    digests = written(digests, folder, f"{name}-rows")
    bits = max(0, (-(-digests.count() // PIECE) - 1).bit_length())
    piece = F.shiftrightunsigned(column, 64 - bits).cast("int") if bits else F.lit(0)

    def write(table: pa.Table) -> pa.Table:
        values = np.unique(table["d"].to_numpy().astype("<i8").view("<u8"))
        i = table["piece"][0].as_py()
        save(f"{folder}/{name}-{i}", {"digest": values})
        return pa.table({"piece": pa.array([i], pa.int32()), "n": [len(values)]})

    rows = digests.select(F.col(column).alias("d"), piece.alias("piece")).groupBy("piece").applyInArrow(write, "piece int, n long").collect()
    found = {r["piece"]: r["n"] for r in rows}
    return folder, name, [found.get(i, 0) for i in range(1 << bits)]


Step = Callable[[Buffer], list[np.ndarray]]


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view("<i8"))


def _pass(docs: DataFrame, make: Callable[[], Step], schema: str) -> DataFrame:
    """A narrow pass: ``make`` gives, per task, the step from a buffer to columns."""
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, powers = make(), Powers()
        for batch in batches:
            for buffer, _ in buffers([t or b"" for t in batch.column(0).to_pylist()], powers):
                columns = step(buffer)
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([_longs(c) if c.dtype.itemsize == 8 else pa.array(c) for c in columns], names)

    return docs.select("body").mapInArrow(work, schema)


def find_repeats(docs: DataFrame, folder: str) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``spans`` (start, end of what goes) and ``kept`` (the bytes left)."""
    docs = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"))
    twice = F.col("count") > 1
    grams = _pass(docs, lambda: lambda b: [b.gram], "g long").groupBy("g").count().where(twice).select("g")
    gram_set = write_set(grams, folder, "grams")

    def extents() -> Step:
        known = DigestSet(*gram_set)

        def step(b: Buffer) -> list[np.ndarray]:
            some = np.flatnonzero(known.has(b.gram))
            return [b.gram[some], b.extents(some)]

        return step

    found = written(_pass(docs, extents, "g long, e long"), folder, "extents")
    repeated = written(found.groupBy("e").count().where(twice).select("e"), folder, "repeated")
    extent_set = write_set(repeated, folder, "settled")
    open_set = write_set(found.join(repeated, "e", "left_anti").select("g").distinct(), folder, "open")

    def windows() -> Step:
        # ``done`` holds extents of this task's own texts, so its input bounds it.
        unsettled, settled, done = DigestSet(*open_set), DigestSet(*extent_set), set()

        def step(b: Buffer) -> list[np.ndarray]:
            some = np.flatnonzero(unsettled.has(b.gram))
            e = b.extents(some)
            sure = settled.has(e)
            new = []
            for i, (x, s) in enumerate(zip(e.tolist(), sure.tolist())):
                if not s or x not in done:
                    new.append(i)
                    if s:
                        done.add(x)
            new = np.array(new, np.int64)
            at, of = b.windows(some[new])
            return [b.digest(at, LENGTH), np.where(sure[new][of], 2, 1).astype(np.int32)]

        return step

    counted = _pass(docs, windows, "w long, n int").groupBy("w").agg(F.sum("n").alias("count")).where(twice).select("w")
    window_set = write_set(counted, folder, "windows")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, unsettled, settled, single = Powers(), DigestSet(*open_set), DigestSet(*extent_set), DigestSet(*window_set)
        known = DigestSet(*gram_set)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            gone: dict[int, list[tuple[int, int]]] = {}
            for b, parts in buffers(texts, powers):
                some = np.flatnonzero(known.has(b.gram))
                if not len(some):
                    continue
                sure = settled.has(b.extents(some))
                at, _ = b.windows(some[sure])
                rest = some[~sure]
                rest = rest[unsettled.has(b.gram[rest])]
                more, _ = b.windows(rest)
                at = np.sort(np.concatenate([at, more[single.has(b.digest(more, LENGTH))]]))
                place = np.array([p for _, _, p in parts])
                of = np.searchsorted(place, at, "right") - 1
                # Neighbouring windows of one part at most LENGTH apart make one run.
                cut = np.flatnonzero(np.concatenate(([True], (np.diff(at) > LENGTH) | (np.diff(of) > 0)))) if len(at) else at
                for i, j in zip(cut.tolist(), np.append(cut[1:], len(at)).tolist()):
                    t, offset, p = parts[of[i]]
                    gone.setdefault(t, []).append((int(at[i]) - p + offset, int(at[j - 1]) - p + offset + LENGTH))
            rows = []
            for t, text in enumerate(texts):
                runs: list[list[int]] = []
                for a, z in sorted(gone.get(t, ())):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(z, runs[-1][1])
                    else:
                        runs.append([a, z])
                kept = b"".join(text[a:z] for a, z in zip([0] + [z for _, z in runs], [a for a, _ in runs] + [len(text)]))
                rows.append((len(text), len(text) - len(kept), [{"start": a, "end": z} for a, z in runs], kept))
            for i in range(0, len(rows), 500):
                cols = list(zip(*rows[i : i + 500]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 500), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), span, pa.binary())))], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "body").mapInArrow(cover, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_repeats(docs, shared_dir(spark))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
