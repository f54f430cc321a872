"""LM scoring by an Elias-Fano n-gram trie: monotone pointers, quantised smoothed probabilities, memory-mapped levels.

Model: interpolated absolute discounting over trigrams, bigrams and the add-0.5 unigrams of the base score.
``p(c|a,b) = A(abc) + bow(ab) p(c|b)`` with ``A = (n - D) / n(context)`` and ``bow = 1 - sum A``, so that each
distribution sums to one. Every trigram of the training texts is stored, those seen once too.

Tokens: the bytes of many texts are cut and hashed at once, a word's digest coming from running sums of two polynomials.
Counting: (1) word counts by digest; the sorted digests in pieces give each word its number. (2) each task
turns its texts into numbers, sums its n-grams, and sends them as compressed blocks to shards of a bounded
number of tokens: ranges of (first word, second word), a word with many tokens being cut into several. (3) a
shard sorts its n-grams and writes its trie: first words, then (context, word) as one monotone sequence per
level, pointers to children likewise; probabilities and back-off weights in 16 bits.

Scoring: pairs of a chunk are sorted, so that a shard is visited once; a word's node is the successor search of
its number relative to its context. A visit has its price whatever the number of pairs, so chunks grow with the number
of shards, up to ``GROWN`` times; what a chunk holds for each token is kept small. Maps are shared by all tasks of a machine; none holds the model.

Words are known by 64-bit digests. Defined results: null texts are empty, and have the end token alone; a null
doc_id trains; repeated rows count as often as they are there; ties don't arise; texts of any length are counted and
scored whole; without training texts all tokens are unknown and N = V = 0; an empty table gives no row; other columns
don't matter, whatever their names. Files are mapped where the shared folder is mounted, else read; a task keeps ``OPEN``
of a kind at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import open_fs, put, shared_dir, written
from keysift.llm.elias_fano import EliasFano

D = 0.75
SHARD = 2_000_000
PIECE = 1_000_000
CHUNK = 400_000
#: A chunk is of ``CHUNK`` tokens for every ``VISITS`` shards, and of no more than ``GROWN`` times as many.
VISITS, GROWN = 64, 5
#: Bytes that are hashed at a time; a longer text is hashed whole.
PART = 1 << 19
#: Files that a task keeps open at a time.
OPEN = 1024
#: 16-bit codes of log10 values from 0 down to -16.
STEP = 16 / 65535
NONE = np.uint32(0xFFFFFFFF)


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    head, at, body = {}, 0, []
    for name, x in arrays.items():
        data = np.ascontiguousarray(x).tobytes()
        head[name] = (x.dtype.str, len(x), at)
        at += -(-len(data) // 8) * 8
        body.append(data + b"\0" * (-len(data) % 8))
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    put(uri, len(text).to_bytes(8, "little") + text + b"".join(body))


def load(uri: str) -> dict[str, np.ndarray]:
    system, path = open_fs(uri)
    raw = np.memmap(path, "u1", "r") if system.type_name == "local" else np.frombuffer(system.open_input_file(path).read(), "u1")
    n = int(raw[:8].view("<i8")[0])
    head = json.loads(raw[8 : 8 + n].tobytes())
    return {k: raw[8 + n + at : 8 + n + at + size * np.dtype(kind).itemsize].view(kind) for k, (kind, size, at) in head.items()}


class Opened:
    """Files of arrays by name, opened when first asked for; the last ``OPEN`` stay so."""

    def __init__(self, make: Callable[[str], object] = load, most: int | None = None) -> None:
        self.make, self.most, self.held = make, most or OPEN, {}

    def __getitem__(self, uri: str) -> object:
        found = self.held.pop(uri, None)
        if found is None:
            found = self.make(uri)
            if len(self.held) >= self.most:
                del self.held[next(iter(self.held))]
        self.held[uri] = found
        return found


def quantise(p: np.ndarray) -> np.ndarray:
    """Code 65535 is zero probability."""
    with np.errstate(divide="ignore"):
        code = np.round(-np.log10(p) / STEP)
    return np.where(p <= 0, 65535, np.clip(code, 0, 65534)).astype("<u2")


_VALUES = 10.0 ** (-np.arange(65536) * STEP)
_VALUES[65535] = 0.0


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_RNG = np.random.default_rng(7)
_CODES = (_RNG.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, _LOWER]
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of the bases and of their inverses modulo 2**64, for texts of up to ``n`` bytes."""
    size = 1 << max(20, (n + 1).bit_length())
    if size not in _POWERS:
        run = lambda x: np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, x, np.uint64))), dtype=np.uint64)
        _POWERS.clear()
        _POWERS[size] = [(run(np.uint64(x)), run(np.uint64(pow(x, -1, 1 << 64)))) for x in _BASES]
    return _POWERS[size]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x9FB21C651E98DF25)
    return x ^ x >> np.uint64(32)


#: The end's digest is that of no byte at all, which no word is.
END = _mix(_mix(np.zeros(1, np.uint64))).view("<i8")[0]


def digests(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A digest per word (A-Z lower-cased) of bytes that end in white space, and where words start."""
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    found = []
    for codes, (up, down) in zip(_CODES, _powers(len(data))):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(codes[data] * up[: len(data)], dtype=np.uint64)))
        found.append((sums[ends] - sums[starts]) * down[starts])
    return _mix(found[0] ^ _mix(found[1] + (ends - starts).astype(np.uint64))).view("<i8"), starts


def grown(shards: int) -> int:
    """Tokens of a chunk whose pairs go to so many shards."""
    return CHUNK * min(GROWN, max(1, shards // VISITS))


def chunks(texts: list[bytes], tokens: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``tokens`` tokens (CHUNK): first and last text, digests of words with an end after each text, and where texts start."""
    a, most = 0, 6 * (tokens or CHUNK)
    while a < len(texts):
        b, size = a + 1, len(texts[a])
        while b < len(texts) and size + len(texts[b]) <= most:
            size += len(texts[b])
            b += 1
        found, before, n, c = [], [], 0, a
        while c < b:  # hashed in parts that fit a cache
            d, size = c + 1, len(texts[c])
            while d < b and size + len(texts[d]) <= PART:
                size += len(texts[d])
                d += 1
            words, starts = digests(np.frombuffer(b"\n".join([*texts[c:d], b""]), "u1"))
            found.append(words)
            before.append(n + np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts[c:d]])))  # words up to the end of each text
            n, c = n + len(words), d
        words, before = np.concatenate(found), np.concatenate(before)
        offsets = np.concatenate(([0], before + np.arange(1, b - a + 1)))
        flat = np.full(offsets[-1], END)
        own = np.ones(offsets[-1], bool)
        own[offsets[1:] - 1] = False
        flat[own] = words
        yield a, b, flat, offsets
        a = b


def bodies(text: Column) -> Column:
    """The bytes of a text; none for null."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


class Vocabulary:
    """Words' numbers and counts, over pieces of sorted digests."""

    def __init__(self, folder: str, pieces: list[tuple[int, int]]) -> None:
        self.folder, self.bits = folder, len(pieces).bit_length() - 1
        self.starts = np.concatenate(([0], np.cumsum([n for _, n in pieces]))).astype(np.int64)
        self.size, self.total = int(self.starts[-1]), sum(c for c, _ in pieces)
        self.names = [f"{folder}/words-{i}" if n else None for i, (_, n) in enumerate(pieces)]
        self.files = Opened()

    def find(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (``size`` where unknown) and counts."""
        if len(digests) > 2 * CHUNK:
            parts = [self.find(digests[a : a + CHUNK]) for a in range(0, len(digests), CHUNK)]
            return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        distinct, back = np.unique(digests, return_inverse=True)
        ids, counts = np.full(len(distinct), self.size, np.int64), np.zeros(len(distinct), np.int64)
        piece = (distinct >> (64 - self.bits)) + (1 << self.bits >> 1) if self.bits else np.zeros(len(distinct), np.int64)
        cuts = np.searchsorted(piece, np.arange(len(self.names) + 1))
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            part = distinct[cuts[i] : cuts[i + 1]]
            if self.names[i] is None:
                continue
            p = self.files[self.names[i]]
            at = np.minimum(np.searchsorted(p["digest"], part), len(p["digest"]) - 1)
            hit = p["digest"][at] == part
            ids[cuts[i] : cuts[i + 1]][hit] = at[hit] + self.starts[i]
            counts[cuts[i] : cuts[i + 1]][hit] = p["count"][at[hit]]
        return ids[back], counts[back]


def count_words(docs: DataFrame, folder: str) -> list[tuple[int, int]]:
    """Writes the vocabulary; returns tokens and words per piece."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, flat, _ in chunks(batch.column(0).to_pylist()):
                held.append(flat)
                size += len(flat)
                if size > 8 * CHUNK:
                    yield summed(held)
                    held, size = [], 0
        if held:
            yield summed(held)

    def summed(held: list[np.ndarray]) -> pa.RecordBatch:
        digest, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(digest), pa.array(n)], ["digest", "n"])

    parts = docs.select(bodies(F.col("text"))).mapInArrow(work, "digest long, n long")
    counts = written(parts.groupBy("digest").agg(F.sum("n").alias("n")), folder, "words")
    n = counts.count()
    bits = max(0, (-(-n // PIECE) - 1).bit_length())
    piece = (F.shiftright("digest", 64 - bits) + (1 << bits >> 1)).cast("int") if bits else F.lit(0)

    def write(table: pa.Table) -> pa.Table:
        digest, n = table["digest"].to_numpy(), table["n"].to_numpy()
        order = np.argsort(digest)
        i = table["piece"][0].as_py()
        save(f"{folder}/words-{i}", {"digest": digest[order].astype("<i8"), "count": n[order].astype("<i8")})
        return pa.table({"piece": pa.array([i], pa.int32()), "tokens": [int(n.sum())], "words": [len(n)]})

    rows = counts.withColumn("piece", piece).groupBy("piece").applyInArrow(write, "piece int, tokens long, words long").collect()
    found = {r["piece"]: (r["tokens"], r["words"]) for r in rows}
    return [found.get(i, (0, 0)) for i in range(1 << bits)]


def shard_bounds(counts: DataFrame, folder: str, pieces: list[tuple[int, int]]) -> np.ndarray:
    """First keys of the shards; a key is first word << 32 | second. Words with over a shard's share of tokens (at most
    as many as there are shards) are cut by their second word."""
    total, size = sum(t for t, _ in pieces), sum(w for _, w in pieces)
    shards = max(1, -(-total // SHARD))
    bounds = {(size * s // shards) << 32 for s in range(shards)}
    hot = np.array([r["digest"] for r in counts.where(F.col("n") > max(SHARD // 2, total // (8 * shards))).select("digest").collect()], np.int64)
    if len(hot):
        for a, n in zip(*(x.tolist() for x in Vocabulary(folder, pieces).find(hot))):
            parts = -(-2 * n // SHARD)
            bounds |= {a << 32 | (size + 1) * j // parts for j in range(parts)} | {(a + 1) << 32}
    return np.array(sorted(bounds), np.int64)


def count_ngrams(docs: DataFrame, folder: str, pieces: list[tuple[int, int]], bounds: np.ndarray) -> DataFrame:
    """Blocks of summed n-grams: ``shard``, ``block``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(folder, pieces)
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for _, _, flat, offsets in chunks(batch.column(0).to_pylist(), grown(len(bounds))):
                ids = vocabulary.find(flat)[0]
                last = np.zeros(len(ids) + 1, bool)
                last[offsets[1:] - 1] = True
                at = np.flatnonzero(~last[:-1])
                third = np.where(last[at + 1], np.int64(NONE), ids[np.minimum(at + 2, len(ids) - 1)])
                key = ids[at] << 32 | ids[at + 1]
                order = np.lexsort((third, key))
                key, third = key[order], third[order]
                first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (third[1:] != third[:-1])))) if len(key) else at
                n = np.diff(np.append(first, len(key)))
                key, third = key[first], third[first]
                cuts = np.append(np.searchsorted(key, bounds), len(key))
                rows = []
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    k, c, m = (x[cuts[s] : cuts[s + 1]] for x in (key, third, n))
                    step = np.diff(k >> 32, prepend=0).astype("<u4")
                    rows.append((s, squeeze.compress(b"".join([step.tobytes(), (k & 0xFFFFFFFF).astype("<u4").tobytes(), c.astype("<u4").tobytes(), m.astype("<u4").tobytes()]))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "block"])

    return docs.select(bodies(F.col("text"))).mapInArrow(work, "shard int, block binary")


def write_shards(blocks: DataFrame, folder: str, pieces: list[tuple[int, int]]) -> DataFrame:
    """One trie file per shard; returns ``shard`` and ``followers``, the distinct words after its first word."""

    def build(table: pa.Table) -> pa.Table:
        vocabulary, plain = Vocabulary(folder, pieces), zstandard.ZstdDecompressor()
        shard, keys, thirds, counts = table["shard"][0].as_py(), [], [], []
        for block in table["block"]:
            step, b, c, n = np.frombuffer(plain.decompress(block.as_py()), "<u4").reshape(4, -1)
            keys.append(np.cumsum(step, dtype=np.int64) << 32 | b)
            thirds.append(c)
            counts.append(n)
        key, third, n = np.concatenate(keys), np.concatenate(thirds), np.concatenate(counts).astype(np.int64)
        del keys, thirds, counts
        order = np.lexsort((third, key))
        key, third, n = key[order], third[order], n[order]
        save(f"{folder}/trie-{shard}", trie(key, third, n, vocabulary))
        own = key[: np.searchsorted(key, (key[0] >> 32) + 1 << 32)]
        return pa.table({"shard": pa.array([shard], pa.int32()), "followers": [len(starts_of(own))]})

    return blocks.groupBy("shard").applyInArrow(build, "shard int, followers long")


def starts_of(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))


def trie(key: np.ndarray, third: np.ndarray, n: np.ndarray, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """The levels of a shard from its sorted (first, second, third, count) rows; a third of NONE ends a text."""
    width = vocabulary.size + 1
    same = key.astype(np.uint64) * np.uint64(1)
    first = np.flatnonzero(np.concatenate(([True], (same[1:] != same[:-1]) | (third[1:] != third[:-1]))))
    n, key, third = np.add.reduceat(n, first), key[first], third[first]
    pair = starts_of(key)
    pair_n = np.add.reduceat(n, pair)
    word, second = key[pair] >> 32, key[pair] & 0xFFFFFFFF
    root = starts_of(word)
    roots = word[root]
    total = counts_of(vocabulary, roots)
    parent = np.repeat(np.arange(len(root)), np.diff(np.append(root, len(word))))
    out = {"roots": EliasFano.build(roots, width), "pairs": EliasFano.build(parent * width + second, len(root) * width), "pair_at": EliasFano.build(np.append(root, len(word)), len(word) + 1)}
    alpha2 = (pair_n - D) / total[parent]
    owner = np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(key))))
    followed = np.bincount(owner, np.where(third != NONE, n, 0), len(pair))
    kept = third != NONE
    alpha3 = (n[kept] - D) / followed[owner[kept]]
    bow2 = 1 - np.bincount(owner[kept], alpha3, len(pair))
    out["triples"] = EliasFano.build(owner[kept] * width + third[kept], max(1, len(pair) * width))
    out["triple_at"] = EliasFano.build(np.searchsorted(owner[kept], np.arange(len(pair) + 1)), int(kept.sum()) + 1)
    arrays = {f"{k}.{name}": x for k, ef in out.items() for name, x in ef.arrays().items()}
    return arrays | {"alpha2": quantise(alpha2), "alpha3": quantise(alpha3), "bow2": quantise(np.maximum(bow2, 1e-12))}


def counts_of(vocabulary: Vocabulary, ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids), np.int64)
    cuts = np.searchsorted(ids, vocabulary.starts)
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        if vocabulary.names[i] is not None:
            out[cuts[i] : cuts[i + 1]] = vocabulary.files[vocabulary.names[i]]["count"][ids[cuts[i] : cuts[i + 1]] - vocabulary.starts[i]]
    return out


class Shard:
    def __init__(self, uri: str) -> None:
        a = load(uri)
        self.roots, self.pairs, self.pair_at, self.triples, self.triple_at = (EliasFano.of({n: a[f"{k}.{n}"] for n in ("meta", "low", "high", "ones", "zeros")}) for k in ("roots", "pairs", "pair_at", "triples", "triple_at"))
        self.alpha2, self.alpha3, self.bow2 = a["alpha2"], a["alpha3"], a["bow2"]

    def children(self, root: np.ndarray) -> np.ndarray:
        return self.pair_at.get(root + 1) - self.pair_at.get(root)


class Model:
    """The whole trie: its vocabulary and shards, opened when first used. ``present`` has the shards that there are, each with
    the number of distinct words after its first word."""

    def __init__(self, folder: str, pieces: list[tuple[int, int]], bounds: np.ndarray, present: dict[int, int]) -> None:
        self.folder, self.bounds, self.present = folder, bounds, present
        self.vocabulary = Vocabulary(folder, pieces)
        self.open = Opened(Shard)

    def shard(self, s: int) -> Shard | None:
        return self.open[f"{self.folder}/trie-{s}"] if s in self.present else None

    @cached_property
    def split_roots(self) -> tuple[np.ndarray, np.ndarray]:
        """The words that several shards hold, each of which has no other, and their distinct followers."""
        split = np.unique(self.bounds[self.bounds & 0xFFFFFFFF > 0] >> 32)
        held = np.array([self.present.get(s, 0) for s in range(len(self.bounds))], np.int64)
        before = np.concatenate(([0], np.cumsum(held)))
        return split, before[np.searchsorted(self.bounds, (split + 1) << 32)] - before[np.searchsorted(self.bounds, split << 32)]

    def logs(self, ids: np.ndarray, counts: np.ndarray, last: np.ndarray) -> np.ndarray:
        """log10 probability of each token; ``last`` marks the ends of texts."""
        v = self.vocabulary
        width = v.size + 1
        p = (counts + 0.5) / (v.total + 0.5 * (v.size + 1))
        at = np.flatnonzero(~last[:-1] & (ids[:-1] < v.size))  # contexts with a successor
        key = ids[at] << 32 | ids[at + 1]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        cuts = np.append(np.searchsorted(key, self.bounds), len(key))
        split, followed = self.split_roots
        # Codes of trigrams and back-off weights by place: nothing, and all to the pair.
        a3, b2 = np.full(len(ids), 65535, "<u2"), np.zeros(len(ids), "<u2")
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            shard = self.shard(s)
            here, k = at[cuts[s] : cuts[s + 1]], key[cuts[s] : cuts[s + 1]]
            word = k >> 32
            first = starts_of(word)
            times = np.diff(np.append(first, len(word)))
            root = shard.roots.find(word[first]) if shard else np.full(len(first), -1)
            followers = np.zeros(len(first))
            if shard:
                followers[root >= 0] = shard.children(root[root >= 0])
            if len(split):
                place = np.minimum(np.searchsorted(split, word[first]), len(split) - 1)
                followers = np.where(split[place] == word[first], followed[place], followers)
            n = np.repeat(np.maximum(1, counts[here[first]]), times)
            bow = np.repeat(followers, times) * D / n
            none = bow == 0  # a context that nothing follows in training
            root = np.repeat(root, times)
            node = np.full(len(k), -1, np.int64)
            if shard:
                some = root >= 0
                node[some] = shard.pairs.find(root[some] * width + (k[some] & 0xFFFFFFFF))
            alpha = np.zeros(len(k))
            alpha[node >= 0] = _VALUES[shard.alpha2[node[node >= 0]]] if shard else 0
            p[here + 1] = np.where(none, p[here + 1], alpha + bow * p[here + 1])
            go = np.flatnonzero((node >= 0) & ~last[here + 1])
            if len(go):
                context = node[go]
                kid = shard.triples.find(context * width + ids[here[go] + 2])
                a3[here[go[kid >= 0]] + 2] = shard.alpha3[kid[kid >= 0]]
                b2[here[go] + 2] = shard.bow2[context]
        return np.log10(_VALUES[a3] + _VALUES[b2] * p)


def train(docs: DataFrame, folder: str) -> tuple[list[tuple[int, int]], np.ndarray, dict[int, int]]:
    """Counts and writes the model of ``docs`` (column ``text``); returns what ``Model`` needs."""
    pieces = count_words(docs, folder)
    bounds = shard_bounds(docs.sparkSession.read.parquet(f"{folder}/words"), folder, pieces)
    shards = write_shards(count_ngrams(docs, folder, pieces, bounds), folder, pieces)
    return pieces, bounds, {r["shard"]: r["followers"] for r in shards.collect()}


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, folder: str, pieces: list[tuple[int, int]], bounds: np.ndarray, present: dict[int, int]) -> DataFrame:
    """Scores of ``doc_id``, ``text`` by a trained model."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(folder, pieces, bounds, present)
        v = model.vocabulary
        for batch in batches:
            for a, b, flat, offsets in chunks(batch.column(2).to_pylist(), grown(len(bounds))):
                ids, counts = v.find(flat)
                last = np.zeros(len(ids), bool)
                last[offsets[1:] - 1] = True
                base = np.log10((counts + 0.5) / (v.total + 0.5 * (v.size + 1)))
                logs = model.logs(ids, counts, last)
                total = lambda x: np.add.reduceat(x, offsets[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(total((counts > 0).astype(np.int64))), pa.array(np.full(b - a, v.total)), pa.array(total(base)), pa.array(total(logs))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), bodies(F.col("text")))
    return rows.mapInArrow(work, SCORES)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = shared_dir(spark)
    return score(docs, folder, *train(docs.where(~held_out(F.col("doc_id"))), folder))
