"""Best-fit packing by bin completion: documents' tokens into as few sequences of at most ``CAPACITY`` as it can.

Only the number of pieces of each length matters to the plan, so the plan's input has at most ``CAPACITY``
rows whatever the corpus. Items are taken from the largest down; each bin is completed around the largest
item left by an undominated filling: none of which some items could give way to a larger one left out, or to
one of their total, that still fits. The incumbent is best-fit decreasing, computed on counts: equal bins
are one group. If it meets the bound ceil(total / capacity), raised by the number of items over half a bin,
it is optimal. Otherwise branch and bound goes through completions depth-first, cutting a branch once the
waste so far exceeds what a better solution can have. ``NODES`` steps bound it, first on all items, then on those
of the loosest bins; without that bound (``nodes=None``) it ends at an optimal plan.

The plan lists, per length, runs of ranks and where they go. Pieces get their rank within their length from
counts per task (no window over a hot length), and find their place by binary search.

Tokens: words are cut at blanks and encoded once per Python worker, while a cache of ``CACHE`` words holds them; the
tokenizer splits at white space itself, so ids are those of the whole text.

Defined results: null and empty texts have the end id alone; rows with a null doc_id are packed like others;
repeated rows are packed each; pieces of equal length take places in order of task and row; texts of any length are encoded
whole; an empty table gives no row; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import shared_dir, written

CAPACITY = 4096
END = 1
NODES = 20_000
CACHE = 1_000_000
#: Characters of texts whose words are learnt together.
GROUP = 1 << 23
_SIGNS = frozenset(".,;:!?")
#: Letters whose lower case depends on their place or takes several characters.
_PLACED = re.compile("[\u0130\u03a3]")

#: A plan: bins as (number of equal bins, lengths in each).
Plan = list[tuple[int, list[int]]]


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing on counts per length."""
    open_bins: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # by room left
    rooms = np.zeros(capacity + 1, bool)
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            fits = np.flatnonzero(rooms[length:])
            room = int(fits[0]) + length if len(fits) else capacity
            times, held = open_bins[room].pop() if len(fits) else (n, [])
            if not open_bins[room]:
                rooms[room] = False
            each = min(room // length, n)
            full = min(times, n // each)
            if full < times and held:
                open_bins[room].append((times - full, held))
                rooms[room] = True
            left = room - each * length
            open_bins[left].append((full, held + [length] * each))
            rooms[left] = True
            n -= full * each
    return [g for groups in open_bins.values() for g in groups]


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing has fewer bins: total over capacity; items over a half, with what must go beside them."""
    total = sum(k * n for k, n in counts.items())
    bound = -(-total // capacity)
    big = sorted((k for k in counts if 2 * k > capacity), reverse=True)
    for cut in {capacity - k for k in big} | {capacity // 2}:
        if cut > capacity // 2:
            continue
        wide = sum(counts[k] for k in big if k > capacity - cut)
        halves = [k for k in big if k <= capacity - cut]
        room = sum((capacity - k) * counts[k] for k in halves)
        small = sum(k * n for k, n in counts.items() if cut <= k and 2 * k <= capacity)
        bound = max(bound, wide + sum(counts[k] for k in halves) + max(0, -(-(small - room) // capacity)))
    return bound


def _dominated(lengths: list[int], left: dict[int, int], taken: dict[int, int], waste: int) -> bool:
    """Whether an item left out is worth more in the bin than some items in it: it takes their place and still fits.

    Swapping those items for the larger one (or one of the same total) can only make the rest easier to pack.
    """
    one, many = 1, 0  # bit s: a sum s of at most one item, of two or more
    for k, n in taken.items():
        for _ in range(n):
            many |= (many << k) | ((one & ~1) << k)
            one |= 1 << k
    sums = one | many
    for x in lengths:
        if left[x] > taken.get(x, 0):
            low = max(0, x - waste)
            if (sums >> low) & ((1 << (x - low)) - 1) or (many >> x) & 1:
                return True
    return False


def fillings(lengths: list[int], left: dict[int, int], room: int, slack: int, spend: Callable[[], None]) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of ``room`` that waste at most ``slack``, larger items first. ``lengths`` descend; ``spend`` is called for each step."""
    taken: dict[int, int] = {}

    def deeper(i: int, room: int) -> Iterator[tuple[int, ...]]:
        spend()
        for j in range(bisect_left(lengths, -room, i, key=lambda k: -k), len(lengths)):
            k = lengths[j]
            for n in range(min(room // k, left[k]), 0, -1):
                taken[k] = n
                yield from deeper(j + 1, room - n * k)
                del taken[k]
        if room <= slack and not _dominated(lengths, left, taken, room):
            yield tuple(k for k, n in taken.items() for _ in range(n))

    yield from deeper(0, room)


class _Spent(Exception):
    pass


def complete(counts: dict[int, int], capacity: int, incumbent: Plan, nodes: int | None) -> tuple[Plan, bool]:
    """Bin completion from the incumbent on: the best plan found, and whether it is proven to be one of the fewest bins.

    Depth-first over the fillings around the largest item left, each tried in multiples, with a stack of its own. A
    branch is cut once its waste leaves no room for a better plan, or where its items left (known by 128-bit digests) were
    reached with as few bins. All branches share ``left``, so that memory goes with the steps and not with the lengths.
    """
    best, used, least = incumbent, sum(n for n, _ in incumbent), lower_bound(counts, capacity)
    lengths, left, total = sorted(counts, reverse=True), dict(counts), sum(k * n for k, n in counts.items())
    steps, reached = 0, {}

    def spend() -> None:
        nonlocal steps
        steps += 1
        if nodes is not None and steps > nodes:
            raise _Spent

    def branches(bins: int, waste: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        state = blake2b(np.fromiter(left.values(), np.int64, len(left)), digest_size=16).digest()
        if reached.get(state, used) <= bins:
            return
        reached[state] = bins
        top = next(k for k in lengths if left[k])
        slack = (used - 1) * capacity - total - waste
        # Whenever a step is asked for, ``left`` is as it was at first: no branch needs a copy.
        found = fillings(lengths, left, capacity - top, slack, spend)
        best_first = nodes is None
        while True:
            left[top] -= 1
            if best_first:
                found, best_first = iter(sorted(found, key=lambda items: -sum(items))), False
            items = next(found, None)
            left[top] += 1
            if items is None:
                return
            filling = (top, *items)
            for times in range(min(left[k] // filling.count(k) for k in set(filling)), 0, -1):
                yield times, filling

    path: Plan = []
    bins = waste = 0
    stack = [branches(0, 0)]
    try:
        while stack and used > least:
            if path and len(path) == len(stack):
                times, filling = path.pop()
                for k in filling:
                    left[k] += times
                bins, waste = bins - times, waste - times * (capacity - sum(filling))
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
                continue
            times, filling = step
            for k in filling:
                left[k] -= times
            path.append((times, list(filling)))
            bins, waste = bins + times, waste + times * (capacity - sum(filling))
            if not any(left.values()):
                if bins < used:
                    best, used = list(path), bins
                stack.append(iter(()))
            elif bins >= used - 1 or waste > (used - 1) * capacity - total:
                stack.append(iter(()))
            else:
                stack.append(branches(bins, waste))
    except _Spent:
        return best, used <= least
    return best, True


def pack(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = NODES) -> Plan:
    """As few bins as found: within ``nodes`` steps, or, without that bound, as few as there can be.

    With a bound, the search is tried on all items, then on those of bins that aren't full, the fullest bins last, so that
    it reaches whole plans at any size: full bins waste nothing and stay as they are.
    """
    counts = {k: n for k, n in counts.items() if n}
    best = best_fit(counts, capacity)
    if not counts or sum(n for n, _ in best) <= lower_bound(counts, capacity):
        return best
    best, proven = complete(counts, capacity, best, nodes)
    if proven or nodes is None:
        return best
    for most in (1, 4, 16, 64):
        loose = sorted((g for g in best if sum(g[1]) < capacity), key=lambda g: sum(g[1]))
        part, room = [], most * 4
        for n, items in loose:
            part.append((min(n, room), items))
            room -= part[-1][0]
            if not room:
                break
        inside: dict[int, int] = defaultdict(int)
        for n, items in part:
            for k in items:
                inside[k] += n
        better, _ = complete(inside, capacity, part, nodes)
        if sum(n for n, _ in better) < sum(n for n, _ in part):
            gone = {id(items): n for n, items in part}
            best = [(n - gone.get(id(items), 0), items) for n, items in best if n > gone.get(id(items), 0)] + better
            if sum(n for n, _ in best) <= lower_bound(counts, capacity):
                break
    return best


class Places:
    """The plan turned round: from a length and a rank to a sequence and an offset."""

    def __init__(self, plan: Plan) -> None:
        runs, taken, sequence = [], defaultdict(int), 0
        for times, items in sorted(plan, key=lambda g: g[1]):
            offset = 0
            for k in items:
                runs.append((k, taken[k], sequence, offset))
                taken[k] += times
                offset += k
            sequence += times
        runs.sort()
        self.length, self.rank, self.sequence, self.offset = (np.array(x, np.int64) for x in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 4

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        big = np.int64(1) << 44
        at = np.searchsorted(self.length * big + self.rank, length.astype(np.int64) * big + rank, "right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


def plain_tokenizer(path: str):
    """The same vocabulary and merges without normalizing and matching, for words that need neither; None for files of another kind.

    It holds for words of lower-case letters where the file's own steps are NFC, lower case, and runs of letters as one piece.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    steps = [x["type"] for x in (file.get("normalizer") or {}).get("normalizers", [])]
    cuts = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cuts] != ["Split", "ByteLevel"] or r"|[\p{L}]+|" not in cuts[0]["pattern"].get("Regex", "") or file.get("post_processor"):
        return None
    return Tokenizer.from_str(json.dumps({**file, "normalizer": None, "pre_tokenizer": cuts[1], "added_tokens": []}))


class Words(dict):
    """Ids by word as bytes. Half full, its words become the old half, of which those that are asked for again stay.

    A word of lower-case letters is encoded by its letters alone; one with a sign at its end has the ids of both parts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.plain, self.old = Tokenizer.from_file(path), plain_tokenizer(path), {}

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHE // 2:
            self.old = dict(self)
            self.clear()
            new = words
        self.update((w, self.old[w]) for w in new if w in self.old)
        new, ended = [w for w in new if w not in self], []
        if self.plain:
            ended = [w for w in new if w[-1:] in _SIGNS and _is_plain(w[:-1])]
            letters = {w for w in new if _is_plain(w)}.union(w[:-1] for w in ended)
            fresh = [w for w in letters if w not in self]
            for w, found in zip(fresh, self.plain.encode_batch_fast(fresh, add_special_tokens=False)):
                self[w] = array("I", found.ids).tobytes()
            for w in _SIGNS:
                if w not in self:
                    self[w] = self.encode(w)
            self.update((w, self[w[:-1]] + self[w[-1]]) for w in ended)
        for w in new:
            if w not in self:
                self[w] = self.encode(w)


def _is_plain(word: str) -> bool:
    """Whether a word has lower-case letters alone, each as the tokenizer's own steps leave it."""
    if word.isascii():
        return word.isalpha() and word.islower()
    return word.isalpha() and word.lower() == word and not _PLACED.search(word) and unicodedata.is_normalized("NFC", word)


def _lowered(text: str) -> str:
    """The lower case that the tokenizer makes, of texts where it goes character by character; others stay."""
    if text.isascii() or not _PLACED.search(text) and unicodedata.is_normalized("NFC", text):
        return text.lower()
    return text


def encoder(path: str) -> Callable[[list[str]], Iterator[np.ndarray]]:
    """From texts to their ids; what a Python worker has learnt stays for its next tasks."""
    import tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    held = tokenizers.__dict__.setdefault("_keysift_words", {})
    known = held.get(path) or held.setdefault(path, Words(path))

    def group(texts: list[str]) -> Iterator[np.ndarray]:
        words = pc.ascii_split_whitespace(pa.array([_lowered(t) for t in texts], pa.large_string()))
        coded = words.flatten().dictionary_encode()
        distinct, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        known.learn(distinct)
        parts = [known[w] for w in distinct]
        flat = np.frombuffer(b"".join(parts), "<u4")
        # A group has fewer ids than fit 32 bits.
        size = np.fromiter(map(len, parts), np.int32, len(parts)) // np.int32(4)
        start = np.cumsum(size, dtype=np.int32) - size
        counts = size[at]
        ends = np.concatenate((np.zeros(1, np.int32), np.cumsum(counts, dtype=np.int32)))
        ids = flat[np.repeat(start[at] - ends[:-1], counts) + np.arange(ends[-1], dtype=np.int32)]
        cuts = ends[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        yield from (ids[a:z] for a, z in zip(cuts, cuts[1:]))

    def encode(texts: list[str]) -> Iterator[np.ndarray]:
        first, size = 0, 0
        for k, text in enumerate(texts):
            size += len(text)
            if size > GROUP or k + 1 == len(texts):
                yield from group(texts[first : k + 1])
                first, size = k + 1, 0

    return encode


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of documents, with their rank among the task's pieces of that length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, task = encoder(tokenizer), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        end = np.array([END], "<u4").tobytes()
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        for batch in batches:
            rows = []
            for doc, found in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()])):
                ids = memoryview(found.tobytes() + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(part), task, int(seen[n])))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, PIECES)


def pack_documents(docs: DataFrame, folder: str, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` per piece."""
    from pyspark.sql import Window

    cut = written(pieces(docs, tokenizer, capacity), folder, "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = written(by_task.withColumn("base", before), folder, "bases")
    # One row per length: at most ``capacity`` rows.
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(pack(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = places.find(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(bases, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, shared_dir(spark), default_tokenizer())
