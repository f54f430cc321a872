"""Repeated strings from merged Burrows-Wheeler transforms: shards are merged by iterative interleave refinement.

A shard's transform lists, for its suffixes in order, the byte before each. Two shards' suffixes interleave in one order;
the interleave starts as one shard after the other, and a pass moves it from the order by h - 1 bytes to that by h: a
stable distribution of the places by the byte before them. A place that a pass first sets apart from the one before it
shares h - 1 bytes with it, so common prefixes come with the merge and no suffix is sorted again. Passes end at
``depth``: places never set apart are suffixes that share so many bytes, the repeated intervals.

This is the method by its name, for shards that fit a task. A pass touches every suffix, so ``depth`` passes at each
level of merging cost more than the budget of ``repeats``, which gives the same result (see the README for figures).

Defined results: texts end in terminators that never match; empty texts have no suffix that counts; without texts there
is nothing; equal suffixes keep the order of shards and texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shard:
    """``before``: per suffix in order, the byte before it plus 1, 0 at the start of a text; ``start``: where it begins."""

    before: np.ndarray
    start: np.ndarray
    #: Whether a suffix shares ``depth`` bytes with the one before it.
    deep: np.ndarray


def laid_out(texts: list[bytes]) -> np.ndarray:
    """All texts end to end, each byte plus 1, each text closed by a 0."""
    return np.concatenate([np.zeros(0, np.int16), *(np.append(np.frombuffer(t, "u1").astype(np.int16) + 1, np.int16(0)) for t in texts)])


def build(texts: list[bytes], base: int, depth: int) -> Shard:
    """The transform of a few texts, by prefix doubling; ``base`` is added to the starts."""
    data = laid_out(texts)
    n = len(data)
    if not n:
        return Shard(data, np.zeros(0, np.int64), np.zeros(0, bool))
    # Terminators differ and come first, in order of their texts.
    key = np.where(data == 0, np.cumsum(data == 0) - 1, len(texts) + data.astype(np.int64))
    rank, width = np.unique(key, return_inverse=True)[1], 1
    while width < n and len(np.unique(rank)) < n:
        after = np.append(rank[width:] + 1, np.zeros(min(width, n), np.int64))[:n]
        rank, width = np.unique(rank * (n + 1) + after, return_inverse=True)[1], 2 * width
    order = np.argsort(rank, kind="stable")
    return refine(Shard(data[order - 1], order + base, np.zeros(n, bool)), None, depth)


def refine(a: Shard, b: Shard | None, depth: int) -> Shard:
    """The interleave of two shards (or one shard's own common prefixes), by at most ``depth`` passes."""
    before = [a.before] + ([b.before] if b else [])
    n = sum(map(len, before))
    which = np.repeat(np.arange(len(before), dtype=np.int8), [len(x) for x in before])
    apart = np.zeros(n, np.int16)  # the pass that set a place apart; 0: none yet
    if n:
        apart[0] = 1
    for h in range(1, depth + 1):
        merged = np.empty(n, np.int16)
        for k, x in enumerate(before):
            merged[which == k] = x
        block = np.maximum.accumulate(np.where((apart > 0) & (apart < h), np.arange(n), 0))
        order = np.argsort(merged, kind="stable")
        merged, block = merged[order], block[order]
        new = np.concatenate(([True], (merged[1:] != merged[:-1]) | (block[1:] != block[:-1]) | (merged[1:] == 0)))[:n]
        moved = which[order]
        settled = bool((apart[new] > 0).all()) and np.array_equal(moved, which)
        apart[new & (apart == 0)] = h
        which = moved
        if settled:
            break
    start = np.empty(n, np.int64)
    merged = np.empty(n, np.int16)
    for k, x in enumerate([a, b][: len(before)]):
        start[which == k], merged[which == k] = x.start, x.before
    return Shard(merged, start, apart == 0)


def merge(shards: list[Shard], depth: int) -> Shard:
    """All shards, two and two."""
    while len(shards) > 1:
        shards = [refine(*shards[i : i + 2], depth) if i + 1 < len(shards) else shards[i] for i in range(0, len(shards), 2)]
    return shards[0]


def repeated(texts: list[bytes], depth: int, shard_bytes: int = 1 << 20) -> list[np.ndarray]:
    """Per text, whether each byte is covered by a string of ``depth`` bytes that starts anywhere else too."""
    shards, group, size, at = [], [], 0, 0
    for t in texts:
        group.append(t)
        size += len(t) + 1
        if size >= shard_bytes:
            shards.append(build(group, at, depth))
            group, at, size = [], at + size, 0
    shards.append(build(group, at, depth))
    whole = merge(shards, depth)
    twice = whole.deep | np.append(whole.deep[1:], False) if len(whole.deep) else whole.deep
    marks = np.zeros(len(laid_out(texts)) + 1, np.int64)
    np.add.at(marks, whole.start[twice], 1)
    np.add.at(marks, np.minimum(whole.start[twice] + depth, len(marks) - 1), -1)
    covered, out, at = np.cumsum(marks[:-1]) > 0, [], 0
    for t in texts:
        out.append(covered[at : at + len(t)])
        at += len(t) + 1
    return out
