"""Burrows-Wheeler transforms of shards of strings, merged by iterative interleave refinement.

Each shard's strings are laid end to end in a circle. Its rotations are sorted once, within the shard, and its transform is the
symbol before each rotation in that order. A symbol is a run of bytes; runs of four are numbered in order, as long as 16 bits
hold the numbers, else runs of two are taken. The merged order of all shards' rotations is refined from "one shard after the
other": a stable sort of the shard numbers by the symbols in merged order gives the order by one symbol more. No rotation of
one shard is ever compared with one of another. Alongside, a position begins a block in the round in which it first differs
from its neighbour, which is the length of their common prefix; when the symbols make ``DEPTH`` bytes, the blocks are the
intervals of rotations whose first ``DEPTH`` bytes are equal.
"""

from __future__ import annotations

import numpy as np

DEPTH, SHARDS = 50, 4


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    s = keys[order]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(np.r_[False, s[1:] != s[:-1]])
    return out


def rotations(data: np.ndarray) -> np.ndarray:
    """Places of a shard's rotations, sorted by their first DEPTH = 50 bytes."""
    n = len(data)
    packed = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        packed = packed << np.uint64(8) | np.roll(data, -k).astype(np.uint64)
    r8 = _ranks(packed)
    r16 = _ranks(r8 * n + np.roll(r8, -8))
    r32 = _ranks(r16 * n + np.roll(r16, -16))
    return np.argsort(r32 * n + np.roll(r32, -(DEPTH - 32)))  # what is equal in so many bytes may stand in any order


def transform(data: np.ndarray) -> np.ndarray:
    """Sorted rotations of a shard."""
    return rotations(data)


def symbols_before(shards: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """Rounds of a merge, first to last: a symbol's width, and the symbol before each place of all shards' bytes (end to end).

    The widths add up to DEPTH = 50."""
    pair = np.concatenate([np.roll(d, 2).astype(np.uint16) << np.uint16(8) | np.roll(d, 1) for d in shards])
    four = np.concatenate([np.roll(d, 4).astype(np.uint32) << np.uint32(24) | np.roll(d, 3).astype(np.uint32) << np.uint32(16) | np.roll(d, 2).astype(np.uint32) << np.uint32(8) | np.roll(d, 1) for d in shards])
    known, number = np.unique(four, return_inverse=True)
    if len(known) > 1 << 16:
        return [(2, pair)] * (DEPTH // 2)
    return [(2, pair), *[(4, number.astype(np.uint16))] * (DEPTH // 4)]


def merge(orders: list[np.ndarray], rounds: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of shards' sorted rotations: the place (in the shards' bytes end to end) at each merged position, and its block after DEPTH bytes."""
    sizes = [len(o) for o in orders]
    offsets = np.cumsum([0, *sizes])[:-1]
    places = np.concatenate([o + b for o, b in zip(orders, offsets, strict=True)])
    transforms = {width: symbols[places] for width, symbols in rounds}  # by rank within the shard
    shard = np.repeat(np.arange(len(orders), dtype=np.uint8), sizes)
    source = np.arange(len(places), dtype=np.int32)
    runs = [np.arange(b, b + n, dtype=np.int32) for b, n in zip(offsets, sizes, strict=True)]
    block = np.zeros(len(places), dtype=np.int32)
    for width, _ in rounds:
        now = transforms[width][source]
        order = np.argsort(now, kind="stable")  # by counting, for 16 bits
        now, block, shard = now[order], block[order], shard[order]
        first = np.empty(len(now), dtype=bool)
        first[:1] = False
        np.not_equal(now[1:], now[:-1], out=first[1:])
        first[1:] |= block[1:] != block[:-1]
        block = np.cumsum(first, dtype=np.int32)
        for j, run in enumerate(runs):
            source[shard == j] = run
    return places[source], block


def least_owners(data: np.ndarray, sizes: np.ndarray, owners: np.ndarray, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """For strings end to end in ``data``: of each window of DEPTH bytes, string by string, the least owner of a string that holds the
    same window; and each string's number of windows."""
    windows = np.maximum(sizes - DEPTH + 1, 0)
    ends = np.cumsum(sizes)
    cuts = np.unique(np.linspace(0, len(sizes), min(shards, len(sizes)) + 1).astype(int))
    bounds = np.r_[0, ends][cuts]
    parts = [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False) if b > a]
    if not parts or not windows.any():
        return np.zeros(0, np.int64), windows
    place, block = merge([transform(d) for d in parts], symbols_before(parts))
    string = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    inside = np.arange(len(data), dtype=np.int32) + DEPTH <= np.repeat(ends, sizes)
    valid = inside[place]
    place, block = place[valid], block[valid]
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    least = np.minimum.reduceat(owners[string[place]], starts)
    out = np.empty(len(data), dtype=np.int64)
    out[place] = np.repeat(least, np.diff(np.r_[starts, len(block)]))
    return out[inside], windows
