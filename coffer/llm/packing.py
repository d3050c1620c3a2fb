"""Packing of token sequences: non-negative least squares over shallow length combinations.

Pieces are cut at the window. A block's remainders make a histogram of length classes. Every combination of at most
``DEPTH`` classes that fills the window exactly is a candidate; non-negative least squares gives each one's repeat
count, counts are rounded, and what is left is packed greedily (longest first, best fit). What doesn't fill a
window at the end of a partition is cut at powers of two, which need no padding.

Each partition is packed by itself, in blocks of a bounded number of tokens, so nothing is shuffled, a hot source or
length needs no special care, and a lost task is packed again to the same result.

Null text counts as empty (its document is the end token alone); null ids, repeated rows and extra columns pass, as rows
are never joined; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import arrow, texts
from coffer.llm.tokens import encoder

WINDOW, CLASS, DEPTH, END = 2048, 16, 3, 1
#: Tokens of a block; about 4 bytes each are held.
BLOCK_TOKENS = 6_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(units: int, depth: int) -> np.ndarray:
    """All multisets of at most ``depth`` positive classes that sum to ``units``: rows of counts by class."""
    found: list[list[int]] = []

    def grow(left: int, least: int, parts: list[int]) -> None:
        if left == 0:
            found.append(parts)
        elif len(parts) < depth:
            for x in range(least, left + 1):
                if x == left or left - x >= x:
                    grow(left - x, x, [*parts, x])

    grow(units, 1, [])
    out = np.zeros((len(found), units + 1), dtype=np.float64)
    for row, parts in zip(out, found, strict=True):
        for x in parts:
            row[x] += 1
    return out


@functools.cache
def window_combinations(units: int, depth: int) -> np.ndarray:
    return combinations(units, depth)


def nnls(a: np.ndarray, b: np.ndarray, weights: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that nearly minimises the weighted ``|a @ x - b|``, by accelerated projected gradients (deterministic)."""
    aw = a * weights[:, None]
    bw = b * weights
    v = np.ones(a.shape[1])
    for _ in range(20):
        v = aw.T @ (aw @ v)
        v /= max(np.linalg.norm(v), 1e-30)
    step = 1 / max(float(v @ (aw.T @ (aw @ v))), 1e-30) / 1.05
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * (aw.T @ (aw @ y - bw)), 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(lengths: list[int], window: int = WINDOW, step: int = CLASS, depth: int = DEPTH) -> tuple[list[list[int]], list[list[int]]]:
    """Packs items of 1 to window-1 tokens. Gives groups of item numbers: full ones, and those with over ``step`` tokens free."""
    stacks: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        stacks.setdefault(n, []).append(i)
    kept = sorted(stacks)  # lengths that are left

    def take(low: int, high: int) -> int | None:
        """An item of the greatest length from low to high."""
        at = bisect.bisect_right(kept, high) - 1
        if at < 0 or kept[at] < low:
            return None
        n = kept[at]
        item = stacks[n].pop()
        if not stacks[n]:
            del kept[at]
        return item

    groups: list[list[int]] = []
    units = window // step
    histogram = np.zeros(units + 1)
    for n in lengths:
        histogram[-(-n // step)] += 1
    if len(lengths) >= 8:
        a = window_combinations(units, depth)
        used = a[:, : units + 1]
        weights = np.sqrt(np.arange(units + 1) / units)
        repeats = np.floor(nnls(used.T, histogram, weights) + 0.5).astype(int)
        for row in np.argsort(-repeats, kind="stable"):
            if repeats[row] <= 0:
                break
            parts = [x for x in range(units, 0, -1) for _ in range(int(a[row, x]))]
            for _ in range(repeats[row]):
                group, room = [], window
                for k, x in enumerate(parts):
                    last = k == len(parts) - 1
                    item = take(max(1, room - step) if last else (x - 1) * step + 1, room if last else min(room, x * step))
                    if item is None:
                        break
                    group.append(item)
                    room -= lengths[item]
                if len(group) == len(parts):
                    groups.append(group)
                else:  # the histogram ran out of one of its lengths
                    for item in group:
                        n = lengths[item]
                        if n not in stacks or not stacks[n]:
                            stacks.setdefault(n, [])
                            bisect.insort(kept, n)
                        stacks[n].append(item)
                    break
    open_groups: list[list[int]] = []
    while kept:  # residuals: longest first, each followed by the longest that still fit
        room, group = window, []
        while (item := take(1, room)) is not None:
            group.append(item)
            room -= lengths[item]
        (groups if room <= step else open_groups).append(group)
    return groups, open_groups


class Packer:
    """Collects documents' ids and yields rows of pieces."""

    def __init__(self, partition: int, window: int = WINDOW, block: int = BLOCK_TOKENS):
        self.window, self.block, self.next, self.held = window, block, partition << 40, 0
        self.items: list[tuple] = []  # doc_id, start, ids, doc_tokens
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        for start in range(0, len(ids), self.window):
            piece = (doc, start, ids[start : start + self.window], len(ids))
            if len(piece[2]) == self.window:
                self._emit([piece])
            else:
                self.items.append((doc, start, piece[2].copy(), len(ids)))
                self.held += len(piece[2])
        if self.held >= self.block:
            self.pack(False)

    def pack(self, last: bool) -> None:
        groups, rest = plan([len(x[2]) for x in self.items], self.window)
        for group in groups:
            self._emit([self.items[i] for i in group])
        self.items = [self.items[i] for group in rest for i in group]
        self.held = sum(len(x[2]) for x in self.items)
        if last or self.held >= self.block // 2:
            self._flow()

    def _flow(self) -> None:
        """Lays the items end to end, cut at the window, and at last at powers of two."""
        left, pieces, room = self.held, [], 0
        for doc, start, ids, total in self.items:
            while len(ids):
                if not room:
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                part = ids[:room]
                pieces.append((doc, start, part, total))
                start, ids, room, left = start + len(part), ids[len(part) :], room - len(part), left - len(part)
                if not room:
                    self._emit(pieces)
                    pieces = []
        self.items, self.held = [], 0


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Packs every document of ``docs``. ``tokenizer``: path of the vocabulary file. Columns: ``SCHEMA``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId(), window)

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [[]] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                packer.add(doc, np.append(encode(text), np.uint32(END)))
            if packer.rows:
                yield rows()
        packer.pack(True)
        yield rows()

    return arrow(docs.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).alias("t")), run, SCHEMA)
