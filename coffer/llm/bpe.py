"""Byte-pair encoding and decoding with a pair occurrence index.

The distinct words of a partition's batch are laid out in one array of ids. An index maps each mergeable pair to all its
positions; a heap holds the ranks that have positions. Ranks are applied in ascending order, to all their positions at
once, and only the lists of pairs beside a merge are updated. Words are cached in a worker up to ``CACHE_WORDS``.

Encoding is a projection over rows: no shuffle, no state between rows but the cache. Null text counts as empty (no ids);
null or repeated ids and extra columns pass; an empty table gives an empty result. Special tokens' strings in a text
become their ids, as the tokenizers library does by default.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import arrow, texts
from coffer.llm.tokens import PATTERN, vocabulary

CACHE_WORDS = 400_000
#: Characters of text whose new words are merged together.
BATCH_CHARS = 8_000_000
#: Code points up to here, and the common ones above, have the same class in every Unicode version at hand; others are split by the tokenizers library.
_UNSURE = regex.compile("[^\\x00-\\u0557\\u0561-\\u0586\\u05d0-\\u05ea\\u0620-\\u064a\\u1e00-\\u1eff\\u2000-\\u206f\\u20a0-\\u20bf\\u2190-\\u21ff\\u3040-\\u30ff\\u4e00-\\u9fa5\\uac00-\\ud7a3\\uff01-\\uff5e]")


class Merger:
    """The vocabulary's merges over batches of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        ids, merges, self.special = vocabulary(path)
        self.byte_id = np.array([ids[bytes([b])] for b in range(256)], dtype=np.int64)
        left, right, made = (np.array(x, dtype=np.int64) for x in zip(*merges, strict=True))
        self.left, self.right, self.made = left, right, made
        keys = left << 20 | right
        first = np.unique(keys, return_index=True)  # of equal pairs, the lowest rank
        self.keys, self.ranks = first[0], first[1]
        self.bytes_of = {i: b for b, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile(PATTERN)
        self.exact = Tokenizer.from_file(path).pre_tokenizer
        self.parts = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.cache: dict[str, tuple[int, str, bytes]] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; -1 where there is none."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and where each word begins (one more at the end)."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(words) else 0
        token = np.append(self.byte_id[np.frombuffer(b"".join(words), np.uint8)], -1)  # n: the end of every word
        following, before = np.arange(1, n + 2), np.arange(-1, n)
        following[ends - 1] = n
        before[ends - sizes] = n
        before[n] = following[n] = n
        alive = np.ones(n + 1, dtype=bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(positions: np.ndarray) -> None:
            ranks = self.rank(token[positions], token[following[positions]])
            positions, ranks = positions[ranks >= 0], ranks[ranks >= 0]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, p in zip(ranks[np.r_[0, cuts]].tolist(), np.split(positions, cuts), strict=True):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(heap, r)

        enter(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (token[at] == a) & (token[following[at]] == b)]
            if a == b and len(at) > 1:  # of overlapping positions, every second one from the left
                chained = np.r_[False, following[at[:-1]] == at[1:]]
                start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            if not len(at):
                continue
            gone = following[at]
            alive[gone] = False
            token[at] = self.made[r]
            after = following[gone]
            following[at] = after
            before[after] = at
            before[n] = n
            left = before[at]
            left = left[left != n]
            enter(np.unique(np.concatenate([left, at])))
        live = alive[:n]
        starts = np.r_[0, np.cumsum(live)][np.r_[0, ends]] if len(words) else np.zeros(1, dtype=np.int64)
        return token[:n][live], starts

    def words(self, text: str) -> list[str]:
        """Words of a text; special tokens' strings stand alone."""
        out: list[str] = []
        for part in self.parts.split(text) if self.parts and any(s in text for s in self.special) else (text,):
            if part in self.special:
                out.append(part)
            elif _UNSURE.search(part):
                out += [part[a:b] for _, (a, b) in self.exact.pre_tokenize_str(part)]
            else:
                out += self.split.findall(part)
        return out

    def learn(self, new: list[str]) -> None:
        """Puts words into the cache: number of ids, ids as text, decoded bytes."""
        ids, starts = self.merge([w.encode() for w in new])
        texts_of, flat, starts = [str(i) for i in ids.tolist()], ids.tolist(), starts.tolist()
        for w, a, b in zip(new, starts, starts[1:], strict=False):
            self.cache[w] = (b - a, ",".join(texts_of[a:b]), b"".join([self.bytes_of[i] for i in flat[a:b]]))

    def start(self) -> None:
        for s, i in self.special.items():
            self.cache[s] = (1, str(i), self.bytes_of[i])

    def encode_all(self, texts_in: list[str]) -> list[tuple[int, str, bytes]]:
        """Number of ids, ids joined by commas and decoded bytes of each text."""
        split = [self.words(t) for t in texts_in]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        if not self.cache:
            self.start()
        new = list(dict.fromkeys(w for words in split for w in words if w not in self.cache))
        if new:
            self.learn(new)
        get, out = self.cache.__getitem__, []
        for words in split:
            found = [get(w) for w in words]
            n, ids, raw = zip(*found, strict=True) if found else ((), (), ())
            out.append((sum(n), ",".join(ids), b"".join(raw)))
        return out


@functools.cache
def merger(path: str) -> Merger:
    return Merger(path)


def encode_ids(text: str | None, path: str) -> list[int]:
    """Ids of one text."""
    ids = merger(path).encode_all([text or ""])[0][1]
    return [int(x) for x in ids.split(",")] if ids else []


def decode(ids: list[int], path: str) -> str:
    """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
    of = merger(path).bytes_of
    return b"".join(of[i] for i in ids).decode("utf-8", errors="replace")


def encode(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids array<int>, decoded string; or, as the query wants them, the digests of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(tokenizer)
        held_ids: list = []
        held: list[str] = []
        size = 0

        def out() -> pa.RecordBatch:
            found = m.encode_all(held)
            decoded = [raw.decode("utf-8", errors="replace") for _, _, raw in found]
            if digests:
                third = pa.array([hashlib.sha256(ids.encode()).hexdigest() for _, ids, _ in found], pa.string())
                fourth = [hashlib.sha256(x.encode()).hexdigest() for x in decoded]
            else:
                third = pa.array([[int(x) for x in ids.split(",")] if ids else [] for _, ids, _ in found], pa.list_(pa.int32()))
                fourth = decoded
            arrays = [pa.array(held_ids, pa.int64()), pa.array([n for n, _, _ in found], pa.int64()), third, pa.array(fourth, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "third", "fourth"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                held_ids.append(i)
                held.append(t)
                size += len(t)
                if size >= BATCH_CHARS:
                    yield out()
                    held_ids, held, size = [], [], 0
        if held:
            yield out()

    kind, names = ("string", ("ids_sha256", "decoded_sha256")) if digests else ("array<int>", ("ids", "decoded"))
    made = arrow(docs.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).alias("t")), run, f"doc_id long, n_tokens long, third {kind}, fourth string")
    return made.withColumnsRenamed({"third": names[0], "fourth": names[1]})
