"""Minimizers of byte windows: in every window the run of so many bytes with the least hash, so equal windows have equal minimizers.

Runs may be of ``K`` bytes or longer ones; a run as long as the window is the window itself."""

from __future__ import annotations

import numpy as np

WINDOW, K = 50, 20
#: Bytes that are worked on together; small enough for a CPU's cache.
CHUNK = 1 << 16

_LETTERS = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _join(a: np.ndarray, b: np.ndarray, off: int, odd: int) -> np.ndarray:
    """Hashes of runs made of one in ``a`` and the one in ``b`` that starts so much later."""
    n = max(len(b) - off, 0)
    out = a[:n] * np.uint64(odd)
    out += b[off:]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def run_hashes(data: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all runs of k bytes, made of runs whose lengths are powers of two."""
    parts, width, h = [], 1, _LETTERS[data]
    while width <= k:
        if k & width:
            parts.append((width, h))
        if width * 2 <= k:
            h = _join(h, h, width, 2 * width.bit_length() + 1)
        width *= 2
    length, out = parts.pop()
    while parts:
        width, h = parts.pop()
        out = _join(out, h, length, 2 * length.bit_length() + 3)
        length += width
    return out


def _least_of(m: np.ndarray, span: int) -> np.ndarray:
    """Minima of so many consecutive elements."""
    width = 1
    while width * 2 <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    more = span - width
    return np.minimum(m[:-more], m[more:]) if more else m


def contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int = K) -> tuple[np.ndarray, ...]:
    """Of documents at ``data[starts:ends]``: number of the document, first and last window, place and hash of the minimizer,
    for each run of windows with one minimizer. Places count from the document's start."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < WINDOW:
        return none, none, none, none, none.astype(np.uint64)
    h = run_hashes(data, k)
    m = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # of equal hashes, the leftmost
    m = _least_of(m, WINDOW - k + 1)
    place = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
    long = ends - starts >= WINDOW
    at, first = np.flatnonzero(long), starts[long]
    sizes = ends[long] - first - WINDOW + 1
    total = int(sizes.sum())
    if not total:
        return none, none, none, none, none.astype(np.uint64)
    begins = np.cumsum(sizes) - sizes
    window = np.arange(total) + np.repeat(first - begins, sizes)
    own = place[window]
    change = np.r_[True, own[1:] != own[:-1]]
    change[begins] = True
    s = np.flatnonzero(change)
    e = np.r_[s[1:], total] - 1
    doc = np.searchsorted(begins, s, side="right") - 1
    base = first[doc]
    return at[doc], window[s] - base, window[e] - base, own[s] - base, h[own[s]]


def chunks(sizes: list[int], chunk: int = CHUNK):
    """Ranges of documents that are worked on together."""
    at = 0
    while at < len(sizes):
        to, n = at, 0
        while to < len(sizes) and (to == at or n + sizes[to] <= chunk):
            n += sizes[to]
            to += 1
        yield at, to
        at = to


def of_texts(raw: list[bytes], k: int = K) -> tuple[np.ndarray, ...]:
    """``contexts`` of whole texts."""
    found = []
    sizes = [len(x) for x in raw]
    for a, b in chunks(sizes):
        ends = np.cumsum(sizes[a:b])
        out = contexts(np.frombuffer(b"".join(raw[a:b]), np.uint8), ends - sizes[a:b], ends, k)
        found.append((out[0] + a, *out[1:]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (*[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64))
