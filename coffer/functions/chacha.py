"""ChaCha20-Poly1305 (RFC 8439) in numpy: all blocks of many messages with one key at once. Spark has no such function."""

from __future__ import annotations

import hmac
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the standard: the constant words, the quarter rounds of a double round, Poly1305's prime and clamp.
CONSTANT = np.frombuffer(b"expand 32-byte k", "<u4")
QUARTERS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
PRIME, CLAMP = (1 << 130) - 5, 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF
TAG = 16
#: Blocks that are computed at once, so that they stay in a cache; bytes of messages that are sealed or opened together.
PIECE, TOGETHER = 4096, 4 << 20
#: Blocks of a message that are authenticated one after another.
SEGMENT = 32
LIMB = np.uint64((1 << 26) - 1)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint32(n) | x >> np.uint32(32 - n)


def keystreams(key: bytes, parts: Sequence[tuple[bytes, int, int]]) -> np.ndarray:
    """Blocks of 64 bytes from a counter on, for each (nonce, counter, blocks), one after another."""
    sizes = [n for _, _, n in parts]
    ends = np.cumsum(sizes)
    counters = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat([first for _, first, _ in parts], sizes)
    nonces = np.frombuffer(b"".join(nonce for nonce, _, _ in parts), "<u4").reshape(-1, 3)
    out, whose = np.empty((ends[-1], 64), dtype=np.uint8), np.repeat(np.arange(len(parts)), sizes)
    for i in range(0, ends[-1], PIECE):
        some = slice(i, min(i + PIECE, ends[-1]))
        start = np.empty((16, some.stop - i), dtype=np.uint32)
        start[:4], start[4:12], start[12], start[13:] = CONSTANT[:, None], np.frombuffer(key, "<u4")[:, None], counters[some], nonces[whose[some]].T
        s = start.copy()
        for _ in range(10):
            for a, b, c, d in QUARTERS:
                for x, y, z, n in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
                    s[x] += s[y]
                    s[z] = _turn(s[z] ^ s[x], n)
        out[some] = np.ascontiguousarray((s + start).T).astype("<u4").view(np.uint8)
    return out


def _limbs(low: np.ndarray, high: np.ndarray, top: np.ndarray | int) -> list[np.ndarray]:
    """Numbers of 130 bits as five of 26 bits."""
    return [low & LIMB, low >> 26 & LIMB, (low >> 52 | high << 12) & LIMB, high >> 14 & LIMB, high >> 40 | np.uint64(top) << 24]


def authenticators(keys: Sequence[bytes], messages: Sequence[bytes]) -> list[bytes]:
    """Poly1305 of messages in whole blocks, at least one each, with a key each. All segments of ``SEGMENT`` blocks are summed side by side by
    powers of their key's r, and the segments' sums of a message by powers of r^SEGMENT."""
    rs = [int.from_bytes(key[:16], "little") & CLAMP for key in keys]
    sizes = np.array([len(m) // 16 for m in messages])
    segments = -(-sizes // SEGMENT)
    ends = np.cumsum(segments) * SEGMENT
    at = np.arange(sizes.sum()) + np.repeat(ends - np.cumsum(sizes), sizes)
    held = np.zeros((int(ends[-1]), 3), np.uint64)  # zeros, without a top bit, before a message change nothing
    held[at, :2], held[at, 2] = np.frombuffer(b"".join(messages), "<u8").reshape(-1, 2), 1
    held = held.reshape(-1, SEGMENT, 3)
    clamped = np.frombuffer(b"".join(r.to_bytes(16, "little") for r in rs), "<u8").astype(np.uint64).reshape(-1, 2)
    r = [np.repeat(x, segments) for x in _limbs(clamped[:, 0], clamped[:, 1], 0)]
    five = [x * 5 for x in r]
    h = _limbs(*held[:, 0].T)
    for i in range(1, SEGMENT):
        d = [sum((h[j] * (r[k - j] if j <= k else five[5 + k - j]) for j in range(1, 5)), h[0] * r[k]) for k in range(5)]
        for k in range(4):
            d[k + 1] += d[k] >> 26
            d[k] &= LIMB
        d[0] += (d[4] >> 26) * 5
        d[4] &= LIMB
        d[1] += d[0] >> 26
        d[0] &= LIMB
        h = [x + y for x, y in zip(d, _limbs(*held[:, i].T), strict=True)]
    sums = iter(zip(*(x.tolist() for x in h), strict=True))
    out = []
    for key, one, n in zip(keys, rs, segments.tolist(), strict=True):
        total, power = 0, pow(one, SEGMENT, PRIME)
        for _ in range(n):
            total = (total * power + sum(x << 26 * k for k, x in enumerate(next(sums)))) % PRIME
        out.append((total * one % PRIME + int.from_bytes(key[16:], "little") & (1 << 128) - 1).to_bytes(16, "little"))
    return out


def _message(data: bytes, sealed: bytes) -> bytes:
    return b"".join(x + bytes(-len(x) % 16) for x in (data, sealed)) + len(data).to_bytes(8, "little") + len(sealed).to_bytes(8, "little")


def stirred(raws: Sequence[bytes], stream: np.ndarray, starts: Sequence[int]) -> list[bytes]:
    """Each text with the bytes of the stream from its start on."""
    return [(np.frombuffer(raw, np.uint8) ^ stream[at : at + len(raw)]).tobytes() for raw, at in zip(raws, starts, strict=True)]


def _stir(raws: Sequence[bytes], key: bytes, nonces: Sequence[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Texts and keys of their tags."""
    parts = [(nonce, 0, 1 - (-len(raw) // 64)) for raw, nonce in zip(raws, nonces, strict=True)]
    stream = keystreams(key, parts).reshape(-1)
    starts = np.cumsum([0, *(64 * n for _, _, n in parts[:-1])]).tolist()
    return stirred(raws, stream, [at + 64 for at in starts]), [stream[at : at + 32].tobytes() for at in starts]


def seal_many(key: bytes, rows: Sequence[tuple[bytes, bytes, bytes]]) -> list[bytes]:
    """Ciphertext and tag of each (content, nonce, data)."""
    sealed, ones = _stir([raw for raw, _, _ in rows], key, [nonce for _, nonce, _ in rows])
    tags = authenticators(ones, [_message(data, x) for x, (_, _, data) in zip(sealed, rows, strict=True)])
    return [x + tag for x, tag in zip(sealed, tags, strict=True)]


def open_many(key: bytes, rows: Sequence[tuple[bytes, bytes, bytes]]) -> list[bytes | None]:
    """The content of each (sealed, nonce, data); null if the tag doesn't fit."""
    _, ones = _stir([b""] * len(rows), key, [nonce for _, nonce, _ in rows])
    tags = authenticators(ones, [_message(data, x[:-TAG]) for x, _, data in rows])
    fits = [len(x) >= TAG and hmac.compare_digest(tag, x[-TAG:]) for tag, (x, _, _) in zip(tags, rows, strict=True)]
    good = [row for row, fit in zip(rows, fits, strict=True) if fit]
    opened = iter(_stir([x[:-TAG] for x, _, _ in good], key, [nonce for _, nonce, _ in good])[0] if good else [])
    return [next(opened) if fit else None for fit in fits]


def seal_bytes(raw: bytes, key: bytes, nonce: bytes, data: bytes) -> bytes:
    """Ciphertext and tag."""
    return seal_many(key, [(raw, nonce, data)])[0]


def open_bytes(sealed: bytes, key: bytes, nonce: bytes, data: bytes) -> bytes | None:
    """The content; null if the tag doesn't fit."""
    return open_many(key, [(sealed, nonce, data)])[0]


def by_key(function: Callable[[bytes, list], list], rows: Sequence[tuple]) -> list:
    """``function`` of a key and its rows (content, nonce, data), over some ``TOGETHER`` bytes at once; null where something is null."""
    out, waiting, held = [None] * len(rows), defaultdict(list), Counter()

    def flush(key: bytes) -> None:
        places = waiting.pop(key)
        held.pop(key)
        for i, x in zip(places, function(key, [(rows[i][0], rows[i][2], rows[i][3]) for i in places]), strict=True):
            out[i] = x

    for i, row in enumerate(rows):
        if None in row:
            continue
        waiting[row[1]].append(i)
        held[row[1]] += len(row[0])
        if held[row[1]] >= TOGETHER:
            flush(row[1])
    for key in list(waiting):
        flush(key)
    return out


def by_row(function: Callable[[bytes, list], list], *columns: Column) -> Column:
    @F.pandas_udf("binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series(by_key(function, list(zip(*series, strict=True))), dtype=object)

    return run(*columns)


def seal(content: Column, key: Column, nonce: Column, data: Column) -> Column:
    return by_row(seal_many, content, key, nonce, data)


def unseal(sealed: Column, key: Column, nonce: Column, data: Column) -> Column:
    return by_row(open_many, sealed, key, nonce, data)
