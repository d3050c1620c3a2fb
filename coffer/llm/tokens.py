"""Encoders over a public byte-level vocabulary file. The file's path is a parameter; it's read on each executor."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

import numpy as np

#: The split pattern of this vocabulary family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, others from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}


@functools.cache
def vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[int, int, int]], dict[str, int]]:
    """Ids by bytes, merges (left id, right id, merged id) in rank order, and special tokens' ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    raw = {k: bytes(letters[c] for c in k) for k in spec["model"]["vocab"] if all(c in letters for c in k)}
    special = {x["content"]: x["id"] for x in spec["added_tokens"] if x["special"]}
    ids = {raw[k]: v for k, v in spec["model"]["vocab"].items() if k in raw and k not in special}
    merges = []
    for m in spec["model"]["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        merges.append((spec["model"]["vocab"][a], spec["model"]["vocab"][b], spec["model"]["vocab"][a + b]))
    return ids, merges, special


@functools.cache
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids as uint32. tiktoken runs the vocabulary's merges several times as fast as tokenizers, with the same
    ids (a vocabulary's ids are its ranks; tests compare both on random texts); tokenizers is the way out if it can't."""
    import tiktoken
    from tokenizers import Tokenizer

    ids, _, special = vocabulary(path)
    fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ids, special_tokens=special)
    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    known = set(special)

    def encode(text: str) -> np.ndarray:
        try:
            return np.asarray(fast.encode_to_numpy(text, allowed_special=known, disallowed_special=()), dtype=np.uint32)
        except Exception:  # a run that its pattern engine can't hold
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode
