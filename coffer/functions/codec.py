"""Zstandard compression of binary columns, which Spark lacks; whole Arrow batches go to Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from coffer.model import MAGIC, ZSTD_LEVELS, CompressionMode


def compress_bytes(raw: bytes, mode: CompressionMode) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=ZSTD_LEVELS[mode]).compress(raw)


def decompress_bytes(raw: bytes) -> bytes:
    """Frames need not say how long their content is."""
    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(raw) as reader:
        return reader.read()


def compress(mode: CompressionMode) -> Callable[[Column], Column]:
    if mode == CompressionMode.NONE:
        return lambda c: c

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda raw: None if raw is None else compress_bytes(raw, mode))

    return run


def decompress(packed: Column) -> Column:
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda raw: None if raw is None else decompress_bytes(raw))

    return run(packed)


def file_payload(content: Column, mode: CompressionMode) -> Column:
    """What a compressed, unencrypted file holds: mark, mode, frame. Without compression the content itself."""
    if mode == CompressionMode.NONE:
        return content
    return F.concat(F.lit(bytearray([*MAGIC, int(mode)])), compress(mode)(content))
