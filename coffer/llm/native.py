"""Column helpers of the operators that run on DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The word separators, as a character class's content and as a string.
SPACE, SPACES = r"\x20\x09-\x0D", " \t\n\x0b\f\r"
_SPANS = "array<struct<start:int,end:int,value:string>>"
#: Matches of a text that are added up in one go.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever and how often the body uses it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(pairs: Column, at: Column) -> Column:
    """Spans of (piece, value) pairs that follow each other from ``at`` on."""
    start = F.struct(at.alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(state: Column, x: Column) -> Column:
        return let(
            state["at"] + F.length(x["piece"]),
            lambda s: let(
                s + F.length(x["value"]),
                lambda e: F.struct(e.alias("at"), F.concat(state["out"], F.array(F.struct(s.alias("start"), e.alias("end"), x["value"].alias("value")))).alias("out")),
            ),
        )

    return F.aggregate(pairs, start, step, lambda s: s["out"])


def _blocks(pairs: Column) -> Column:
    """The same from 0 on, for many pairs: an array that grows is copied at each step, so blocks of ``BLOCK`` pairs get their starts first."""
    size = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + F.length(x["piece"]) + F.length(x["value"]))
    blocks = F.transform(F.sequence(F.lit(1), F.size(pairs), F.lit(BLOCK)), lambda i: F.slice(pairs, i, F.lit(BLOCK)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = lambda all_blocks: F.aggregate(all_blocks, start, lambda s, b: F.struct((s["at"] + size(b)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    return let(blocks, lambda all_blocks: F.flatten(F.zip_with(all_blocks, starts(all_blocks), _running)))


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of a pattern's leftmost non-overlapping matches; code points, end exclusive.

    The pieces between matches and the matches alternate, so their lengths add up to the offsets. The pattern must not match
    the empty string."""
    pairs = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), m, lambda piece, value: F.struct(piece.alias("piece"), value.alias("value"))),
    )
    return F.when(text.rlike(pattern), let(pairs, lambda p: F.when(F.size(p) > BLOCK, _blocks(p)).otherwise(_running(p, F.lit(0))))).otherwise(F.array().cast(_SPANS))


def words(text: Column) -> Column:
    """Words of a text."""
    return F.filter(F.split(text, f"[{SPACE}]+", -1), lambda w: w != "")
