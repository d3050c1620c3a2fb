"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document is the set of hashes (64 bits) of its word shingles. Documents with equal sets (128 bits of key) form a class, which is
compared once, whether its rows have ids or not. A global order puts rare shingles first: by level, then by how often they occur.
A level is a range of hash values, and holds some ``SLACK`` times the shingles that a prefix takes; a class sends the levels that
hold its prefix, for most the first one alone. Counts are exact, over all that is sent, from a partial aggregation; what was
counted once meets no list and drops out before anything is joined, but keeps its places in the order. So a class whose prefix
is of such shingles is done. Two classes above the threshold share a shingle of their prefixes. Candidates that share one must pass

- the length filter: sizes within the threshold of each other, by bands of sizes in the join's key, then exactly;
- the positional filter: what can follow the shared places suffices for the overlap that the threshold asks for;
- the suffix filter: a bound on the sets' difference from parities of their elements, of ``SKETCH`` words beside each prefix
  element and then of ``WIDE`` words for each class;

and are verified once, on the whole sets. To find the components of a large group of near copies without all its pairs, ``ROUNDS``
first rounds take from each posting list a class of its least component, then of its greatest, and compare every other class
with the one of them that it shares most lists with. The last round joins classes of different components only; every pair
that passes the filters is verified, so no link between components is lost. Classes of a large group that are nearly similar share
dozens of lists and pass short sketches: in lists of over ``CROWD`` classes the last round compares sketches of ``CROWDED`` words
too, and a list leaves out pairs that meet in one of the ``BEFORE`` lists before it of each (all lists of two similar classes
pass, so the first one makes the pair). All rounds are plain equi-joins; posting lists are never gathered, Spark splits their hot
keys at run time, and a class with many pairs has them dealt in slices of ``SLICE``.

Null, empty or blank text has an empty set and links with nothing. Rows with one id but several texts count each as their own
set under that id; rows whose id is null link as others do and take the component of their set, which their id never names.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coffer.llm.common import arrow, cut, discard, fold, lookup, mix, store, texts
from coffer.llm.components import components

#: Shingles that a level holds, as a multiple of those in a prefix.
SLACK = 1.5
SKETCH, WIDE = 4, 64
ROUNDS = 2
#: In the last round: lists before each that a class knows, and the words of a sketch in lists of more than so many classes.
BEFORE, CROWDED, CROWD = 3, 16, 32
#: Pairs of a class that share one copy of its set.
SLICE = 64

_SEEN_CLASSES = 200_000
_PARTS = [f"f{i}" for i in range(SKETCH)]


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of so many words; with fewer words, of them all."""
    words = text.encode().lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    return np.unique(fold(hashes, min(width, len(words))))


def class_key(items: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    raw = xxhash.xxh3_128_digest(items.tobytes())
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


class Threshold:
    """inter / union >= num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        #: Of 2^20 hash values, those of a level.
        self.level = math.ceil(min(1.0, SLACK * (1 - num / den) + 1e-3) * (1 << 20))

    def prefix(self, n: int) -> int:
        """Elements of a set of n, of which one at least is in each other set's prefix, if the two are similar."""
        return n - -(-self.num * n // self.den) + 1

    def bound(self, overlap: Column, total: Column) -> Column:
        """Whether sets of so many elements together can be similar with an overlap of at most so much."""
        return (self.num + self.den) * overlap >= self.num * total

    def near(self, differ: Column, total: Column) -> Column:
        """Whether sets of so many elements together can be similar if at least so many are in one of them only."""
        return (self.num + self.den) * (total - differ) >= 2 * self.num * total

    def band(self, n: Column) -> Column:
        """Sizes within the threshold are in one band or in two that follow each other."""
        return F.floor(F.log(n) / (math.log(self.den / self.num) * (1 + 1e-9))).cast("int") if self.num < self.den else n.cast("int")


def parities(items: np.ndarray, words: int = SKETCH) -> list[int]:
    """A set's sketch: of ``64 * words`` bits, each the parity of the number of elements that fall there."""
    place = (mix(items + np.uint64(77)) >> np.uint64(64 - 6 - (words - 1).bit_length())).astype(np.int64)
    bits = (np.bincount(place, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(bits).view(">i8").tolist()


_HELD = pa.schema([
    *((c, pa.int64()) for c in ("doc_id", "r1", "r2", "place", "n", "k1", "k2")), ("first", pa.bool_()), ("prefix", pa.int64()), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.int64())),
    *((f, pa.int64()) for f in _PARTS), ("wide", pa.list_(pa.int64())),
])
_HELD_SQL = "doc_id long, r1 long, r2 long, place long, n long, k1 long, k2 long, first boolean, prefix long, ends array<long>, items array<long>, " + ", ".join(f"{f} long" for f in _PARTS) + ", wide array<long>"


def _hold(width: int, threshold: Threshold):
    """A row for each document: its number among all rows, size and key of its set; with the first of a class that a task meets,
    the elements of the levels that hold its prefix, where the levels end, and sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, r1, r2 = (batch.column(i).to_pylist() for i in range(3))
            rows = []
            for i, a, b, t in zip(ids, r1, r2, texts(batch.column(3)), strict=True):
                place += 1
                items = shingles(t, width)
                if not (n := len(items)):
                    rows.append((i, a, b, place, 0, None, None, False, *[None] * (4 + SKETCH)))
                    continue
                key = class_key(items)
                if key in seen:
                    rows.append((i, a, b, place, n, *key, False, *[None] * (4 + SKETCH)))
                    continue
                if len(seen) >= _SEEN_CLASSES:
                    seen.clear()
                seen.add(key)
                level = (items >> np.uint64(44)).astype(np.int64) // threshold.level
                ends = np.cumsum(np.bincount(level))
                p = threshold.prefix(n)
                last = int(np.searchsorted(ends, p))
                sent = items[level <= last].view(np.int64)
                rows.append((i, a, b, place, n, *key, True, p, ends[: last + 1], sent, *parities(items), parities(items, WIDE)))
            columns = zip(*rows, strict=True) if rows else [()] * len(_HELD)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _HELD, strict=True)], schema=_HELD)

    return run


def _sets(width: int):
    """(cls, items) from (cls, k1, k2, text): the whole set of each class that a task is asked for, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            names, k1, k2 = (batch.column(i).to_pylist() for i in range(3))
            keys, sets = [], []
            for cls, a, b, t in zip(names, k1, k2, texts(batch.column(3)), strict=True):
                if cls in seen:
                    continue
                items = shingles(t, width)
                if len(items) and class_key(items) == (a, b):
                    if len(seen) >= _SEEN_CLASSES:
                        seen.clear()
                    seen.add(cls)
                    keys.append(cls)
                    sets.append(items.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "items"])

    return run


def _dealt(df: DataFrame) -> DataFrame:
    """A side of a join that is dealt by key whatever its size, so plans and their disk use are the same for small and large tables."""
    return df.hint("merge")


def _sliced(pairs: DataFrame, end: str, sets: DataFrame, value: str) -> DataFrame:
    """``pairs`` with the set of one end as ``value``. A class with many pairs has a copy of its set for each slice of them."""
    other = "b" if end == "a" else "a"
    many = cut(pairs.groupBy(end).count().where(F.col("count") > SLICE).select(F.col(end).alias("cls"), F.ceil(F.col("count") / SLICE).cast("int").alias("slices")))
    dealt = lookup(pairs, many.withColumnRenamed("cls", end), end).withColumn("slice", F.coalesce(F.pmod(F.xxhash64(other), F.col("slices")).cast("int"), F.lit(0))).drop("slices")
    copies = lookup(sets, many, "cls").select(F.col("cls").alias(end), F.col("items").alias(value), F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)).alias("slice"))
    return dealt.join(_dealt(copies), [end, "slice"]).drop("slice")


class Join:
    """One join over ``docs``; the parts keep what they share."""

    def __init__(self, docs: DataFrame, width: int, num: int, den: int, id_column: str = "doc_id", text_column: str = "text"):
        self.width, self.threshold = width, Threshold(num, den)
        docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
        self.docs = docs.select("doc_id", *row_keys(F.col("doc_id"), F.col("text")), "text")
        self.spark = docs.sparkSession

    def passed(self) -> Column:
        """The filters of a posting and another's, whose columns end with _r."""
        n, m, t = F.col("n"), F.col("n_r"), self.threshold
        overlap = F.least("pos", "pos_r") + F.least(n - F.col("pos"), m - F.col("pos_r"))
        differ = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"{f}_r"))) for f in _PARTS[1:]), F.bit_count(F.col("f0").bitwiseXOR(F.col("f0_r"))))
        length = t.num * F.greatest(n, m) <= t.den * F.least(n, m)
        return (F.col("component") != F.col("component_r")) & length & t.bound(overlap, n + m) & t.near(differ, n + m)

    def postings(self, held: DataFrame) -> DataFrame:
        """Prefix elements that two classes sent: token, cls, n, pos (in the set's order), sketch. ``held``: one row of each class."""
        held = held.withColumnRenamed("place", "cls")
        each = held.select("cls", F.explode("items").alias("token"))
        often = each.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
        whose = held.select("cls", "n", "prefix", "ends", *_PARTS)
        level = F.expr(f"cast(shiftrightunsigned(token, 44) div {self.threshold.level} as int)")
        found = each.join(_dealt(often), "token").join(_dealt(whose), "cls").withColumn("level", level)
        last_first = Window.partitionBy("cls", "level").orderBy(F.desc("times"), F.desc("token"))
        # What is sent once stands before all others of its level, so places are counted from the level's end.
        found = found.withColumn("pos", F.element_at("ends", F.col("level") + 1) - F.row_number().over(last_first))
        return found.where(F.col("pos") < F.col("prefix")).select("token", "cls", "n", "pos", *_PARTS)

    def told(self, posted: DataFrame, sketches: DataFrame) -> DataFrame:
        """``posted`` with the lists before each of its class, and in crowded lists (``many`` classes) a longer sketch."""
        in_order = Window.partitionBy("cls").orderBy("pos")
        before = {f"before{i}": F.lag("token", i + 1).over(in_order) for i in range(BEFORE)}
        fold = [functools.reduce(Column.bitwiseXOR, (F.col("wide")[j] for j in range(i, WIDE, CROWDED))) for i in range(CROWDED)]  # parities of joined places
        folded = sketches.select("cls", *[x.alias(f"g{i}") for i, x in enumerate(fold)])
        own = {f"g{i}": F.when(F.col("many") > CROWD, F.coalesce(f"g{i}", F.lit(0))).otherwise(0).cast("long") for i in range(CROWDED)}
        return posted.withColumns(before).join(_dealt(folded), "cls").withColumns(own).drop("many")

    def met(self, posted: DataFrame) -> DataFrame:
        """The last round's join of ``posted`` (with what is ``told``): a row for each pair and list, but for lists that others stand for."""
        band = self.threshold.band
        left = posted.withColumn("band", band(F.col("n")))
        right = posted.select(*[F.col(c).alias(c if c == "token" else f"{c}_r") for c in posted.columns])
        right = right.withColumn("up", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", band(F.col("n_r")) + F.col("up"))
        differ = functools.reduce(Column.__add__, (F.bit_count(F.col(f"g{i}").bitwiseXOR(F.col(f"g{i}_r"))) for i in range(CROWDED)))
        known = functools.reduce(Column.__or__, (F.coalesce(F.col(f"before{i}") == F.col(f"before{j}_r"), F.lit(False)) for i in range(BEFORE) for j in range(BEFORE)))
        once = (F.col("up") == 1) | (F.col("cls") < F.col("cls_r"))
        return left.join(_dealt(right), ["token", "band"]).where(self.passed() & once & ~known & self.threshold.near(differ, F.col("n") + F.col("n_r")))

    def narrowed(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Of distinct pairs (a < b), those whose wide sketches allow the threshold."""
        wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
        some = lookup(sketches, wanted, "cls", "left_semi")
        first = some.select(F.col("cls").alias("a"), F.col("n").alias("n"), F.col("wide").alias("x"))
        second = some.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("wide").alias("y"))
        differ = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        joined = _dealt(pairs).join(_dealt(first), "a").join(_dealt(second), "b")
        return joined.where(self.threshold.near(differ, F.col("n") + F.col("m"))).select("a", "b")

    def verified(self, pairs: DataFrame, found: DataFrame) -> DataFrame:
        """``pairs`` (kept) with ``linked``, by whole sets. ``found``: classes, with the key of a row of each."""
        if pairs.isEmpty():  # else adaptive execution ends early, while tasks still read what is discarded below
            return pairs.withColumn("linked", F.lit(False))
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        wanted = cut(lookup(found.select("cls", "r1", "k1", "k2"), cut(wanted), "cls", "left_semi"))
        some = lookup(self.docs.select("r1", "text"), wanted, "r1", "inner").select("cls", "k1", "k2", "text")
        sets = store(arrow(some, _sets(self.width), "cls long, items array<long>"))
        both = _sliced(_sliced(pairs, "a", sets, "x"), "b", sets, "y")
        common = F.size(F.array_intersect("x", "y"))
        union = F.size("x") + F.size("y") - common
        # Repeated rows may have repeated a class's set.
        checked = cut(both.select("a", "b", (self.threshold.den * common >= self.threshold.num * union).alias("linked")).distinct())
        discard(sets)
        return checked

    def pairs(self, labelled: DataFrame, sketches: DataFrame, turn: int) -> DataFrame:
        """Distinct pairs (a < b) that pass the filters: in the first rounds of each class with ends of lists, in the last of all classes."""
        few = labelled
        if turn < ROUNDS:  # of long documents' elements some, the same ones in near copies: the last round takes all
            step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.col("n") / 128, F.lit(1.0))))).cast("long")
            few = labelled.where(F.col("token").bitwiseAND(step - 1) == 0)
        # Of a list, the class with the fewest shingles of its own before is compared with the others: the least edited copy. Of lists
        # that unlike documents share, such a class for each part with like sketches.
        mask = F.when(F.col("n") < 64, 255).when(F.col("n") < 256, 15).otherwise(3)
        few = few.withColumn("part", F.col(_PARTS[turn % SKETCH]).bitwiseAND(mask.cast("long")) if 0 < turn < ROUNDS else F.lit(0).cast("long"))
        end = F.min_by("cls", F.struct("pos", (F.xxhash64("cls", F.lit(turn)))))
        ends = few.groupBy("token", "part").agg(F.min("component").alias("low"), F.max("component").alias("high"), end.alias("end"), F.count("*").alias("many")).where("low < high").select("token", "part", "end", "many")
        posted = few.join(_dealt(ends), ["token", "part"])
        pair = [F.least("cls", "cls_r").alias("a"), F.greatest("cls", "cls_r").alias("b")]
        if turn < ROUNDS:
            posted = store(posted.drop("many"))
            right = posted.select(*[F.col(c).alias(c if c in ("token", "part") else f"{c}_r") for c in posted.columns])
            met = posted.join(_dealt(right.where("cls_r = end_r")), ["token", "part"]).where(self.passed())
            counted = met.groupBy("cls", "cls_r").agg(F.count("*").alias("lists"))
            out = cut(counted.groupBy("cls").agg(F.max_by("cls_r", "lists").alias("cls_r")).select(*pair).distinct())
        else:
            posted = store(self.told(posted.drop("part", "end"), sketches))
            out = cut(self.met(posted).select(*pair).distinct())
        discard(posted)
        return out

    def run(self) -> DataFrame:
        """One row per row: doc_id, r1, r2, place, n, k1, k2, cls and component of its class, component_id."""
        held = store(arrow(self.docs, _hold(self.width, self.threshold), _HELD_SQL))
        rows = held.select("doc_id", "r1", "r2", "place", "n", "k1", "k2")
        own = F.struct(F.col("doc_id").isNull(), "place")
        found = store(held.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.min_by("r1", own).alias("r1"), F.min(F.when(F.col("first"), F.col("place"))).alias("cls"), F.count_if("first").alias("firsts")))
        # Other tasks' first rows of a class don't count.
        again = lookup(held.where("first").select("place", "k1", "k2"), cut(found.where("firsts > 1").select("k1", "k2", "cls")), ["k1", "k2"], "inner").where("place <> cls")
        once = lookup(held.where("first"), cut(again.select("place")), "place", "left_anti")
        listed = store(self.postings(once))
        sketches = once.select(F.col("place").alias("cls"), "n", "wide")
        checked: DataFrame | None = None
        joined = self.spark.createDataFrame([], "cls long, component long")
        for turn in range(ROUNDS + 1):
            labelled = lookup(listed, joined, "cls").withColumn("component", F.coalesce("component", "cls"))
            pairs = self.pairs(labelled, sketches, turn)
            if checked is not None:
                pairs = pairs.join(_dealt(checked.select("a", "b")), ["a", "b"], "left_anti")
            new = self.verified(cut(self.narrowed(pairs, sketches)), found)
            checked = new if checked is None else cut(checked.unionByName(new))
            joined = components(checked.where("linked").select("a", "b")).withColumnRenamed("node", "cls")
        discard(listed)
        classes = store(lookup(found.select("k1", "k2", "cls", "rep"), joined, "cls").withColumn("component", F.coalesce("component", "cls")))
        least = cut(classes.groupBy("component").agg(F.min("rep").alias("component_id")))
        named = cut(lookup(classes.select("k1", "k2", "cls", "component"), least, "component"))
        return lookup(rows, named, ["k1", "k2"])


def row_keys(doc_id: Column, text: Column) -> list[Column]:
    """r1, r2: 128 bits of a row's id and text."""
    return [F.xxhash64(doc_id, text).alias("r1"), F.xxhash64(F.lit(2), text, doc_id).alias("r2")]


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the least id reachable by links)."""
    out = Join(docs, width, num, den).run()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with one row of each component: that of the least id, rows without an id last. Rows without a word have no component and
    stay, repeated ones too."""
    judged = store(Join(docs, width, num, den).run().where("n > 0").select("doc_id", "r1", "r2", "place", "component"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "place")
    best = cut(judged.groupBy("component").agg(F.min(order).alias("best")).select("best.place"))
    # A row's key stands for repeated rows too: those of a kept row are told apart afterwards.
    kept = judged.join(best, "place", "left_semi").select("r1", "r2")
    lost = store(judged.join(_dealt(best), "place", "left_anti").groupBy("r1", "r2").agg(F.lit(1).alias("lost")))
    repeated = cut(lost.join(_dealt(kept), ["r1", "r2"], "left_semi"))
    gone = lookup(lost, repeated, ["r1", "r2"], "left_anti")
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("whole"), *row_keys(F.col("doc_id").cast("long"), F.col("text")))
    rows = lookup(rows, cut(gone), ["r1", "r2"], "left_anti")
    twice = lookup(rows, repeated, ["r1", "r2"], "left_semi").groupBy("r1", "r2").agg(F.first("whole").alias("whole"))  # of few rows
    return lookup(rows, repeated, ["r1", "r2"], "left_anti").select("whole.*").unionByName(twice.select("whole.*"))
