"""Near duplicates among embeddings: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors of a label form a class, which is compared once. The signs of a vector's products with random hyperplanes are its
signature; in each table other bits of it make the vector's bucket. Bits follow the number of classes, so that buckets hold some
``PER_BUCKET`` classes, and tables the bits, so that a pair at the threshold is missed with a probability of at most ``MISS``;
nearer pairs are missed far less often. First signatures alone are sent to buckets: a class stays in those where it has a partner
that it meets in no earlier table and whose signature differs in no more bits than ``SIGMAS`` deviations above what is expected
at the threshold. Only then vectors are sent, and compared exactly, in double precision; a pair counts in its first table only.
A bucket of over ``BLOCK`` classes is split into blocks, and each pair of blocks compared in a task of its own; from a
comparison go only sums of links by class and a spanning forest, so what leaves a group grows with its vectors, not pairs.

Vectors that are null, empty, zero or hold null or non-finite numbers, and vectors without a label, link with nothing; so do
vectors of different lengths. Vectors whose id is null link as others do; a null id never names a component. Repeated rows are
vectors of their own and link with each other. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import SMALL_ROWS, arrow, cut, discard, lookup, store
from coffer.llm.components import components, forest

COSINE, MISS, BLOCK = 0.98, 1e-4, 256
#: Classes that a bucket holds on average, if they spread evenly; bits of a signature at least; see above.
PER_BUCKET, SIGNATURE, SIGMAS = 256, 256, 6
#: What makes a bucket, and with the numbers of two blocks a comparison.
_BUCKET, _GROUP = ("t", "label", "dim", "key"), ("t", "label", "dim", "key", "low", "high")


def parameters(classes: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits of a bucket's key, and number of tables."""
    bits = min(62, max(6, math.ceil(math.log2(max(classes, 1) / PER_BUCKET + 1))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def signatures(x: np.ndarray, bits: int, tables: int, seed: int = 11) -> np.ndarray:
    """[row, bit] signs, table by table, then those of no table."""
    planes = np.random.default_rng(seed + x.shape[1]).standard_normal((x.shape[1], max(SIGNATURE, bits * tables)))
    return x @ planes > 0


def keys_of(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """[row, table] keys of buckets."""
    return signs[:, : bits * tables].reshape(len(signs), tables, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def _vectors(column: pa.Array) -> np.ndarray:
    x = np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(rows: DataFrame) -> DataFrame:
    """Distinct valid vectors: k1, k2, rep (least id), n, label, dim, v, cls (a number of the class)."""
    found = rows.where("valid").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    return found.withColumns({"dim": F.size("v"), "cls": F.monotonically_increasing_id()})


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v, valid and the class key (k1, k2) of every row. Of invalid rows the key is null."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    v = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    rows = rows.withColumn("valid", F.col("label").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    key = lambda seed: F.when(F.col("valid"), F.xxhash64(F.lit(seed), "label", "v"))
    return rows.withColumns({"k1": key(1), "k2": key(2)})


def _signed(bits: int, tables: int):
    """(cls, label, dim, sig, keys) of (cls, label, dim, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):  # vectors of one length at a time
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                signs = signatures(_vectors(part.column(3)), bits, tables)
                sigs = pa.array([x.tobytes() for x in np.packbits(signs, axis=1)], pa.binary())
                keys = pa.array(list(keys_of(signs, bits, tables)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], sigs, keys], names=["cls", "label", "dim", "sig", "keys"])

    return run


def _met_before(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, t: int) -> np.ndarray:
    """Whether rows i and j share a key of a table before t."""
    out = np.zeros(len(i), dtype=bool)
    for table in range(t):
        out |= left[i, table] == right[j, table]
    return out


def _likely(bits: int, tables: int, cosine: float):
    """Of a group of (cls, sig): the classes with a likely partner that they meet first in this table."""
    width = max(SIGNATURE, bits * tables)
    p = math.acos(cosine) / math.pi
    most = p * width + SIGMAS * math.sqrt(p * (1 - p) * width)

    def group(rows: pa.Table, key: tuple, sides: list[np.ndarray]) -> pa.RecordBatch:
        raw = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        signs = np.unpackbits(raw, axis=1)[:, :width]
        keys, spin = keys_of(signs, bits, key[0]) if key[0] else np.zeros((len(signs), 0), np.int64), signs.astype(np.float32) * 2 - 1
        a, b = sides[0], sides[-1]
        near = spin[a] @ spin[b].T >= width - 2 * most
        if len(sides) == 1:
            np.fill_diagonal(near, False)
        i, j = np.nonzero(near)
        fresh = ~_met_before(keys[a], keys[b], i, j, key[0])
        use = np.unique(np.r_[a[i[fresh]], b[j[fresh]]])
        return rows.select(["cls", *_BUCKET]).take(pa.array(use)).combine_chunks().to_batches()[0] if len(use) else None

    return group


def compare(left: tuple, right: tuple | None, cosine: float, t: int) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Links of vectors within ``left``, or between it and ``right``; each (ids, sizes, unit vectors, keys of the tables before t).

    Gives ids, the sums of the sizes that they link to, and a spanning forest."""
    ids, sizes, x, keys = left
    other = right or left
    product = x @ other[2].T >= cosine
    if right is None:
        np.fill_diagonal(product, False)
    i, j = np.nonzero(product)
    fresh = ~_met_before(keys, other[3], i, j, t)
    i, j = i[fresh], j[fresh]
    sums = np.bincount(i, weights=other[1][j], minlength=len(ids)).astype(np.int64)
    edges = forest(zip(ids[i].tolist(), other[0][j].tolist(), strict=True))
    if right is None:
        return ids, sums, edges
    back = np.bincount(j, weights=sizes[i], minlength=len(other[0])).astype(np.int64)
    return np.r_[ids, other[0]], np.r_[sums, back], edges


def _exact(bits: int, tables: int, cosine: float):
    """Of a group of (cls, n, v): rows (a, null, links) and (a, b, 0)."""

    def group(rows: pa.Table, key: tuple, sides: list[np.ndarray]) -> pa.RecordBatch:
        ids, sizes, x = rows.column("cls").to_numpy(), rows.column("n").to_numpy(), _vectors(rows.column("v").combine_chunks())
        keys = keys_of(signatures(x, bits, tables), bits, tables)
        parts = [(ids[k], sizes[k], x[k], keys[k]) for k in sides]
        who, sums, edges = compare(parts[0], parts[1] if len(parts) == 2 else None, cosine, key[0])
        who, sums = who[sums > 0], sums[sums > 0]
        a = np.r_[who, np.array(list(edges), dtype=np.int64)]
        b = pa.array([*([None] * len(who)), *edges.values()], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.r_[sums, np.zeros(len(edges), dtype=np.int64)])], names=["a", "b", "links"])

    return group


def _groups(work: Callable[[pa.Table, tuple, list[np.ndarray]], pa.RecordBatch | None]):
    """``work`` for each comparison; its rows follow each other, and those of a batch's last may go on in the next batch."""

    def one(rows: pa.Table) -> pa.RecordBatch | None:
        key = tuple(rows.column(c)[0].as_py() for c in _GROUP)
        block = rows.column("block").to_numpy()
        sides = [np.flatnonzero(block == k) for k in sorted({*key[-2:]})]
        return work(rows, key, sides) if rows.num_rows > 1 and all(map(len, sides)) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([held, now]) if held is not None else now
            keys = [now.column(c).to_numpy() for c in _GROUP]
            ends = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            start = 0
            for end in ends.tolist():
                if (out := one(now.slice(start, end - start))) is not None:
                    yield out
                start = end
            held = now.slice(start)
        if held is not None and (out := one(held)) is not None:
            yield out

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (cls, t, label, dim, key and more), once for each comparison that they're part of, comparison by comparison."""
    sizes = cut(rows.groupBy(*_BUCKET).agg(F.count("*").alias("size")).where("size > 1"))
    blocks = lookup(rows, sizes, list(_BUCKET), "inner").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).drop("size")
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # A row of block i goes to every pair of blocks that i is part of; (i, i) is the block by itself.
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("low"), F.greatest("block", k).alias("high")))
    spread = blocks.withColumn("pair", F.explode(pairs)).select("*", "pair.low", "pair.high").drop("pair", "blocks")
    return spread.repartition(_parts(rows), *_GROUP).sortWithinPartitions(*_GROUP)


def links(found: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(a, b, links): sums of links by class (b is null), and edges between classes. ``found``: classes, kept."""
    bits, tables = parameters(found.count(), cosine)
    signed = store(arrow(found.select("cls", "label", "dim", "v"), _signed(bits, tables), "cls long, label long, dim int, sig binary, keys array<long>"), SMALL_ROWS)
    tabled = signed.select("cls", "label", "dim", "sig", F.posexplode("keys").alias("t", "key"))
    likely = arrow(_dealt(tabled), _groups(_likely(bits, tables, cosine)), "cls long, t int, label long, dim int, key long")
    wanted = store(likely.distinct(), SMALL_ROWS)
    discard(signed)
    rows = store(wanted.join(found.select("cls", "n", "v").hint("merge"), "cls"))
    out = cut(arrow(_dealt(rows), _groups(_exact(bits, tables, cosine)), "a long, b long, links long"))
    discard(wanted, rows)
    return out


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dedup(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    rows = keyed(vectors)
    found = store(classes(rows), SMALL_ROWS)
    compared = links(found, cosine)
    sums = compared.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    joined = components(compared.where("b is not null").select("a", "b")).withColumnRenamed("node", "cls")
    by_class = cut(lookup(lookup(found.select("k1", "k2", "cls", "rep", "n"), cut(sums), "cls"), joined, "cls").withColumn("component", F.coalesce("component", "cls")))
    least = cut(by_class.groupBy("component").agg(F.min("rep").alias("component_id")))
    named = cut(lookup(by_class, least, "component").select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component_id"))
    discard(found)
    out = lookup(rows.select("vec_id", "k1", "k2"), named, ["k1", "k2"])
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
