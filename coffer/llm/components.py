"""Distributed connected components by contraction.

Each partition first reduces its edges to a spanning forest (each node to the least of its tree). A round then hooks every node to
its least neighbour, follows these links to their ends by pointer jumping, and puts the ends in the edges' place; what has
equal ends goes. At least half of the nodes go with each round. Every round's tables are checkpointed. Aggregations are
partial before they shuffle, so a node with many edges makes no large group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import arrow, cut, lookup


def forest(edges: dict[int, int] | Iterator[tuple[int, int]]) -> dict[int, int]:
    """Each node that isn't the least of its tree, and that least node."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while up.get(x, x) != root and x != root:
            up[x], x = root, up[x]
        return root

    for a, b in edges:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, int] = {}
    for batch in batches:
        found = forest([*found.items(), *zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])
    items = list(found.items())
    for i in range(0, len(items), 50_000):
        part = items[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([x for _, x in part], pa.int64())], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (two columns of ids; null or equal ends are ignored). A component is its least node."""
    a, b = edges.columns
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    pairs = cut(arrow(pairs, _reduce, "u long, v long"))
    labels = None
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        links = cut(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("r")))
        while True:
            ends = links.select(F.col("u").alias("r"), F.col("r").alias("end"))
            jumped = cut(lookup(links, ends, "r").select("u", F.col("r").alias("was"), F.coalesce("end", "r").alias("r")))
            links = jumped.select("u", "r")
            if jumped.where("was <> r").isEmpty():
                break
        if labels is None:
            labels = links.select(F.col("u").alias("node"), F.col("r").alias("component"))
        else:
            moved = links.select(F.col("u").alias("component"), F.col("r").alias("to"))
            labels = cut(lookup(labels, moved, "component").select("node", F.coalesce("to", "component").alias("component")))
        first = links.select("u", F.col("r").alias("x"))
        second = links.select(F.col("u").alias("v"), F.col("r").alias("y"))
        pairs = lookup(lookup(pairs, first, "u"), second, "v").where("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v"))
        pairs = cut(arrow(pairs, _reduce, "u long, v long"))
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    return labels
