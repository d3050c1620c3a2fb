"""File trees: scans, and writers that run on the executors. Paths are on a file system that driver and executors share."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.functions import files
from coffer.shipping import ship


def exists(path: str) -> bool:
    return Path(path).exists()


def free_space(path: str) -> int:
    """Bytes free where a path is or would be; -1 if unknown."""
    p = Path(path).absolute()
    while not p.exists() and p != p.parent:
        p = p.parent
    try:
        return shutil.disk_usage(p).free
    except OSError:
        return -1


def scan(spark: SparkSession, root: str, with_content: bool = True) -> DataFrame:
    """relative_path, size, and content unless it isn't wanted, in which case no file is read.

    Spark's scan passes over empty files, so they're added from a listing."""
    top = Path(root).absolute()
    own = top if top.is_dir() else top.parent
    names = [p for d, _, found in os.walk(top) for f in found if (p := Path(d, f))] if top.is_dir() else [top]
    schema = "relative_path string, size long" + ", content binary" * with_content
    empty = [(str(p.relative_to(own)), 0, *([bytearray()] if with_content else [])) for p in names if not p.stat().st_size]
    missed = spark.createDataFrame(empty, schema)
    if len(empty) == len(names):
        return missed
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{top}")
    columns = [files.relative_path(F.col("path"), str(own)).alias("relative_path"), F.col("length").alias("size")]
    found = df.select(*columns, *([F.col("content")] if with_content else []))
    return found.unionByName(missed) if empty else found


def write(rows: DataFrame, root: str) -> DataFrame:
    """Writes (destination, output) under a root: each file under another name first, then renamed, so a retried or repeated task
    leaves whole files only. Gives destination and error (null where it went well)."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = Path(root, name)
                temporary = target.with_name(f".{uuid.uuid4().hex}.part")
                try:
                    target.parent.mkdir(parents=True, exist_ok=True)
                    temporary.write_bytes(raw)
                    temporary.replace(target)
                    errors.append(None)
                except OSError as e:
                    temporary.unlink(missing_ok=True)
                    errors.append(f"{name}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string())], names=["destination", "error"])

    return rows.select("destination", "output").mapInArrow(run, "destination string, error string")


def delete(names: DataFrame, root: str) -> None:
    """Deletes files by relative path, from the executors; one that's gone already doesn't matter."""

    def run(rows) -> None:
        for r in rows:
            Path(root, r[0]).unlink(missing_ok=True)

    names.select(names.columns[0]).foreachPartition(run)


def replace_folder(path: str) -> None:
    """An empty folder in place of whatever was there."""
    shutil.rmtree(path, ignore_errors=True)
    Path(path).mkdir(parents=True)
