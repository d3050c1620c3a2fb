"""What the training-data operators share: table reads, Arrow batches, checkpoints, size-checked joins, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.shipping import ship

#: Rows in an Arrow batch, and bytes, as documents may be long.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20
#: Rows in a batch of numbers and short strings.
SMALL_ROWS = 16_384
#: Spark's settings of a batch, and the one by which it drops an execution's shuffle files at its end.
_ROWS, _BYTES, _CLEAN = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A lookup side is broadcast only when it has at most this many rows of a few longs (some 20 MB).
BROADCAST_ROWS = 200_000


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches, for results that the caller runs too, and makes sure that checkpoints have a folder. Lower bounds of the
    session's own stay, and so does the cluster's folder."""
    ship(spark)
    for key, most in ((_ROWS, ARROW_ROWS), (_BYTES, ARROW_BYTES)):
        if not 0 < _number(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="coffer-checkpoint-"))


def _number(size: str) -> int:
    """Of a size as Spark writes it, such as 256MB."""
    digits = size.rstrip("bBkKmMgG")
    unit = size[len(digits) :].lower().rstrip("b")
    return int(digits) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Holds settings (dots written as __) for the statements within."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    usual = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in usual.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _once(spark: SparkSession, **values: str):
    """For an execution that nothing but its result outlives: its shuffle files go at its end."""
    return settings(spark, **{_CLEAN.replace(".", "__"): "true"}, **{k.replace(".", "__"): v for k, v in values.items()})


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder; later stages don't depend on executors' shuffle files."""
    spark = session(df)
    prepare(spark)
    with _once(spark):
        return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``function`` over the batches of each partition; at its end a worker gives the memory back that its allocators hold."""
    prepare(session(df))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of glibc only
        ctypes.CDLL(None).malloc_trim(0)


def lookup(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Joins a lookup table by key. It's broadcast behind a count; beyond it, both sides are shuffled, where AQE splits hot keys."""
    return left.join(F.broadcast(right) if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else right, on, how)


def texts(column: pa.Array) -> list[str]:
    """Values of a string column; null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, applied to each element."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def fold(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of so many consecutive elements, order included."""
    n = len(hashes) - width + 1
    out = np.full(max(n, 0), np.uint64(width * int(_M2) % (1 << 64)), dtype=np.uint64)
    for i in range(width if n > 0 else 0):
        out = mix(out * np.uint64(3) + hashes[i : i + n])
    return out


def store(df: DataFrame, rows: int = ARROW_ROWS) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder: smaller than a checkpoint where rows are wide. ``rows``: of an Arrow batch."""
    spark = session(df)
    prepare(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    with _once(spark, **{_ROWS: str(rows)}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._coffer_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``store`` that nothing reads any more."""
    for df in tables:
        context = session(df).sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._coffer_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
