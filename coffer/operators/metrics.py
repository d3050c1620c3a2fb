"""Job results and progress from per-file outcomes: job, seq (order of completion), ok, bytes, at (timestamp), error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def guarded(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(otherwise)


def job_results(outcomes: DataFrame) -> DataFrame:
    """One row per job: counts, bytes, rates and flags. All aggregates are partial; the first error is the earliest."""
    ok = F.col("ok")
    seconds = (F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / 1e6
    out = outcomes.groupBy("job").agg(
        F.count("*").alias("total_files"),
        F.sum(ok.cast("long")).alias("processed_files"),
        F.sum(F.when(ok, F.col("bytes")).otherwise(0)).alias("processed_bytes"),
        F.sum("bytes").alias("total_bytes"),
        seconds.alias("elapsed"),
        F.min_by("error", F.when(~ok, F.col("seq"))).alias("first_error"),
    )
    done, total = F.col("processed_files"), F.col("total_files")
    return out.withColumns(
        {
            "failed_files": total - done,
            "success_rate": guarded(done.cast("double"), total),
            "is_partial": (done > 0) & (done < total),
            "is_success": done == total,
            "bytes_per_second": guarded(F.col("processed_bytes").cast("double"), F.col("elapsed")),
            "files_per_second": guarded(done.cast("double"), F.col("elapsed")),
        }
    )


#: Steps of the order of completion that are summed in one task.
STEPS = 1 << 16


def progress(outcomes: DataFrame) -> DataFrame:
    """Running files and bytes of each job in order of completion, and percent done (100 when there's nothing to do).

    A job is cut into blocks of the order, so a large one is many tasks' work; only sums of its blocks meet in one."""
    cut = outcomes.select("job", "seq", "bytes", F.floor(F.col("seq") / STEPS).alias("block"))
    sums = cut.groupBy("job", "block").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    before = Window.partitionBy("job").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("job", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b_before"), F.sum("b").over(Window.partitionBy("job")).alias("all_bytes"))
    own = Window.partitionBy("job", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cut.select("job", "block", "seq", F.count("*").over(own).alias("n"), F.sum("bytes").over(own).alias("b")).join(sums, ["job", "block"])
    run = run.select("job", "seq", (F.col("n_before") + F.col("n")).alias("files"), (F.col("b_before") + F.col("b")).alias("done_bytes"), "all_bytes")
    return run.withColumn("percent", F.when(F.col("all_bytes") > 0, F.col("done_bytes") * 100.0 / F.col("all_bytes")).otherwise(100.0))
