"""Rules of requests and of what they work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed limits of the rules.
LEAST_LENGTH, MOST_LENGTH, SPACE_FACTOR, MANY_FILES, SOME_FILES, WEAK_SCORE = 8, 1000, 1.2, 10_000, 1_000, 60
FILE_SLACK = 1024


def password_problems(password: Column, confirm: Column) -> Column:
    """array<string> of what is wrong with a password and its repetition; empty if nothing is."""
    given = F.coalesce(password, F.lit(""))
    again = F.coalesce(confirm, F.lit(""))
    edge = given.rlike(r"^\s|\s$")
    return F.array_compact(
        F.array(
            F.when(F.trim(given) == "", "required"),
            F.when((F.trim(given) != "") & (F.length(given) < LEAST_LENGTH), "too_short"),
            F.when(F.length(given) > MOST_LENGTH, "too_long"),
            F.when((F.trim(given) != "") & edge, "outer_space"),
            F.when(again == "", "confirm_required"),
            F.when((again != "") & (again != given), "confirm_differs"),
        )
    )


def job_warnings(tree: DataFrame, size: str, free: Column, group: str | None = None) -> DataFrame:
    """Space and file-count warnings of a job's files, for each group or for all: files, bytes, low_space, file_count."""
    keyed = tree.groupBy(group) if group else tree.groupBy()
    out = keyed.agg(F.count("*").alias("files"), F.sum(F.coalesce(F.col(size), F.lit(0)).cast("long")).alias("bytes"))
    out = out.withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    needed = F.col("bytes") * SPACE_FACTOR
    return out.withColumn("low_space", (free >= 0) & (free < needed)).withColumn("file_count", F.when(F.col("files") > MANY_FILES, "large").when(F.col("files") > SOME_FILES, "medium").otherwise("none"))


def file_fits(size: Column, free: Column) -> Column:
    """Whether one file's output fits; unknown free space (negative) passes."""
    return (free < 0) | (free >= size * SPACE_FACTOR + FILE_SLACK)
