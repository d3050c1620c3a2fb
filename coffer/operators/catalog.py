"""Operators over catalogues of files. A catalogue has one row per file: path, hash, size; a manifest has entries of a backup.

Keys of joins are lower-cased paths. Joins are declared as equi-joins of pruned columns, so Catalyst picks the strategy and
splits hot keys; nothing is broadcast by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.functions import files
from coffer.model import MANIFEST_NAME, NameMode


def snapshot(tree: DataFrame, path: Column, content: Column) -> DataFrame:
    """relative_path, source_hash, size of each file."""
    return tree.select(path.alias("relative_path"), files.content_hash(content).alias("source_hash"), F.length(content).cast("long").alias("size"))


def last_wins(manifest: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, case-insensitively: that of the greatest order. Partial before the shuffle."""
    row = F.struct(*[F.col(c) for c in manifest.columns])
    return manifest.groupBy(F.lower(key).alias("_k")).agg(F.max_by(row, F.col(order)).alias("_r")).select("_r.*")


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, case-insensitively: that of the least order."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(F.lower(key).alias("_k")).agg(F.min_by(row, F.col(order)).alias("_r")).select("_r.*")


def diff(source: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status of every path: added, modified, unchanged or deleted. Both have relative_path, source_hash, size."""
    s, m = source.alias("s"), manifest.alias("m")
    both = s.join(m, F.lower("s.relative_path") == F.lower("m.relative_path"), "full")
    status = F.when(F.col("m.relative_path").isNull(), "added").when(F.col("s.relative_path").isNull(), "deleted").when(F.col("s.source_hash") != F.col("m.source_hash"), "modified").otherwise("unchanged")
    return both.select(F.coalesce("s.relative_path", "m.relative_path").alias("relative_path"), status.alias("status"), F.col("s.size").alias("size"), F.col("m.size").alias("old_size"), F.coalesce("s.source_hash", "m.source_hash").alias("source_hash"))


def summary(changes: DataFrame) -> DataFrame:
    """Files and bytes by status."""
    return changes.groupBy("status").agg(F.count("*").alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))


def deleted(source: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(source.select(F.lower("relative_path").alias("_k")), F.lower("relative_path") == F.col("_k"), "left_anti")


def unchanged(source: DataFrame, manifest: DataFrame) -> DataFrame:
    """Entries that an update carries forward."""
    keys = source.select(F.lower("relative_path").alias("_k"), F.col("source_hash").alias("_h"))
    return manifest.join(keys, (F.lower("relative_path") == F.col("_k")) & (F.col("source_hash") == F.col("_h")), "left_semi")


def after_update(source: DataFrame, manifest: DataFrame) -> DataFrame:
    """The manifest that an update writes: unchanged entries and new ones."""
    kept = unchanged(source, manifest).withColumn("origin", F.lit("carried"))
    keys = manifest.select(F.lower("relative_path").alias("_k"), F.col("source_hash").alias("_h"))
    fresh = source.join(keys, (F.lower("relative_path") == F.col("_k")) & (F.col("source_hash") == F.col("_h")), "left_anti").withColumn("origin", F.lit("processed"))
    return kept.unionByName(fresh)


def restore_destinations(backup: DataFrame, manifest: DataFrame) -> DataFrame:
    """Where files of a backup go: the original path by the manifest, else their own. ``backup``: relative_path; ``manifest``: relative_path, original_path."""
    m = manifest.select(F.lower("relative_path").alias("_k"), "original_path")
    found = backup.where(F.lower("relative_path") != MANIFEST_NAME).join(m, F.lower("relative_path") == F.col("_k"), "left").drop("_k")
    return found.withColumn("known", F.col("original_path").isNotNull()).withColumn("destination", F.coalesce("original_path", "relative_path")).drop("original_path")


def collisions(named: DataFrame, destination: str, order: str) -> DataFrame:
    """Files whose destination another one takes, case-insensitively: destination, files, and which wins."""
    return named.groupBy(F.lower(destination).alias("destination_key")).agg(F.count("*").alias("files"), F.min(order).alias("winner")).where("files > 1")


def prefix_map(pairs: DataFrame, original: str, stored: str, order: str | None = None) -> DataFrame:
    """Original folder prefix -> stored folder name, from pairs of paths; where they disagree, the first by ``order`` wins, or without one the least."""
    o, s = F.split(original, "/"), F.split(stored, "/")
    n = F.least(F.size(o), F.size(s)) - 1
    at = F.col(order) if order else F.lit(0)
    rows = pairs.select(o.alias("o"), s.alias("s"), n.alias("n"), at.alias("at")).where("n > 0")
    each = rows.select("o", "s", "at", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    named = each.select(F.array_join(F.slice("o", F.lit(1), F.col("i")), "/").alias("prefix"), F.get("s", F.col("i") - 1).alias("name"), "at")
    return named.groupBy("prefix").agg(F.min(F.struct("at", "name"))["name"].alias("name"))


def with_known_folders(named: DataFrame, folders: DataFrame, destination: str) -> DataFrame:
    """``named`` (relative_path, destination) with the names that ``folders`` (prefix, name) has for folders of the path, case-insensitively."""
    o, d = F.split("relative_path", "/"), F.split(destination, "/")
    each = named.select("relative_path", o.alias("o"), d.alias("d")).select("relative_path", "o", F.posexplode("d").alias("i", "own"))
    each = each.withColumn("key", F.when(F.col("i") < F.size("o") - 1, F.lower(F.array_join(F.slice("o", F.lit(1), F.col("i") + 1), "/"))))
    known = folders.groupBy(F.lower("prefix").alias("key")).agg(F.min("name").alias("name"))
    joined = each.join(known, "key", "left").select("relative_path", F.struct("i", F.coalesce("name", "own").alias("name")).alias("part"))
    paths = joined.groupBy("relative_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda x: x["name"]), "/").alias("_d"))
    return named.join(paths, "relative_path").withColumn(destination, F.col("_d")).drop("_d")


def with_own_names(named: DataFrame, taken: DataFrame | None, destination: str = "destination") -> DataFrame:
    """``named`` (relative_path, destination), where of files with one destination only the first keeps it, and none that another file has in
    ``taken`` (owner, destination). The others' names get a part from the hash of their path."""
    key = F.lower(destination)
    claims = named.select(key.alias("_k"), F.lit(1).alias("_rank"), F.lower("relative_path").alias("_o"))
    if taken is not None:
        claims = claims.unionByName(taken.select(key.alias("_k"), F.lit(0).alias("_rank"), F.lower("owner").alias("_o")))
    holder = claims.groupBy("_k").agg(F.min(F.struct("_rank", "_o"))["_o"].alias("_holder"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    own = F.regexp_replace(destination, r"(\.[^./]*)?$", "")
    other = F.concat(own, F.lit("-"), F.substring(F.sha2("relative_path", 256), 1, 32), F.regexp_extract(destination, r"(\.[^./]*)$", 1))
    joined = named.withColumn("_k", key).join(holder, "_k", "left")
    return joined.withColumn(destination, F.when(F.col("_holder").isNull() | (F.col("_holder") == F.lower("relative_path")), F.col(destination)).otherwise(other)).drop("_k", "_holder")


def obfuscate(tree: DataFrame, root: str, mode: NameMode, content: str = "content") -> DataFrame:
    """``tree`` (relative_path, content) with ``stored_path``."""
    if mode == NameMode.GUID:
        return random_names(tree)
    return tree.withColumn("stored_path", files.obfuscated(F.col("relative_path"), F.col(content), root, mode))


def random_names(tree: DataFrame) -> DataFrame:
    """``tree`` with ``stored_path`` of random names; a folder has one name wherever it's part of a path.

    Names are drawn once, into a table of folders; cut its lineage before the result is read twice."""
    segments = F.split("relative_path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.array_join(F.slice(segments, F.lit(1), i), "/"))
    each = tree.select("relative_path", F.posexplode(prefixes).alias("i", "prefix"))
    names = each.select("prefix").distinct().withColumn("name", F.uuid()).checkpoint()
    joined = each.join(names, "prefix").groupBy("relative_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]), "/").alias("stored_path"))
    return tree.join(joined.withColumn("stored_path", F.concat("stored_path", F.lit(".bzc"))), "relative_path")


def contained(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """How two paths lie: same, a_in_b, b_in_a or apart, case-insensitively."""
    x, y = F.lower(F.regexp_replace(a, "/+$", "")), F.lower(F.regexp_replace(b, "/+$", ""))
    return pairs.withColumn("relation", F.when(x == y, "same").when(x.startswith(F.concat(y, F.lit("/"))), "a_in_b").when(y.startswith(F.concat(x, F.lit("/"))), "b_in_a").otherwise("apart"))
