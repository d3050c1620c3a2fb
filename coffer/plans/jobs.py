"""Backup jobs: create, restore, update. The one entry is ``run``.

A job is a plan over the table of files: scan, name, transform, write, gather the manifest. Salts and nonces are drawn once and
checkpointed before anything uses them, so a task that runs again writes the same bytes. Contents never pass the driver."""

from __future__ import annotations

import dataclasses
import os
import time
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.functions import chacha, codec, files, gcm, keys, password
from coffer.model import MANIFEST_NAME, NONCE_SIZE, SALT_SIZE, Cipher, CompressionMode, NameMode, Operation, Request, Result
from coffer.operators import catalog as ops
from coffer.operators import validation
from coffer.shipping import ship
from coffer.sources import manifest, trees


#: So many failures are shown in a result's errors; its table of failures has all.
SHOWN = 100


def normalised(path: str) -> str:
    """Absolute, with variables expanded; blank stays blank."""
    return os.path.abspath(os.path.expandvars(path.strip())) if path and path.strip() else ""


def errors_of(spark: SparkSession, request: Request) -> list[str]:
    """What keeps a request from being run. Nothing is created."""
    out = []
    source, target = normalised(request.source), normalised(request.destination)
    if not source:
        out.append("source path is required")
    elif not Path(source).exists():
        out.append("source doesn't exist")
    elif Path(source).is_file() and not Path(source).stat().st_size:
        out.append("source file is empty")
    elif Path(source).is_dir() and not any(names for _, _, names in os.walk(source)):
        out.append("source folder is empty")
    if not target:
        out.append("destination path is required")
    if source and target:
        a, b = source.lower(), target.lower()
        if a == b:
            out.append("source and destination are the same")
        elif b.startswith(a + os.sep):
            out.append("destination is inside the source")
        elif a.startswith(b + os.sep):
            out.append("source is inside the destination")
    if request.use_encryption:
        confirm = request.confirm_password if request.operation == Operation.ENCRYPT else request.password
        df = spark.createDataFrame([(request.password, confirm)], "p string, c string")
        out += df.select(validation.password_problems(F.col("p"), F.col("c")).alias("x")).first()["x"]
    return out


def warnings_of(spark: SparkSession, request: Request) -> list[str]:
    """What a caller may want to confirm first."""
    out = []
    free = trees.free_space(request.destination)
    w = validation.job_warnings(trees.scan(spark, request.source, False), "size", F.lit(free)).first()
    if w["low_space"]:
        out.append("low disk space")
    if w["file_count"] != "none":
        out.append(f"{w['file_count']} number of files")
    if request.operation == Operation.DECRYPT and Path(request.destination).is_dir() and any(Path(request.destination).iterdir()):
        out.append("destination has files")
    if request.operation == Operation.ENCRYPT and request.use_encryption:
        df = spark.createDataFrame([(request.password,)], "p string")
        if password.analysed(F.col("p"), df).first()["score"] < validation.WEAK_SCORE:
            out.append("weak password")
    return out


def _secrets(paths: DataFrame) -> DataFrame:
    """relative_path, salt, nonce: drawn by a CSPRNG, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([os.urandom(SALT_SIZE) for _ in range(n)], pa.binary()), pa.array([os.urandom(NONCE_SIZE) for _ in range(n)], pa.binary())], names=["relative_path", "salt", "nonce"])

    return paths.select("relative_path").mapInArrow(run, "relative_path string, salt binary, nonce binary").checkpoint()


def _key(request: Request, salt: Column) -> Column:
    """The file's key. The password is in the function, not in the plan."""
    kind, word = manifest.derivation(request.key_derivation), request.password

    @F.pandas_udf("binary")
    def run(salts: pd.Series) -> pd.Series:
        return salts.map(lambda s: keys.derive_key(kind, word, s))

    return run(salt)


def _ciphers(cipher: Cipher):
    """Column functions that seal and open."""
    known = {Cipher.AES: (keys.aes_seal, keys.aes_open), Cipher.CHACHA20: (chacha.seal, chacha.unseal)}
    return known[cipher] if cipher in known else gcm.column_functions(cipher.name.lower())


def _sealed(tree: DataFrame, request: Request) -> DataFrame:
    """``tree`` with output, salt and nonce."""
    content, mode = F.col("content"), request.compression
    if not request.use_encryption:
        empty = F.lit(bytearray()).cast("binary")
        return tree.withColumns({"output": codec.file_payload(content, mode), "salt": empty, "nonce": empty})
    with_key = tree.join(_secrets(tree), "relative_path").withColumn("key", _key(request, F.col("salt"))).withColumn("packed", codec.compress(mode)(content))
    data = files.associated_data(F.col("salt"), F.col("nonce"), F.lit(int(mode)))
    return with_key.withColumn("output", _ciphers(request.cipher)[0](F.col("packed"), F.col("key"), F.col("nonce"), data)).drop("key", "packed")


def _named(tree: DataFrame, request: Request, old: DataFrame | None = None) -> DataFrame:
    """``tree`` with destination. ``old``: entries of the backup that stay; their folders' names are used again, and none of their files' names.

    Two files of a folder with one content have the same hash for a name; all but one of them get a name of their own, from their path."""
    if request.use_encryption and request.name_mode != NameMode.NONE:
        named = ops.obfuscate(tree, request.source, request.name_mode).withColumnRenamed("stored_path", "destination")
        if old is not None:
            folders = ops.prefix_map(old, "original_path", "relative_path", "position").checkpoint()
            named = ops.with_known_folders(named, folders, "destination")
        return ops.with_own_names(named, None if old is None else old.select(F.col("original_path").alias("owner"), F.col("relative_path").alias("destination")))
    return tree.withColumn("destination", files.destination(F.col("relative_path"), request.use_encryption, int(request.compression)))


def _header(request: Request) -> dict:
    return {"cipher": request.cipher, "key_derivation": request.key_derivation, "name_mode": request.name_mode, "compression": request.compression}


def _not_written(done: DataFrame) -> DataFrame:
    """path and error of what a writer couldn't write."""
    return done.where("error is not null").select(F.col("destination").alias("path"), "error")


def _shown(failures: DataFrame) -> tuple[str, ...]:
    """The first failures, and how many there are if that isn't all."""
    n = failures.count()
    first = tuple(r["error"] for r in failures.orderBy("path", "error").limit(SHOWN).collect())
    return first if n == len(first) else (*first, f"{n} errors in all, of which {SHOWN} are shown")


def _store(spark: SparkSession, named: DataFrame, request: Request, root: str) -> tuple[DataFrame, int, int, DataFrame]:
    """Writes named files. Gives entries of what was written, their number and bytes, and a table of all failures: path, error."""
    clash = ops.collisions(named, "destination", "relative_path")
    losers = named.select("relative_path", F.lower("destination").alias("destination_key")).join(clash, "destination_key").where("relative_path <> winner")
    taken = F.format_string("%s: %s files have the name %s, which %s takes", "relative_path", "files", "destination_key", "winner")
    lost = losers.select(F.col("relative_path").alias("path"), taken.alias("error"))
    fits = validation.file_fits(F.col("size"), F.lit(trees.free_space(root)))
    lost = lost.unionByName(named.where(~fits).select(F.col("relative_path").alias("path"), F.format_string("%s: too little space for it", "relative_path").alias("error")))
    named = named.where(fits)
    winners = ops.first_wins(named.select("relative_path", "destination"), "destination", "relative_path").select("relative_path")
    sealed = _sealed(named.join(winners, "relative_path", "left_semi"), request)
    hashed = sealed.withColumn("source_hash", files.content_hash(F.col("content")))
    facts = hashed.select("relative_path", "destination", "salt", "nonce", "source_hash", "size").checkpoint()
    done = trees.write(hashed, root).checkpoint()
    failures = lost.unionByName(_not_written(done)).checkpoint()
    written = facts.join(done.where("error is null").select("destination"), "destination", "left_semi")
    entries = written.select(F.col("destination").alias("relative_path"), F.col("relative_path").alias("original_path"), "salt", "nonce", "source_hash")
    n = written.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    return entries, n["n"], n["b"], failures


def _create(spark: SparkSession, request: Request) -> Result:
    began = time.time()
    if Path(request.source).is_dir():
        trees.replace_folder(request.destination)
    tree = trees.scan(spark, request.source)
    total = trees.scan(spark, request.source, False).count()
    if not total:
        return Result(True, errors=("no files in the source folder",))
    entries, n, size, failures = _store(spark, _named(tree, request), request, request.destination)
    errors = _shown(failures)
    manifest.write(spark, request.destination, _header(request), entries, request.password if request.use_encryption else None)
    return Result(n == total and not errors, time.time() - began, size, n, total, errors, failures=failures)


def _opened(backup: DataFrame, entries: DataFrame, header: dict, request: Request, sealed: bool) -> DataFrame:
    """destination and output of each file of a backup; output is null where a tag or frame doesn't fit."""
    known = ops.last_wins(entries, "relative_path", "position").select(F.lower("relative_path").alias("k"), "original_path", "salt", "nonce")
    rows = backup.where(F.lower("relative_path") != MANIFEST_NAME).join(known, F.lower("relative_path") == F.col("k"), "inner" if sealed else "left")
    rows = rows.withColumn("destination", F.coalesce("original_path", "relative_path"))
    mode = header["compression"]
    if sealed:
        data = files.associated_data(F.col("salt"), F.col("nonce"), F.lit(int(mode)))
        rows = rows.withColumn("key", _key(request, F.col("salt"))).withColumn("plain", _ciphers(request.cipher)[1](F.col("content"), F.col("key"), F.col("nonce"), data))
        return rows.select("destination", "size", (codec.decompress(F.col("plain")) if mode else F.col("plain")).alias("output"))
    marked = files.magic(F.col("content")).isNotNull() & (F.col("relative_path") != F.col("destination"))
    frame = F.when(marked, F.substring(F.col("content"), F.lit(5), F.length("content")))
    return rows.select("destination", "size", F.coalesce(codec.decompress(frame), F.col("content")).alias("output"))


def _restore(spark: SparkSession, request: Request) -> Result:
    began = time.time()
    source = request.source if Path(request.source).is_dir() else str(Path(request.source).parent)
    if Path(request.source).name.lower() == MANIFEST_NAME:
        return Result(True, errors=("manifest file ignored",))
    found = manifest.read(spark, source, request.password)
    if found is None:
        return Result(False, errors=("a manifest is required",))
    header, entries = found
    sealed = manifest.kind_of(source) == "sealed"
    request = dataclasses.replace(request, **header)
    backup = trees.scan(spark, request.source)
    total = trees.scan(spark, request.source, False).where(F.lower("relative_path") != MANIFEST_NAME).count()
    rows = _opened(backup, entries, header, request, sealed).checkpoint()
    bad = rows.where("output is null").select(F.col("destination").alias("path"), F.concat("destination", F.lit(": wrong password, or the data was changed")).alias("error"))
    done = trees.write(rows.where("output is not null"), request.destination).checkpoint()
    failures = bad.unionByName(_not_written(done)).checkpoint()
    errors = _shown(failures)
    n = done.where("error is null").count()
    tried = rows.count()
    size = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    return Result(n == total and not errors, time.time() - began, size, n, total, errors, skipped=total - tried, failures=failures)


def _update(spark: SparkSession, request: Request) -> Result:
    began = time.time()
    if not Path(request.source).is_dir() or not Path(request.destination).is_dir():
        return Result(False, errors=("an update needs a source folder and a backup",))
    found = manifest.read(spark, request.destination, request.password)
    if found is None:
        return Result(False, errors=("a manifest is required",))
    header, entries = found
    request = dataclasses.replace(request, **header, use_encryption=manifest.kind_of(request.destination) == "sealed")
    old = ops.last_wins(entries, "original_path", "position").checkpoint()
    tree = trees.scan(spark, request.source)
    hashed = tree.select("relative_path", files.content_hash(F.col("content")).alias("source_hash"), "size").checkpoint()
    changes = ops.diff(hashed, old.select(F.col("original_path").alias("relative_path"), "source_hash", F.lit(0).cast("long").alias("size"))).checkpoint()
    work = changes.where(F.col("status").isin("added", "modified")).select("relative_path")
    total = work.count()
    gone = changes.where("status = 'deleted'").select(F.lower("relative_path").alias("k"))
    lost = old.join(gone, F.lower("original_path") == F.col("k"), "left_semi").select("relative_path").checkpoint()
    trees.delete(lost, request.destination)
    entries_new, n, size, errors, failures = None, 0, 0, (), None
    if total:
        # A changed file keeps its stored name.
        stored = old.select(F.lower("original_path").alias("k"), F.col("relative_path").alias("kept"))
        stays = old.join(gone, F.lower("original_path") == F.col("k"), "left_anti")
        named = _named(tree.join(work, "relative_path", "left_semi"), request, stays).join(stored, F.lower("relative_path") == F.col("k"), "left")
        named = named.withColumn("destination", F.coalesce("kept", "destination")).drop("k", "kept")
        entries_new, n, size, failures = _store(spark, named, request, request.destination)
        errors = _shown(failures)
    carried = old.join(gone, F.lower("original_path") == F.col("k"), "left_anti").drop("position")
    if entries_new is not None:  # what failed keeps its old entry
        carried = carried.join(entries_new.select(F.lower("original_path").alias("k")), F.lower("original_path") == F.col("k"), "left_anti").unionByName(entries_new)
    manifest.write(spark, request.destination, header, carried, request.password if request.use_encryption else None)
    return Result(n == total and not errors, time.time() - began, size, n, total, errors, failures=failures)


def run(spark: SparkSession, request: Request) -> Result:
    """Validates a request and runs it."""
    ship(spark)
    keys.shared_folder(spark)
    request = dataclasses.replace(request, source=normalised(request.source), destination=normalised(request.destination))
    if errors := errors_of(spark, request):
        return Result(False, errors=tuple(errors))
    found = warnings_of(spark, request)
    if found and not request.proceed_on_warnings:
        return Result(False, warnings=tuple(found))
    job = {Operation.ENCRYPT: _create, Operation.DECRYPT: _restore, Operation.UPDATE: _update}[request.operation]
    try:
        return dataclasses.replace(job(spark, request), warnings=tuple(found))
    except manifest.WrongPassword as e:
        return Result(False, errors=(str(e),), warnings=tuple(found))


def copy_tree(spark: SparkSession, source: str, destination: str) -> Result:
    """Plain copies and a plain manifest without hashes, so a first update takes every file anew."""
    began = time.time()
    ship(spark)
    keys.shared_folder(spark)
    tree = trees.scan(spark, source).select("relative_path", "size", F.col("relative_path").alias("destination"), F.col("content").alias("output"))
    done = trees.write(tree, destination).checkpoint()
    failures = _not_written(done).checkpoint()
    errors = _shown(failures)
    empty = F.lit(bytearray()).cast("binary")
    entries = done.where("error is null").select(F.col("destination").alias("relative_path"), F.col("destination").alias("original_path"), empty.alias("salt"), empty.alias("nonce"), F.lit("").alias("source_hash"))
    header = {"cipher": Cipher.AES, "key_derivation": 1, "name_mode": NameMode.NONE, "compression": CompressionMode.NONE}
    manifest.write(spark, destination, header, entries)
    counts = done.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("n")).first()
    size = tree.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    return Result(not errors, time.time() - began, size, counts["n"], counts["total"], errors, failures=failures)


__all__ = ["copy_tree", "errors_of", "normalised", "run", "warnings_of"]
