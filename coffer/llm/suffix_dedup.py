"""Removal of passages that repeat across documents, by merging shards' Burrows-Wheeler transforms.

A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller id. Equal texts form a class, of
which the least id alone is searched. Each window of 50 bytes has a minimizer, the run of 20 bytes with the least hash in it;
equal windows have equal minimizers. So only minimizers that occur in two documents matter, and the text around one (the
windows that have it as their minimizer, its context) is compared with contexts of the same minimizer only:

- one context with all copies equal needs no comparison: the least document has its windows first;
- different contexts of a minimizer are a collection of strings. A task's collections are split into shards, whose transforms
  are merged by interleave refinement; the intervals of 50 common bytes give each window's least document (module ``bwt``);
- a collection of more than ``GATHER`` contexts (the edges of a passage that very many documents share) is never gathered. Its
  contexts are cut again in the same way, by minimizers of longer runs (``RUNS``), which part it into smaller collections, and
  so on. A run of 50 bytes is the window itself, so the last collections are of one context each and need no comparison.

Documents are known by 128 bits of their id and text, contexts by 128 bits. Strings are judged on the input, whatever is removed
elsewhere. Null text counts as empty. Rows without an id lose nothing and
take nothing from others. Repeated rows and rows of one id lose nothing to each other, as no id is smaller. Extra columns
stay in ``remove_repeats``; an empty table gives an empty result. Where cuts part a character of UTF-8, ``remove_repeats``
drops its remaining bytes; the digests of ``report`` are of the exact bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.llm import bwt, minimizers
from coffer.llm.common import SMALL_ROWS, arrow, discard, lookup, store
from coffer.llm.minimizers import WINDOW

#: Contexts that are compared together at most (of 80 bytes at most, so under 1 MB), and the lengths of minimizers by which more of them are parted.
GATHER, RUNS = 10_000, (minimizers.K, 35, 45, WINDOW)
#: Minimizers that a task holds before it packs them.
ENTRIES = 800_000
#: Bytes of contexts whose shards are merged together: as much as a CPU's cache holds.
UNIT = 250_000
#: Bytes of text for each bucket of minimizers, which a task holds at a time, and for each task.
BUCKET, DEALT = 4 << 20, 16 << 20


def _raw(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _groups(mh: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by mh, where its groups start, and for each whether it has two documents."""
    order = np.argsort(mh, kind="stable")
    starts = np.flatnonzero(np.r_[True, mh[order][1:] != mh[order][:-1]]) if len(mh) else np.zeros(0, dtype=np.int64)
    d = doc[order]
    return order, starts, np.minimum.reduceat(d, starts) < np.maximum.reduceat(d, starts) if len(starts) else np.zeros(0, dtype=bool)


def _pack(owners: np.ndarray, heads: np.ndarray, mh: np.ndarray, s: np.ndarray) -> bytes:
    """Entries in few bytes: the documents (id and key) once, then for each entry its document's number, minimizer and first window."""
    # Owners come sorted.
    new = np.r_[True, owners[1:] != owners[:-1]]
    used, number = owners[new], np.cumsum(new) - 1
    head = np.array([len(used), len(mh)], dtype="<i8")
    return b"".join(x.tobytes() for x in (head, heads[used], mh, number.astype("<u4"), s.astype("<u4")))


def _unpack(raw: bytes) -> tuple[np.ndarray, ...]:
    """Document's id and key, minimizer and first window of each entry."""
    n, m = np.frombuffer(raw, "<i8", 2)
    heads = np.frombuffer(raw, "<i8", 3 * n, 16).reshape(-1, 3)
    at = 16 + 24 * n
    mh, number, s = np.frombuffer(raw, "<i8", m, at), np.frombuffer(raw, "<u4", m, at + 8 * m), np.frombuffer(raw, "<u4", m, at + 12 * m)
    return heads[number, 0], heads[number, 1:], mh, s.astype(np.int64)


def _minimizers(buckets: int):
    """Rows (bucket, kind, packed entries). Kind 0: entries to compare with those of other tasks. Kind 1: one entry of each minimizer
    that this task has found in two documents. Kind 2: all entries of those, which need no comparison and may go anywhere.
    So a minimizer of very many documents sends one entry from each task to its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            heads = np.concatenate([x[0] for x in held])
            bases = np.cumsum([0, *(len(x[0]) for x in held)])
            owner = np.concatenate([x[1] + b for x, b in zip(held, bases, strict=False)])
            s, mh = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
            order, starts, shared = _groups(mh, heads[owner, 0])
            known = np.repeat(shared, np.diff(np.r_[starts, len(mh)]))
            named = np.zeros(len(mh), dtype=bool)
            named[starts[shared]] = True
            # Of high bits, as the minimum of many hashes has few of them set.
            bucket = ((mh[order].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            spread = owner[order] % buckets
            out: list[tuple] = []
            for kind, use, by in ((0, ~known, bucket), (1, named, bucket), (2, known, spread)):
                at = np.flatnonzero(use)
                at = at[np.argsort(by[at] << 32 | owner[order][at], kind="stable")]
                cuts = np.flatnonzero(by[at][1:] != by[at][:-1]) + 1
                for part in np.split(at, cuts) if len(at) else []:
                    e = order[part]
                    out.append((int(by[part[0]]), kind, _pack(owner[e], heads, mh[e], s[e])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "kind", "packed"])

        for batch in batches:
            heads = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            doc, s, _, _, h = minimizers.of_texts(_raw(batch.column(3)))
            held.append((heads, doc, s, h.view(np.int64)))
            size += len(doc)
            if size >= ENTRIES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (r1, r2, first window) of minimizers in two documents, from packed entries sorted by bucket, one bucket at a time."""
    parts: list[tuple[np.ndarray, ...]] = []

    def out(keys: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(s), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 200_000]) for x in (keys[:, 0].copy(), keys[:, 1].copy(), s)], names=["r1", "r2", "s"])

    def ended() -> Iterator[pa.RecordBatch]:
        doc, keys, mh, s, named = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order, starts, shared = _groups(mh, doc)
        shared |= np.logical_or.reduceat(named[order], starts)
        hit = order[np.repeat(shared, np.diff(np.r_[starts, len(mh)])) & ~named[order]]
        yield from out(keys[hit], s[hit])

    at = None
    for batch in batches:
        for bucket, kind, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if bucket != at and parts:
                yield from ended()
            at = bucket
            doc, keys, mh, s = _unpack(raw)
            if kind == 2:
                yield from out(keys, s)
            else:
                parts.append((doc, keys, mh, s, np.full(len(mh), kind == 1)))
    if parts:
        yield from ended()


def _keys_of(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found)).view(np.int64)


def _contexts(whole: bool):
    """Of a document's contexts at listed places, from (id, r1, r2, text, places): rows (minimizer, key of the context, id, number of the row,
    first window, windows, and with a document's first context its key), or if ``whole`` rows (minimizer, key, context)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            raw = _raw(batch.column(3))
            doc, s, e, _, h = minimizers.of_texts(raw)
            lists = batch.column(4)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            hits = owner << 40 | lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            use = np.flatnonzero(np.isin(doc << 40 | s, hits))
            before = np.r_[-1, doc[use][:-1]] if len(use) else doc[:0]
            named = doc[use] != before
            for a in range(0, len(use), 50_000):
                u, new = use[a : a + 50_000], named[a : a + 50_000]
                found = [raw[d][i : j + WINDOW] for d, i, j in zip(doc[u].tolist(), s[u].tolist(), e[u].tolist(), strict=True)]
                head = [pa.array(h[u].view(np.int64)), pa.array(_keys_of(found))]
                if whole:
                    yield pa.RecordBatch.from_arrays([*head, pa.array(found, pa.binary())], names=["mh", "ck", "context"])
                else:
                    ids, r1, r2 = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)[doc[u]] for i in range(3))
                    numbers = [pa.array(x) for x in (ids, base + doc[u], s[u], e[u] - s[u] + 1)]
                    yield pa.RecordBatch.from_arrays([*head, *numbers, *(pa.array(x, mask=~new) for x in (r1, r2))], names=["mh", "ck", "doc", "row", "first", "windows", "r1", "r2"])
            base += batch.num_rows

    return run


def _cut_again(k: int):
    """Contexts (mh, ck, low, context) cut by minimizers of longer runs: rows (of, of_key, first window, windows, mh, ck, low, context)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(3).to_pylist()
            owner, s, e, _, h = minimizers.of_texts(raw, k)
            found = [raw[d][i : j + WINDOW] for d, i, j in zip(owner.tolist(), s.tolist(), e.tolist(), strict=True)]
            old = [pa.array(batch.column(i).to_numpy(zero_copy_only=False)[owner]) for i in range(3)]
            new = [pa.array(x) for x in (s, e - s + 1, h.view(np.int64), _keys_of(found))]
            yield pa.RecordBatch.from_arrays([*old[:2], *new, old[2], pa.array(found, pa.binary())], names=["of", "of_key", "first", "windows", "mh", "ck", "low", "context"])

    return run


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mh, ck, least): the least document of each window of each context; one number where it's the same for all.

    Rows (mh, ck, low, context) come sorted by mh; a unit of work ends between minimizers."""
    held: pa.Table | None = None

    def solve(rows: pa.Table) -> pa.RecordBatch:
        mh, ck, low = (rows.column(i).to_numpy() for i in range(3))
        found = rows.column(3).combine_chunks()
        found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
        bounds = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1]
        data = np.frombuffer(found.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        flat, n = bwt.least_owners(data, np.diff(bounds).astype(np.int64), low)
        starts = np.cumsum(n) - n
        same = np.minimum.reduceat(flat, starts) == np.maximum.reduceat(flat, starts)
        keep = np.ones(len(flat), dtype=bool)
        keep[np.repeat(same, n)] = False
        keep[starts] = True
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(same, 1, n))].astype(np.int32)), pa.array(flat[keep]))
        return pa.RecordBatch.from_arrays([pa.array(mh), pa.array(ck), lists], names=["mh", "ck", "least"])

    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        if held.column(3).nbytes >= UNIT:
            mh = held.column(0).to_numpy()
            cut = int(np.flatnonzero(np.r_[True, mh[1:] != mh[:-1]])[-1])  # the last minimizer may go on
            if cut:
                yield solve(held.slice(0, cut))
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield solve(held)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, begin, end) of removed bytes, from (document, row, first window, number of windows, least documents)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, row, first, windows = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        n = batch.column(4).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = batch.column(4).flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(n) - n
        less = flat < np.repeat(doc, n)
        # Runs of removed windows within a list: where they begin, and one past their end.
        before, after = np.r_[False, less[:-1]], np.r_[less[1:], False]
        before[starts] = False
        after[starts[1:] - 1] = False
        begin, last = np.flatnonzero(less & ~before), np.flatnonzero(less & ~after)
        owner = np.searchsorted(starts, begin, side="right") - 1
        a, b = begin - starts[owner], last - starts[owner]
        b = np.where(n[owner] == 1, windows[owner] - 1, b)  # one number stands for all windows
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row[owner], first[owner] + a, first[owner] + b + WINDOW)], names=["row", "begin", "end"])


def united(intervals: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[list[int]] = []
    for b, e in sorted((x["begin"], x["end"]) for x in intervals or ()):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def kept_bytes(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for b, e in runs:
        parts.append(raw[at:b])
        at = e
    return b"".join([*parts, raw[at:]])


def removals(docs: DataFrame) -> DataFrame:
    """(r1, r2, runs): intervals of removed bytes, not yet united, by row key (see ``row_keys``); rows that lose nothing are absent."""
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("doc", *row_keys("doc", "text"), "text")
    keyed = store(rows.select("doc", "r1", "r2", F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), F.col("text")).alias("b"), F.octet_length("text").alias("size")).alias("k")))
    total = keyed.agg(F.sum(F.col("k.size").cast("long"))).first()[0] or 0
    copied = keyed.groupBy("k").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("k", "low")
    copies = store(lookup(keyed, store(copied), "k", "inner").where("doc > low").groupBy("r1", "r2").agg(F.first("k.size").alias("size")))
    searched = lookup(rows, copies.select("r1", "r2"), ["r1", "r2"], "left_anti").select("doc", "r1", "r2", "text")
    # Minimizers of two documents at least, and where they are.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // DEALT))
    packed = arrow(searched, _minimizers(max(1, -(-total // BUCKET))), "bucket int, kind int, packed binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    hits = store(arrow(packed, _shared, "r1 long, r2 long, s long").groupBy("r1", "r2").agg(F.collect_list("s").alias("hits")))
    found = store(arrow(_with_places(searched, hits), _contexts(False), "mh long, ck long, doc long, row long, first long, windows long, r1 long, r2 long"))
    discard(hits)
    numbered = found.where("r1 is not null").select("row", "r1", "r2")
    # Distinct contexts by key, a place where each is, and how many each minimizer has.
    some = F.xxhash64("row", "first")
    one = [F.min_by(c, some).alias(c) for c in ("row", "first")]
    distinct = store(found.groupBy("mh", "ck").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), *one))
    counted = distinct.groupBy("mh").agg(F.count("*").alias("n"), F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select("mh", "n")
    parted = store(distinct.join(_keyed(counted), "mh").select("mh", "ck", "low", "n", "row", "first"))
    discard(distinct)
    # Texts of contexts that must be compared.
    wanted = parted.where("n > 1").groupBy("row").agg(F.collect_list("first").alias("hits"))
    wanted = store(numbered.join(_keyed(wanted), "row").select("r1", "r2", "hits"))
    texts = store(arrow(_with_places(searched, wanted), _contexts(True), "mh long, ck long, context binary"))
    compared = parted.where("n > 1").select("mh", "ck", "low", "n").join(_keyed(texts), ["mh", "ck"])
    alone = parted.where("n = 1").select("mh", "ck", F.array("low").alias("least"))
    used = [parted, wanted, texts]
    least = store(alone.unionByName(_compared(compared, 1, used)), SMALL_ROWS)
    discard(*used)
    answered = found.select("mh", "ck", "doc", "row", "first", "windows").join(_keyed(least), ["mh", "ck"])
    runs = arrow(answered.select("doc", "row", "first", "windows", "least"), _runs, "row long, begin long, end long")
    runs = runs.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("runs"))
    whole = copies.where(F.col("size") >= WINDOW).select("r1", "r2", F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("size").cast("long").alias("end"))).alias("runs"))
    runs = runs.join(_keyed(numbered), "row").select("r1", "r2", "runs").unionByName(whole)
    runs = store(runs.groupBy("r1", "r2").agg(F.flatten(F.collect_list("runs")).alias("runs")), SMALL_ROWS)  # of repeated rows
    discard(keyed, copies, found, least)
    return runs


def _compared(contexts: DataFrame, level: int, used: list[DataFrame]) -> DataFrame:
    """(mh, ck, least) of contexts (mh, ck, low, n, context), whose minimizers are of ``RUNS[level - 1]`` bytes. n: contexts of the minimizer.

    ``used`` gets the tables that the result is read from."""
    contexts = store(contexts)
    used.append(contexts)
    few = contexts.where((F.col("n") > 1) & (F.col("n") <= GATHER)).select("mh", "ck", "low", "context")
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = contexts.where("n = 1").select("mh", "ck", F.array("low").alias("least"))
    out = out.unionByName(arrow(few.repartition(parts, "mh").sortWithinPartitions("mh"), _least, "mh long, ck long, least array<long>"))
    many = contexts.where(F.col("n") > GATHER).select("mh", "ck", "low", "context")
    if level == len(RUNS) or many.isEmpty():  # of windows themselves, only contexts whose keys clash come in numbers
        return out.unionByName(arrow(many.repartition(parts, "mh").sortWithinPartitions("mh"), _least, "mh long, ck long, least array<long>"))
    again = store(arrow(many, _cut_again(RUNS[level]), "of long, of_key long, first long, windows long, mh long, ck long, low long, context binary"))
    distinct = store(again.groupBy("mh", "ck").agg(F.min("low").alias("low"), F.first("context").alias("context")))
    counted = distinct.groupBy("mh").agg(F.count("*").alias("n"))
    deeper = [distinct]
    solved = store(_compared(distinct.join(_keyed(counted), "mh").select("mh", "ck", "low", "n", "context"), level + 1, deeper), SMALL_ROWS)
    discard(*deeper)
    used += [again, solved]
    joined = again.select("of", "of_key", "first", "windows", "mh", "ck").join(_keyed(solved), ["mh", "ck"])
    each = F.when(F.size("least") == F.col("windows"), F.col("least")).otherwise(F.array_repeat(F.col("least")[0], F.col("windows").cast("int")))
    whole = F.flatten(F.transform(F.sort_array(F.collect_set(F.struct("first", each.alias("each")))), lambda x: x["each"]))  # once, of repeated rows
    whole = joined.groupBy(F.col("of").alias("mh"), F.col("of_key").alias("ck")).agg(whole.alias("least"))
    same = F.array_min("least") == F.array_max("least")
    return out.unionByName(whole.select("mh", "ck", F.when(same, F.slice("least", 1, 1)).otherwise(F.col("least")).alias("least")))


def _keyed(df: DataFrame) -> DataFrame:
    """A side of a join with one row per key: it's hashed, so the other side, with its texts or many rows, needn't be sorted."""
    return df.hint("shuffle_hash")


def _with_places(searched: DataFrame, places: DataFrame) -> DataFrame:
    return searched.join(_keyed(places), ["r1", "r2"]).select("doc", "r1", "r2", "text", "hits")


def row_keys(doc: str, text: str) -> list[Column]:
    """r1, r2: 128 bits that rows with the same id and text share."""
    doc_id, words = F.col(doc).cast("long"), F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(doc_id, words).alias("r1"), F.xxhash64(F.lit(2), words, doc_id).alias("r2")]


def _joined(docs: DataFrame) -> DataFrame:
    """A struct of ``docs``' columns, whatever their names, and the intervals that it loses."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    keys = [F.when(F.col("doc_id").isNotNull(), k).alias(f"r{i}") for i, k in enumerate(row_keys("doc_id", "text"), 1)]
    return docs.select(row, *keys).join(_keyed(removals(docs)), ["r1", "r2"], "left").select("whole", "runs")


def report(docs: DataFrame) -> DataFrame:
    """The query's rows: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _raw(batch.column(1))
            runs = [united(x) for x in batch.column(2).to_pylist()]
            sizes, gone = [len(x) for x in raw], [sum(e - b for b, e in r) for r in runs]
            digests = [hashlib.sha256(kept_bytes(x, r)).hexdigest() for x, r in zip(raw, runs, strict=True)]
            numbers = [pa.array(x, pa.int64()) for x in (sizes, gone, [len(r) for r in runs])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return arrow(rows.select("whole.doc_id", "whole.text", "runs"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated passages of ``text``; ``n_chars``, if there, is counted again. Other columns stay."""
    names = docs.columns
    at = names.index("text")
    rows = _joined(docs).select("whole.*", F.col("runs").alias(max(names, key=len) + "_runs"))  # no column of theirs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            left = []
            for text, intervals in zip(columns[at].to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                left.append(text if not intervals else kept_bytes((text or "").encode(), united(intervals)).decode("utf-8", errors="ignore"))
            columns[at] = pa.array(left, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = arrow(rows, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
