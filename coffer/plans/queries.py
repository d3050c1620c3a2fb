"""Queries of the catalogue engine over the test tables, each over whole tables.

``documents`` stands for a file tree (path: language, source and id; content: text). The second snapshot, which updates compare with
the first, lacks every tenth file, has every seventh changed and every eleventh copied under a new id. ``events`` are outcomes of files,
a user being a job. Names of parts and customers and texts of conversations are scored as passwords."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.functions import argon2, chacha, codec, files, gcm, keys
from coffer.functions import password as pw
from coffer.model import FAMILIES, CompressionMode, NameMode, catalog
from coffer.operators import catalog as ops
from coffer.operators import metrics, validation
from coffer.shipping import ship

ROOT, NEW_IDS, FREE_SPACE = "/backup", 1_000_000_000, 3_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(i):
    return F.concat_ws("/", "lang", "source", F.concat(i.cast("string"), F.lit(".txt")))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, relative_path, content."""
    return _table(spark, sf_dir, "documents").select("doc_id", _path(F.col("doc_id")).alias("relative_path"), F.col("text").alias("content"))


def changed_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    kept = docs.where(i % 10 != 0).select(i, _path(i).alias("relative_path"), F.when(i % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("content"))
    new = i + NEW_IDS
    return kept.unionByName(docs.where(i % 11 == 0).select(new.alias("doc_id"), _path(new).alias("relative_path"), F.col("text").alias("content")))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(ops.snapshot(t, F.col("relative_path"), F.encode("content", "UTF-8")) for t in (changed_tree(spark, sf_dir), tree(spark, sf_dir)))


_SQL_TREE = """tree AS (SELECT doc_id, lang || '/' || source || '/' || doc_id || '.txt' AS relative_path, text AS content FROM documents),
later AS (SELECT doc_id, lang || '/' || source || '/' || doc_id || '.txt' AS relative_path, CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END AS content FROM documents WHERE doc_id % 10 <> 0
 UNION ALL SELECT doc_id + 1000000000, lang || '/' || source || '/' || (doc_id + 1000000000) || '.txt', text FROM documents WHERE doc_id % 11 = 0),
m AS (SELECT relative_path, base64(unhex(sha256(content))) AS source_hash, CAST(strlen(content) AS BIGINT) AS size FROM tree),
s AS (SELECT relative_path, base64(unhex(sha256(content))) AS source_hash, CAST(strlen(content) AS BIGINT) AS size FROM later)"""
_SQL_DIFF = """d AS (SELECT coalesce(s.relative_path, m.relative_path) AS relative_path,
 CASE WHEN m.relative_path IS NULL THEN 'added' WHEN s.relative_path IS NULL THEN 'deleted' WHEN s.source_hash <> m.source_hash THEN 'modified' ELSE 'unchanged' END AS status,
 s.size AS size, m.size AS old_size, coalesce(s.source_hash, m.source_hash) AS source_hash FROM s FULL JOIN m ON lower(s.relative_path) = lower(m.relative_path))"""


def manifest_snapshot(spark, sf_dir):
    return _snapshots(spark, sf_dir)[1]


def manifest_diff(spark, sf_dir):
    return ops.diff(*_snapshots(spark, sf_dir))


def manifest_diff_summary(spark, sf_dir):
    return ops.summary(manifest_diff(spark, sf_dir))


def deleted_files(spark, sf_dir):
    return ops.deleted(*_snapshots(spark, sf_dir))


def unchanged_carry_forward(spark, sf_dir):
    return ops.unchanged(*_snapshots(spark, sf_dir))


def manifest_after_update(spark, sf_dir):
    return ops.after_update(*_snapshots(spark, sf_dir))


def manifest_last_wins(spark, sf_dir):
    """Manifest entries of both snapshots in one document, the later one last."""
    later, first = _snapshots(spark, sf_dir)
    return ops.last_wins(first.withColumn("position", F.lit(1)).unionByName(later.withColumn("position", F.lit(2))), "relative_path", "position")


def restore_destinations(spark, sf_dir):
    t = tree(spark, sf_dir)
    stored = F.concat("relative_path", F.lit(".bzc"))
    backup = t.select(stored.alias("relative_path")).unionByName(spark.createDataFrame([("MANIFEST.bzc",)], "relative_path string"))
    manifest = t.where(F.col("doc_id") % 13 != 0).select(F.upper(stored).alias("relative_path"), F.col("relative_path").alias("original_path"))
    return ops.restore_destinations(backup, manifest)


def destinations(spark, sf_dir):
    """Where each file goes by compression mode (of which the id is the remainder)."""
    mode = (F.col("doc_id") % 4).cast("int")
    return tree(spark, sf_dir).select("relative_path", mode.alias("compression"), files.destination(F.col("relative_path"), False, mode).alias("plain"), files.destination(F.col("relative_path"), True, mode).alias("encrypted"))


def _stored(spark, sf_dir, mode):
    t = tree(spark, sf_dir).withColumn("content", F.encode("content", "UTF-8"))
    return ops.obfuscate(t, ROOT, mode).select("relative_path", "stored_path")


def obfuscate_sha256(spark, sf_dir):
    return _stored(spark, sf_dir, NameMode.SHA256)


def obfuscate_sha512(spark, sf_dir):
    return _stored(spark, sf_dir, NameMode.SHA512)


def obfuscate_guid(spark, sf_dir):
    keys.shared_folder(spark)
    return _stored(spark, sf_dir, NameMode.GUID)


def obfuscation_collisions(spark, sf_dir):
    return ops.collisions(_stored(spark, sf_dir, NameMode.SHA256), "stored_path", "relative_path")


def _pages(spark, sf_dir):
    plain = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return _table(spark, sf_dir, "pages").select("page_id", plain.alias("path"))


def dir_prefix_map(spark, sf_dir):
    stored = F.array_join(F.transform(F.split("path", "/"), lambda s: F.substring(F.sha2(s, 256), 1, 12)), "/")
    return ops.prefix_map(_pages(spark, sf_dir).withColumn("stored", stored), "path", "stored")


def path_containment(spark, sf_dir):
    """Each page against the folder, and the host in capitals, of the page before."""
    p = _pages(spark, sf_dir)
    other = p.select((F.col("page_id") + 1).alias("page_id"), F.when(F.col("page_id") % 2 == 0, files.parent(F.col("path"))).otherwise(F.upper(F.split("path", "/")[0])).alias("other"))
    return ops.contained(p.join(other, "page_id"), "path", "other").select("page_id", "path", "other", "relation")


def _outcomes(spark, sf_dir):
    ok = F.col("event_type") != "error"
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), ok.alias("ok"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("bytes"), F.col("ts").cast("timestamp").alias("at"), F.when(~ok, F.concat(F.lit("file "), F.col("event_id").cast("string"))).alias("error"))


def result_metrics(spark, sf_dir):
    out = metrics.job_results(_outcomes(spark, sf_dir))
    return out.select("job", "total_files", "processed_files", "failed_files", "processed_bytes", "total_bytes", F.round("success_rate", 6).alias("success_rate"), "is_partial", "is_success", F.round("bytes_per_second", 6).alias("bytes_per_second"), F.round("files_per_second", 9).alias("files_per_second"), "first_error")


def progress_running(spark, sf_dir):
    return metrics.progress(_outcomes(spark, sf_dir)).select("job", "seq", "files", "done_bytes", F.round("percent", 6).alias("percent"))


def byte_size_format(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), F.floor(F.col("o_totalprice") * F.pow(F.lit(4.0), F.col("o_orderkey") % 12)).cast("long").alias("size"))
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("name"), F.octet_length("text").cast("long").alias("size"))
    return orders.unionByName(docs).withColumn("shown", files.size_text(F.col("size")))


def validation_warnings(spark, sf_dir):
    sized = _table(spark, sf_dir, "documents").select("source", F.octet_length("text").cast("long").alias("size"))
    return validation.job_warnings(sized, "size", F.lit(FREE_SPACE), "source").unionByName(validation.job_warnings(sized, "size", F.lit(FREE_SPACE)).withColumn("source", F.lit("(all)")))


def password_validity(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("owner"), F.col("p_name").alias("password"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).alias("confirm"))
    c = _table(spark, sf_dir, "conversations").select(F.concat_ws(" ", F.lit("turn"), "conv_id", "turn").alias("owner"), F.concat("text", F.lit(" ")).alias("password"), F.concat("text", F.lit(" ")).alias("confirm"))
    return p.unionByName(c).select("owner", F.array_join(validation.password_problems(F.col("password"), F.col("confirm")), ",").alias("problems"))


def _passwords(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("owner"), F.col("p_name").alias("password"))
    c = _table(spark, sf_dir, "customer").select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("owner"), F.concat("c_name", F.lit("!Abcd 1999"), F.col("c_mktsegment")).alias("password"))
    t = _table(spark, sf_dir, "conversations").select(F.concat_ws(" ", F.lit("turn"), "conv_id", "turn").alias("owner"), F.col("text").alias("password"))
    return p.unionByName(c).unionByName(t)


def _password_part(value) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf_dir):
        rows = _passwords(spark, sf_dir).withColumn("s", pw.trimmed(F.coalesce("password", F.lit(""))))
        return rows.select("owner", value(F.col("s")).alias("value"))

    return query


password_pool = _password_part(lambda s: pw.pool_size(s).cast("int"))
password_repetition = _password_part(pw.repetition_penalty)
password_sequence = _password_part(pw.sequence_penalty)
password_pattern = _password_part(pw.pattern_penalty)
password_year = _password_part(pw.year_penalty)
password_class = _password_part(pw.class_penalty)
password_leet = _password_part(pw.leet_normalised)


def password_strength(spark, sf_dir):
    return pw.analysed(F.col("password"), _passwords(spark, sf_dir)).select("owner", "strength", "score", F.round("entropy", 6).alias("entropy"))


def password_description(spark, sf_dir):
    return pw.analysed(F.col("password"), _passwords(spark, sf_dir)).select("owner", "description")


def algorithm_catalog(spark, sf_dir):
    return catalog(spark)


def _payloads(spark, sf_dir):
    """Payloads with a header for most documents; a compressed file's marks, or nothing, for the others."""
    i = F.col("doc_id")
    digest = lambda tag: F.unhex(F.sha2(F.concat(F.lit(tag), i.cast("string")), 256))
    mode = F.unhex(F.lpad(F.hex(i % 5), 2, "0"))
    text = F.encode("text", "UTF-8")
    whole = F.concat(digest("salt"), F.substring(digest("nonce"), 1, 12), mode, text)
    return _table(spark, sf_dir, "documents").select(i, F.when(i % 3 == 0, F.concat(F.lit(bytearray(b"BZC")), mode, text)).when(i % 3 == 1, F.substring(whole, 1, 44)).otherwise(whole).alias("content"))


def header_parse(spark, sf_dir):
    h = _payloads(spark, sf_dir).withColumn("h", files.header(F.col("content")))
    data = files.associated_data(F.col("h.salt"), F.col("h.nonce"), F.col("h.compression"))
    return h.select("doc_id", F.lower(F.hex("h.salt")).alias("salt"), F.lower(F.hex("h.nonce")).alias("nonce"), F.col("h.compression").alias("compression"), F.length(data).alias("data_length"))


def bzc_magic(spark, sf_dir):
    return _payloads(spark, sf_dir).select("doc_id", files.magic(F.col("content")).alias("mode"))


def zstd_roundtrip(spark, sf_dir):
    from coffer.shipping import ship

    ship(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    packed = docs.select("doc_id", codec.compress(CompressionMode.ZSTD)(F.col("content")).alias("packed"))
    return packed.select("doc_id", F.sha2(codec.decompress(F.col("packed")), 256).alias("digest"))


def _aes_gcm(docs: DataFrame) -> DataFrame:
    key = F.lit(bytearray(range(32)))  # a test key: never a real one
    nonce = F.substring(F.unhex(F.sha2(F.col("doc_id").cast("string"), 256)), 1, 12)
    data = F.unhex(F.sha2(F.lit("associated"), 256))
    sealed = docs.select("doc_id", keys.aes_seal(F.col("content"), key, nonce, data).alias("sealed"), nonce.alias("nonce"))
    opened = keys.aes_open(F.col("sealed"), key, F.col("nonce"), data)
    wrong = keys.aes_open(F.col("sealed"), key, F.col("nonce"), F.unhex(F.sha2(F.lit("other"), 256)))
    return sealed.select("doc_id", F.length("sealed").cast("long").alias("sealed_length"), F.sha2(opened, 256).alias("digest"), wrong.isNull().alias("wrong_fails"))


def aes_gcm_roundtrip(spark, sf_dir):
    return _aes_gcm(_payloads(spark, sf_dir))


def aes_gcm_documents(spark, sf_dir):
    """The whole text of every document, sealed and opened."""
    return _aes_gcm(_table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content")))


def cipher_documents(spark, sf_dir):
    """The whole text of every document, sealed and opened by each cipher that Spark lacks; opened with another nonce, it fails."""
    ship(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    key, data = F.lit(bytearray(range(32))), F.lit(bytearray(b"associated"))
    nonce, other = F.lit(bytearray(range(12))), F.lit(bytearray(12))
    out = None
    for kind, (seal, unseal) in {"chacha20": (chacha.seal, chacha.unseal), **{k: gcm.column_functions(k) for k in gcm.CIPHERS}}.items():
        sealed = docs.withColumn("sealed", seal(F.col("content"), key, nonce, data))
        both = sealed.withColumns({"opened": unseal(F.col("sealed"), key, nonce, data), "wrong": unseal(F.col("sealed"), key, other, data)})
        rows = both.select("doc_id", F.lit(kind).alias("cipher"), F.length("sealed").cast("long").alias("sealed_length"), F.sha2("opened", 256).alias("digest"), F.col("wrong").isNull().alias("wrong_fails"))
        out = rows if out is None else out.unionByName(rows)
    return out


#: Published test vectors of block ciphers with keys of 256 bits: key, block, enciphered block.
BLOCK_VECTORS = {
    "twofish": ("00" * 32, "00" * 16, "57ff739d4dc92c1bd7fc01700cc8216f"),
    "serpent": ("80" + "00" * 31, "00" * 16, "a223aa1288463c0e2be38ebd825616c0"),
    "camellia": ("0123456789abcdeffedcba987654321000112233445566778899aabbccddeeff", "0123456789abcdeffedcba9876543210", "9acc237dff16d76c20ef7c919e3a7509"),
}
#: RFC 9106, 5.3: the test vector of Argon2id; and by other libraries, 32 bytes from "password" and eight times "salt" at the fixed costs.
ARGON2_VECTOR = "0d640df58d78766c08c037a34a8b53c9d01ef0452d75b65eb52520e96b01e659"
KDF_VECTORS = {"pbkdf2": "910479a9c0445d668f94bf61ce8c67081a5e3cf7d3232a61871b103180bb24b8", "scrypt": "948b78fd3b8f0ef44895b9b43a5e2a3c5871f6428e154b4601ac2788a5b9b051"}


def cipher_vectors(spark, sf_dir):
    """One block by each cipher, and the key of the standard's Argon2id vector."""
    ship(spark)

    @F.pandas_udf("string")
    def run(names: pd.Series, ks: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for name, key, text in zip(names, ks, texts, strict=True):
            if name == "argon2id":
                found = argon2.in_numpy(b"\1" * 32, b"\2" * 16, 32, 32, 3, 4, b"\3" * 8, b"\4" * 12)
            else:
                found = gcm.CIPHERS[name](bytes.fromhex(key))(np.frombuffer(bytes.fromhex(text), np.uint8).reshape(1, 16)).tobytes()
            out.append(found.hex())
        return pd.Series(out, dtype=object)

    rows = spark.createDataFrame([*((k, *v[:2]) for k, v in BLOCK_VECTORS.items()), ("argon2id", "", "")], "name string, key string, text string")
    return rows.select("name", run("name", "key", "text").alias("result"))


def kdf_vectors(spark, sf_dir):
    ship(spark)
    rows = spark.createDataFrame([(k, "password", bytearray(b"salt" * 8)) for k in KDF_VECTORS], "kind string, password string, salt binary")
    return rows.select("kind", F.lower(F.hex(keys.derive(F.col("kind"), F.col("password"), F.col("salt")))).alias("key"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = """manifest_diff_summary manifest_snapshot manifest_diff deleted_files unchanged_carry_forward manifest_after_update manifest_last_wins restore_destinations destinations
    obfuscate_sha256 obfuscate_sha512 obfuscate_guid obfuscation_collisions dir_prefix_map path_containment result_metrics progress_running byte_size_format validation_warnings password_validity
    password_pool password_repetition password_sequence password_pattern password_year password_class password_leet password_strength password_description algorithm_catalog header_parse bzc_magic
    zstd_roundtrip aes_gcm_roundtrip aes_gcm_documents cipher_documents cipher_vectors kdf_vectors"""
    return {n: globals()[n] for n in names.split()}


# --- The same in DuckDB's SQL ---------------------------------------------------------------------------------------------------

_SQL_PASSWORDS = rf"""p0 AS (SELECT 'part ' || p_partkey AS owner, p_name AS password FROM part UNION ALL SELECT 'customer ' || c_custkey, c_name || '!Abcd 1999' || c_mktsegment FROM customer
 UNION ALL SELECT 'turn ' || conv_id || ' ' || turn, text FROM conversations),
p1 AS (SELECT owner, coalesce(password, '') AS password, regexp_replace(coalesce(password, ''), '^{pw.WHITE}+|{pw.WHITE}+$', '', 'g') AS s FROM p0),
p2 AS (SELECT *, lower(s) AS low, translate(lower(s), '{pw.LEET[0]}', '{pw.LEET[1]}') AS leet FROM p1)"""


def _sql_has(kind: str) -> str:
    return "regexp_matches(s, '" + pw.CLASSES[kind][0].replace("'", "''") + "')"


_SQL_CATEGORIES = "(" + " + ".join(f"CAST({_sql_has(k)} AS INT)" for k in pw.CLASSES) + ")"
_SQL_POOL = "(" + " + ".join(f"CASE WHEN {_sql_has(k)} THEN {n} ELSE 0 END" for k, (_, n) in pw.CLASSES.items()) + ")"
_SQL_REPETITION = "(1.5::DOUBLE * (CASE WHEN length(s) < 3 THEN 0 ELSE len(list_filter(range(3, length(s) + 1), lambda i: substr(s, i, 1) = substr(s, i - 1, 1) AND substr(s, i, 1) = substr(s, i - 2, 1))) END))"
_SQL_SEQUENCE = "(2.0::DOUBLE * (" + " + ".join(f"(length(low) - length(replace(low, '{q[:k]}', ''))) / {k}" for q in pw.both_ways() for k in range(3, len(q) + 1)) + "))"
_SQL_PATTERN = "(6.0::DOUBLE * (" + " + ".join(f"CAST(contains({x}, '{w}') AS INT)" for x in ("low", "leet") for w in pw.COMMON) + "))"
_SQL_YEAR = rf"(4.0::DOUBLE * len(regexp_extract_all(s, '{pw.YEAR}')))"
_SQL_CLASS = f"(CASE WHEN {_SQL_CATEGORIES} <= 1 THEN least(20.0, 2.0 * length(s)) WHEN {_SQL_CATEGORIES} = 2 AND length(s) < 10 THEN 10.0 ELSE 0.0 END)::DOUBLE"
_SQL_SCORED = f"""{_SQL_PASSWORDS},
p3 AS (SELECT *, {_SQL_CATEGORIES} AS cats, greatest(0.0::DOUBLE, (CASE WHEN {_SQL_POOL} > 1 THEN length(s) * log2({_SQL_POOL}) ELSE 0.0 END)::DOUBLE - ({_SQL_REPETITION} + {_SQL_SEQUENCE} + {_SQL_PATTERN} + {_SQL_YEAR} + {_SQL_CLASS})) AS bits FROM p2),
p4 AS (SELECT *, least(100.0::DOUBLE, bits / 120.0::DOUBLE * 100.0::DOUBLE) AS base FROM p3),
p5 AS (SELECT *, CASE WHEN base < 100 AND cats >= 4 AND length(s) >= 16 AND bits >= 90 THEN least(100.0::DOUBLE, base + 5) ELSE base END AS raw FROM p4),
p6 AS (SELECT *, CASE WHEN raw >= 85 THEN 4 WHEN raw >= 65 THEN 3 WHEN raw >= 45 THEN 2 WHEN raw >= 25 THEN 1 ELSE 0 END AS strength FROM p5)"""


def _sql_tips() -> str:
    t = pw.TIPS
    due = {"length": "length(s) < 12", **{k: f"NOT {_sql_has(k)}" for k in ("upper", "lower", "digit", "special")}, "variety": "cats < 4 AND length(s) < 16"}
    due |= {"sequences": " OR ".join(f"contains(low, '{q[:4]}')" for q in pw.both_ways()), "years": f"regexp_matches(s, '{pw.YEAR}')"}
    due["repeats"] = "length(s) > 1 AND len(list_filter(range(2, length(s) + 1), lambda i: substr(s, i, 1) = substr(s, i - 1, 1))) > 0"
    return "list_filter([" + ", ".join(f"CASE WHEN {due[k]} THEN '{v}' END" for k, v in t.items()) + "], lambda x: x IS NOT NULL)[1:3]"


def _sql_size(n: str) -> str:
    def shown(k: int, unit: str) -> str:
        tenths = f"CAST(floor(abs(CAST({n} AS DOUBLE)) / {1024**k}::DOUBLE * 10 + 0.5) AS BIGINT)"
        return f"({tenths} // 10) || '.' || ({tenths} % 10) || ' {unit}'"

    units = ("B", "KB", "MB", "GB", "TB")
    whens = " ".join(f"WHEN abs({n}) >= {1024**k} THEN {shown(k, units[k])}" for k in range(4, 0, -1))
    return f"CASE WHEN {n} = 0 THEN '0 B' {whens} ELSE {shown(0, 'B')} END"


def oracle_sql() -> dict[str, str]:
    with_tree, with_diff = f"WITH {_SQL_TREE} ", f"WITH {_SQL_TREE}, {_SQL_DIFF} "
    stored = """stored AS (SELECT relative_path, array_to_string(list_concat(list_transform(range(1, len(parts)), lambda i: sha256('/backup/' || array_to_string(parts[1:i], '/'))
      || regexp_extract(parts[i], '(\\.[^./]+)$', 1)), [sha256(content) || '.bzc']), '/') AS stored_path FROM (SELECT *, string_split(relative_path, '/') AS parts FROM tree))"""
    pages = "pg AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"
    outcomes = "o AS (SELECT user_id AS job, event_id AS seq, event_type <> 'error' AS ok, CAST(floor(value * 100 + 0.5) AS BIGINT) AS bytes, ts AS \"at\", CASE WHEN event_type = 'error' THEN 'file ' || event_id END AS error FROM events)"
    payloads = """pl AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN encode('BZC') || unhex(lpad(hex(doc_id % 5), 2, '0')) || encode(text)
      WHEN doc_id % 3 = 1 THEN unhex(sha256('salt' || doc_id)) || unhex(sha256('nonce' || doc_id))[1:12]
      ELSE unhex(sha256('salt' || doc_id)) || unhex(sha256('nonce' || doc_id))[1:12] || unhex(lpad(hex(doc_id % 5), 2, '0')) || encode(text) END AS content FROM documents)"""
    part = lambda value: f"WITH {_SQL_PASSWORDS} SELECT owner, {value} AS value FROM p2"
    values = ", ".join(f"('{f}', {int(x)}, '{x.name.lower()}')" for f, kind in FAMILIES.items() for x in kind)
    warned = f"CAST(count(*) AS BIGINT) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, {FREE_SPACE} < coalesce(sum(size), 0) * 1.2 AS low_space, CASE WHEN count(*) > 10000 THEN 'large' WHEN count(*) > 1000 THEN 'medium' ELSE 'none' END AS file_count"
    return {
        "manifest_snapshot": with_tree + "SELECT * FROM m",
        "manifest_diff": with_diff + "SELECT * FROM d",
        "manifest_diff_summary": with_diff + "SELECT status, count(*) AS files, CAST(sum(coalesce(size, 0)) AS BIGINT) AS bytes FROM d GROUP BY status",
        "deleted_files": with_tree + "SELECT * FROM m WHERE lower(relative_path) NOT IN (SELECT lower(relative_path) FROM s)",
        "unchanged_carry_forward": with_tree + "SELECT m.* FROM m WHERE EXISTS (SELECT 1 FROM s WHERE lower(s.relative_path) = lower(m.relative_path) AND s.source_hash = m.source_hash)",
        "manifest_after_update": with_tree + """SELECT m.*, 'carried' AS origin FROM m WHERE EXISTS (SELECT 1 FROM s WHERE lower(s.relative_path) = lower(m.relative_path) AND s.source_hash = m.source_hash)
            UNION ALL SELECT s.*, 'processed' FROM s WHERE NOT EXISTS (SELECT 1 FROM m WHERE lower(s.relative_path) = lower(m.relative_path) AND s.source_hash = m.source_hash)""",
        "manifest_last_wins": with_tree + "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY lower(relative_path) ORDER BY position DESC) AS rn FROM (SELECT *, 1 AS position FROM m UNION ALL SELECT *, 2 FROM s)) WHERE rn = 1",
        "restore_destinations": with_tree + """, b AS (SELECT relative_path || '.bzc' AS relative_path FROM tree UNION ALL SELECT 'MANIFEST.bzc'), e AS (SELECT upper(relative_path || '.bzc') AS k, relative_path AS original_path FROM tree WHERE doc_id % 13 <> 0)
            SELECT b.relative_path, e.k IS NOT NULL AS known, coalesce(e.original_path, b.relative_path) AS destination FROM b LEFT JOIN e ON lower(b.relative_path) = lower(e.k) WHERE lower(b.relative_path) <> 'manifest.bzc'""",
        "destinations": with_tree + "SELECT relative_path, CAST(doc_id % 4 AS INT) AS compression, CASE WHEN doc_id % 4 <> 0 THEN relative_path || '.bzc' ELSE relative_path END AS plain, relative_path || '.bzc' AS encrypted FROM tree",
        "obfuscate_sha256": f"WITH {_SQL_TREE}, {stored} SELECT relative_path, stored_path FROM stored",
        "obfuscation_collisions": f"WITH {_SQL_TREE}, {stored} SELECT lower(stored_path) AS destination_key, count(*) AS files, min(relative_path) AS winner FROM stored GROUP BY 1 HAVING count(*) > 1",
        "aes_gcm_documents": "SELECT doc_id, CAST(octet_length(encode(text)) + 16 AS BIGINT) AS sealed_length, sha256(text) AS digest, true AS wrong_fails FROM documents",
        "cipher_documents": """SELECT doc_id, cipher, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS sealed_length, sha256(coalesce(text, '')) AS digest, true AS wrong_fails
            FROM documents, (SELECT unnest(['chacha20', 'twofish', 'serpent', 'camellia']) AS cipher)""",
        "cipher_vectors": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in {**{k: v[2] for k, v in BLOCK_VECTORS.items()}, "argon2id": ARGON2_VECTOR}.items()) + ") AS t(name, result)",
        "kdf_vectors": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in KDF_VECTORS.items()) + ") AS t(kind, key)",
        "dir_prefix_map": f"""WITH {pages}, seg AS (SELECT string_split(path, '/') AS o FROM pg), e AS (SELECT o, unnest(range(1, len(o))) AS i FROM seg)
            SELECT array_to_string(o[1:i], '/') AS prefix, min(substr(sha256(o[i]), 1, 12)) AS name FROM e GROUP BY 1""",
        "path_containment": f"""WITH {pages}, b AS (SELECT page_id + 1 AS page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(path, '/?[^/]*$', '') ELSE upper(string_split(path, '/')[1]) END AS other FROM pg),
            j AS (SELECT pg.page_id, path, other, lower(regexp_replace(path, '/+$', '')) AS x, lower(regexp_replace(other, '/+$', '')) AS y FROM pg JOIN b ON pg.page_id = b.page_id)
            SELECT page_id, path, other, CASE WHEN x = y THEN 'same' WHEN starts_with(x, y || '/') THEN 'a_in_b' WHEN starts_with(y, x || '/') THEN 'b_in_a' ELSE 'apart' END AS relation FROM j""",
        "result_metrics": f"""WITH {outcomes}, g AS (SELECT job, count(*) AS total_files, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS processed_files, CAST(sum(CASE WHEN ok THEN bytes ELSE 0 END) AS BIGINT) AS processed_bytes, CAST(sum(bytes) AS BIGINT) AS total_bytes,
            (epoch_us(max("at")) - epoch_us(min("at"))) / 1e6 AS elapsed, arg_min(error, seq) FILTER (NOT ok) AS first_error FROM o GROUP BY job)
            SELECT job, total_files, processed_files, total_files - processed_files AS failed_files, processed_bytes, total_bytes, round(processed_files::DOUBLE / total_files, 6) AS success_rate, processed_files > 0 AND processed_files < total_files AS is_partial, processed_files = total_files AS is_success,
            round(CASE WHEN elapsed > 0 THEN processed_bytes::DOUBLE / elapsed ELSE 0 END, 6) AS bytes_per_second, round(CASE WHEN elapsed > 0 THEN processed_files::DOUBLE / elapsed ELSE 0 END, 9) AS files_per_second, first_error FROM g""",
        "progress_running": f"""WITH {outcomes}, r AS (SELECT job, seq, count(*) OVER w AS files, CAST(sum(bytes) OVER w AS BIGINT) AS done_bytes, CAST(sum(bytes) OVER (PARTITION BY job) AS BIGINT) AS all_bytes FROM o WINDOW w AS (PARTITION BY job ORDER BY seq ROWS UNBOUNDED PRECEDING))
            SELECT job, seq, files, done_bytes, round(CASE WHEN all_bytes > 0 THEN done_bytes * 100.0::DOUBLE / all_bytes ELSE 100.0 END, 6) AS percent FROM r""",
        "byte_size_format": f"""WITH z AS (SELECT 'order ' || o_orderkey AS name, CAST(floor(o_totalprice * pow(4.0::DOUBLE, o_orderkey % 12)) AS BIGINT) AS size FROM orders UNION ALL SELECT 'document ' || doc_id, CAST(strlen(text) AS BIGINT) FROM documents)
            SELECT name, size, {_sql_size("size")} AS shown FROM z""",
        "validation_warnings": f"WITH z AS (SELECT source, CAST(strlen(text) AS BIGINT) AS size FROM documents) SELECT source, {warned} FROM z GROUP BY source UNION ALL SELECT '(all)', {warned} FROM z",
        "password_validity": r"""WITH z AS (SELECT 'part ' || p_partkey AS owner, p_name AS password, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_brand ELSE '' END AS confirm FROM part
            UNION ALL SELECT 'turn ' || conv_id || ' ' || turn, text || ' ', text || ' ' FROM conversations)
            SELECT owner, array_to_string(list_filter([CASE WHEN trim(password) = '' THEN 'required' END, CASE WHEN trim(password) <> '' AND length(password) < 8 THEN 'too_short' END, CASE WHEN length(password) > 1000 THEN 'too_long' END,
            CASE WHEN trim(password) <> '' AND regexp_matches(password, '^\s|\s$') THEN 'outer_space' END, CASE WHEN confirm = '' THEN 'confirm_required' END, CASE WHEN confirm <> '' AND confirm <> password THEN 'confirm_differs' END], lambda x: x IS NOT NULL), ',') AS problems FROM z""",
        "password_pool": part(f"CAST({_SQL_POOL} AS INT)"),
        "password_repetition": part(_SQL_REPETITION),
        "password_sequence": part(_SQL_SEQUENCE),
        "password_pattern": part(_SQL_PATTERN),
        "password_year": part(_SQL_YEAR),
        "password_class": part(_SQL_CLASS),
        "password_leet": part("leet"),
        "password_strength": f"WITH {_SQL_SCORED} SELECT owner, strength, round_even(raw, 2)::DOUBLE AS score, round(bits, 6) AS entropy FROM p6",
        "password_description": f"""WITH {_SQL_SCORED}, p7 AS (SELECT *, {_sql_tips()} AS tips, CAST(floor(bits * 10 + 0.5) AS BIGINT) AS tenths FROM p6)
            SELECT owner, CASE WHEN password = '' THEN '{pw.EMPTY}' ELSE ['{"', '".join(pw.LABELS)}'][strength + 1] || ' // Entropy: ' || (tenths // 10) || '.' || (tenths % 10) || ' bits'
            || CASE WHEN len(tips) > 0 THEN ' // {pw.SUGGESTIONS} ' || array_to_string(tips, ', ') WHEN strength = 4 THEN ' // {pw.WELL_DONE}' ELSE '' END END AS description FROM p7""",
        "algorithm_catalog": f"SELECT * FROM (VALUES {values}) t(family, id, name)",
        "header_parse": f"WITH {payloads} SELECT doc_id, CASE WHEN octet_length(content) >= 45 THEN lower(hex(content[1:32])) END AS salt, CASE WHEN octet_length(content) >= 45 THEN lower(hex(content[33:44])) END AS nonce, CASE WHEN octet_length(content) >= 45 THEN CAST('0x' || hex(content[45:45]) AS INT) END AS compression, CASE WHEN octet_length(content) >= 45 THEN 45 END AS data_length FROM pl",
        "bzc_magic": f"WITH {payloads} SELECT doc_id, CASE WHEN octet_length(content) >= 4 AND hex(content[1:3]) = '425A43' AND hex(content[4:4]) IN ('00', '01', '02', '03') THEN CAST('0x' || hex(content[4:4]) AS INT) END AS mode FROM pl",
        "zstd_roundtrip": "SELECT doc_id, sha256(text) AS digest FROM documents",
        "aes_gcm_roundtrip": f"WITH {payloads} SELECT doc_id, CAST(octet_length(content) + 16 AS BIGINT) AS sealed_length, sha256(content) AS digest, true AS wrong_fails FROM pl",
    }
