"""Each query of the engine against its SQL in DuckDB."""

import hashlib
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest

from coffer.plans import queries as core

SF = "/root/testdata/sf0.001"


def norm(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(core.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = core.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    found = duck.sql(core.oracle_sql()[name])
    assert sorted(found.columns) == columns
    theirs = sorted(tuple(norm(dict(zip(found.columns, r, strict=True))[c]) for c in columns) for r in found.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", ["obfuscate_sha512", "obfuscate_guid"])
def test_one_row_per_document(spark, name):
    rows = core.queries()[name](spark, SF).collect()
    assert len({r["relative_path"] for r in rows}) == len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    folders = {}
    for r in rows:  # a folder has one name
        assert folders.setdefault(r["relative_path"].split("/")[0], r["stored_path"].split("/")[0]) == r["stored_path"].split("/")[0]


def test_every_document_is_sealed_whole(spark):
    texts = {r["doc_id"]: r["text"].encode() for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    rows = core.queries()["aes_gcm_documents"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]]
        assert (r["sealed_length"], r["digest"], r["wrong_fails"]) == (len(raw) + 16, hashlib.sha256(raw).hexdigest(), True)
