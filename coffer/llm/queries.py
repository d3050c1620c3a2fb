"""The queries of the training-data operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from coffer.llm import bpe, embed_dedup, host_rules, html_extract, jaccard, packing, pii, quality_model, secrets, suffix_dedup
from coffer.llm.common import table

TOKENIZER = "byte_bpe_50k.json"


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), digests=True)


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.report(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_packing, op3_bpe, op4_embeddings, op5_jaccard, op6_html, op7_suffix_array, op8_quality, op9_host_rules, op10_pii)}


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Every pair of vectors of a label, and components by recursion; for test tables.
OP4_SQL = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.r AS x, b.r AS y FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT r AS x, r AS y FROM v UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
least AS (SELECT reach.x, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.y GROUP BY reach.x)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.x = v.r) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN least ON least.x = v.r"""

#: Every pair of documents with a common shingle, and components by recursion; for test tables.
OP5_SQL = r"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, md5(array_to_string(CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END, ' ')) AS h FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.r < b.r GROUP BY 1, 2),
half AS (SELECT x, y FROM pairs JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
link AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
reach AS (SELECT r AS x, r AS y FROM t UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT t.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id FROM t JOIN reach ON reach.x = t.r JOIN t o ON o.r = reach.y LEFT JOIN n ON n.r = t.r GROUP BY t.r, t.doc_id"""

OP9_SQL = rf"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: length(translate(x, {_SPACES}, '')) > 0) AS l FROM t),
five AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS five FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM w)),
twice AS (SELECT r, i FROM five QUALIFY count(*) OVER (PARTITION BY r, five) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS g(k) GROUP BY r),
m AS (SELECT w.r, doc_id, host, CAST(len(w) AS BIGINT) AS n_words, length(translate(text, {_SPACES}, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN covered ON covered.r = w.r),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 10 * n_symbols > word_chars OR 10 * n_dup_lines > 3 * n_lines OR word_chars > 12 * n_words OR 2 * word_chars < 5 * n_words AS soft FROM m),
h AS (SELECT host, count(*) AS n, sum(CAST(base_failed OR soft AS INT)) AS bad FROM f GROUP BY host),
p AS (SELECT least(greatest(avg(bad / n), 0.001), 0.999) AS mean, var_pop(bad / n) AS v, avg(1 / n) AS inverse FROM h),
q AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(v - mean * (1 - mean) * inverse, mean * (1 - mean) / 1000) - 1, 2), 1000) AS strength FROM p),
j AS (SELECT host, (bad + mean * strength) / (n + strength) >= 0.5 AS host_bad FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR (host_bad AND soft)) AS kept FROM f JOIN j ON f.host = j.host"""


def oracle_sql() -> dict[str, str]:
    return {"op4_embeddings": OP4_SQL, "op5_jaccard": OP5_SQL, "op9_host_rules": OP9_SQL}
