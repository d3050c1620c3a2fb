"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Base spans (assign, access, hex) follow fixed patterns and always stay. Every other run of ``LEAST`` or more token
characters is scored by the log-likelihood ratio of two first-order Markov models over characters, per character; what
reaches ``ACCEPT`` and overlaps no base span is added as ``random``. The models are trained from labelled samples by
DataFrame aggregation; at most two numbers for each pair of alphabet characters come to the driver. Scanning is a
projection of built-in functions: no shuffle, no Python on the executors.

Null text counts as empty; null or repeated ids and extra columns pass, as rows are never joined; an empty table gives an
empty result. Empty samples give models without preference, which accept nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.llm.native import found, let

KINDS = ("assign", "access", "hex", "random")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
LEAST, ACCEPT = 20, 0.35
#: Pseudo-count of each pair when a model is trained.
SMOOTHING = 0.3

# Fixed patterns of the base kinds. Runs shorter than the limit of access and hex never hide a longer one, so the limit is part of the pattern.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"

# Fixed word list of the ordinary identifiers' samples.
_WORDS = (
    "get set user name value index count list map data file path size type key item node parent child first last next start end time date total "
    "error message result request response client server config option default handler service manager factory builder reader writer parser buffer "
    "stream string number integer boolean array table column row query filter group order limit offset page header footer content body title label "
    "the and that with from this have are for not but they were been their which would there other about into than them these some could when will "
    "state house nation under water people number country through between important government development information international"
).split()


def samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled samples (token, random): digests in hexadecimal, base-64 and mixed alphabets; identifiers in the usual styles."""
    seed = F.concat(F.lit("sample-"), F.col("id").cast("string"))
    sha = F.sha2(seed, 256)
    mixed = F.regexp_replace(F.base64(F.unhex(sha)), "[+/=]", "")
    random = spark.range(n).select(
        F.when(F.col("id") % 4 == 0, F.substring(sha, 1, 40)).when(F.col("id") % 4 == 1, F.base64(F.unhex(sha))).when(F.col("id") % 4 == 2, mixed).otherwise(F.translate(F.base64(F.unhex(sha)), "+/=", "-_")).alias("token"),
        F.lit(True).alias("random"),
    )
    listed = F.array(*[F.lit(w) for w in _WORDS])
    word = lambda k: F.get(listed, (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(_WORDS)))).cast("int"))
    a, b, c = word(1), word(2), word(3)
    styles = [
        F.concat_ws("_", a, b, c),
        F.concat(a, F.initcap(b), F.initcap(c)),
        F.concat(a, b, c),
        F.upper(F.concat_ws("_", a, b)),
        F.concat_ws("-", a, b, c),
        F.concat_ws("/", a, b, c),
        F.concat(F.initcap(a), F.initcap(b), F.pmod(F.col("id"), F.lit(100)).cast("string")),
    ]
    style = F.get(F.array(*styles), (F.col("id") % len(styles)).cast("int"))
    return random.unionByName(spark.range(n).select(style.alias("token"), F.lit(False).alias("random")))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios (random against ordinary) of all character pairs, row by row of the alphabet."""
    token = F.regexp_replace("token", f"[^{ALPHABET.replace('-', '')}-]", "")
    pairs = labelled.where(F.col("random").isNotNull()).select("random", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(token) - 1, F.lit(1))), lambda i: F.substring(token, i, F.lit(2)))).alias("pair"))
    counted = {(r["random"], r["pair"]): r["n"] for r in pairs.where(F.length("pair") == 2).groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}
    models = []
    for label in (True, False):
        model = {}
        for a in ALPHABET:
            row = [counted.get((label, a + b), 0) + SMOOTHING for b in ALPHABET]
            model |= {a + b: math.log(x / sum(row)) for b, x in zip(ALPHABET, row, strict=True)}
        models.append(model)
    return [round(models[0][a + b] - models[1][a + b], 4) for a in ALPHABET for b in ALPHABET]


def ratio(token: Column, table: Column) -> Column:
    """Mean log-likelihood ratio per pair of a token's characters."""
    code = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))) - 1
    steps = F.sequence(F.lit(1), F.length(token) - 1)
    total = F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.get(table, code(i) * len(ALPHABET) + code(i + 1)))
    return total / (F.length(token) - 1)


def spans(text: Column, ratios: list[float]) -> Column:
    """array<struct<start, kind, end>>, sorted; ``kind`` is the place in KINDS."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # a constant: folded once
    kind = lambda spans_of, k: F.transform(spans_of, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))
    assign = F.filter(found(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 1)) >= 6)
    base = F.concat(kind(assign, 0), kind(found(text, ACCESS), 1), kind(found(text, HEX), 2))
    scored = F.filter(found(text, TOKEN), lambda x: ratio(x["value"], table) >= ACCEPT)
    return let(base, lambda b: F.sort_array(F.concat(b, kind(F.filter(scored, lambda x: ~F.exists(b, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))), 3))))


def joined(spans_of: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_of, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, ratios: list[float] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, spans array<struct<start, kind, end>>."""
    ratios = train(samples(docs.sparkSession)) if ratios is None else ratios
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), spans(F.coalesce(F.col(text_column), F.lit("")), ratios).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """The query's rows: doc_id, counts by base kind, digest of base spans, all spans."""
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return scan(docs).select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
