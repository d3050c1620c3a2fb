"""Quality rules of documents and of their hosts.

Each document gets counts and hard and soft rule failures, all by built-in functions. Failures are summed by host
(``source``); a beta prior is fitted to the hosts' rates by moments, which draws rates of small hosts to the mean; a host
whose shrunken rate reaches ``BAD`` is bad. The verdict goes back to its documents: a document fails with a hard failure
anywhere, and with a soft failure on a bad host; a document that breaks no rule is kept wherever it is from.

Null text counts as empty (and fails, having too few words); documents without a host form one group of their own. Null or
repeated ids and extra columns pass. With no documents the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import cut, lookup
from coffer.llm.native import SPACES, let, words

WINDOW, FEW_WORDS, REPEAT_PERCENT = 5, 10, 20
SYMBOLS = "#*$%&|<>"
#: A host is bad when its shrunken share of failing documents reaches this.
BAD = 0.5


def repeated_words(w: Column) -> Column:
    """Words in windows that occur twice or more. Window hashes are sorted with their places, so equal ones are neighbours; hashes have 64 bits."""
    places = F.sequence(F.lit(0), F.size(w) - WINDOW)
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(at: Column) -> Column:
        """Words under windows that start at sorted places."""
        return F.aggregate(F.sequence(F.lit(1), F.size(at)), F.lit(0), lambda s, k: s + F.least(F.lit(WINDOW), F.coalesce(F.get(at, k) - F.get(at, k - 1), F.lit(WINDOW))))

    def twice(s: Column) -> Column:
        equal = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        hit = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: equal(i, i - 1) | equal(i, i + 1))
        return let(F.sort_array(F.transform(hit, lambda i: F.get(s, i)["i"])), lambda at: F.when(F.size(at) > 0, covered(at)).otherwise(0))

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(placed, twice))

    return F.when(F.size(w) < WINDOW, 0).otherwise(let(hashes, count)).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """Counts of a text that isn't null."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    by_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    return {
        "by_words": by_words,
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
    }


def measured(docs: DataFrame, host_column: str = "source") -> DataFrame:
    """doc_id, host, the counts, base_failed and soft_failed of every row."""
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(host_column).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counted = counted.select("doc_id", "host", *[c.alias(n) for n, c in measures(F.col("text")).items()]).select("doc_id", "host", "by_words.*", "word_chars", "n_symbols", "n_dup_lines", "n_lines")
    n = F.col("n_words")
    hard = (n < FEW_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * n)
    soft = (10 * F.col("n_symbols") > F.col("word_chars")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")) | (F.col("word_chars") > 12 * n) | (2 * F.col("word_chars") < 5 * n)
    return counted.withColumns({"base_failed": hard, "soft_failed": soft})


def verdicts(rows: DataFrame, bad: float = BAD) -> DataFrame:
    """host, n, n_failed, rate (shrunken), host_bad. One row goes back from the fit of the prior, however many hosts there are."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("n_failed"))
    hosts = cut(hosts)
    rate = F.col("n_failed") / F.col("n")
    fit = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"), F.avg(1 / F.col("n")).alias("inverse")).first()
    mean = min(max(fit["mean"] or 0.0, 1e-3), 1 - 1e-3)
    spread = mean * (1 - mean)
    # Of the variance of rates, what sampling alone makes is taken off; the rest is the prior's.
    between = max((fit["var"] or 0.0) - spread * (fit["inverse"] or 1.0), spread / 1000)
    strength = min(max(spread / between - 1, 2.0), 1000.0)
    shrunk = (F.col("n_failed") + mean * strength) / (F.col("n") + strength)
    return hosts.withColumn("rate", shrunk).withColumn("host_bad", shrunk >= bad)


def judge(docs: DataFrame, host_column: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, counts, failures, the host's rate and verdict, kept."""
    rows = cut(measured(docs, host_column))
    joined = lookup(rows, verdicts(rows).select("host", "rate", "host_bad"), "host")
    return joined.withColumn("kept", ~(F.col("base_failed") | (F.col("host_bad") & F.col("soft_failed"))))


def report(docs: DataFrame) -> DataFrame:
    """The query's rows."""
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
