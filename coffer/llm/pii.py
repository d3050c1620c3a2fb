"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Candidates for more are numbers with separators,
names after a title or with a listed given name, and handles. Regular-expression, gazetteer and context labelers vote for,
against or not at all. A first pass over all documents counts the codes (votes and span features) of all candidates; there
are at most ``1 << BITS`` codes, so the counts that reach the driver are bounded. Expectation-maximisation over the votes estimates
the labelers' reliabilities; a logistic model on the features alone, fitted to its posteriors, gives each code a probability.
A second pass adds the candidates that reach ``ACCEPT`` and overlap no base span.

Null text counts as empty; null or repeated ids and extra columns pass, as rows are never joined; an empty table gives an
empty result and a model of prior odds.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import arrow, texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("number", "name", "handle")
ACCEPT = 0.5
#: Characters before a candidate in which context labelers look.
CONTEXT = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
# A run of digits that can't start a match can't start one further on either, so each run is tried once.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SEPARATORS = str.maketrans("", "", " ().+-/")
_DOUBLED = str.maketrans("0123456789", "0246813579")


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(map(int, digits[-2::-2].translate(_DOUBLED)))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind in BASE, end) of all base spans, in that order."""
    out = []
    if "@" in text:
        last, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at)):
                out.append((start, 0, m.end()))
                last = m.end()
                at = text.find("@", last)
            else:
                at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(x := g.lstrip("0")) < 4 and int(x or 0) <= 255 for g in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].translate(_SEPARATORS)) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# Fixed word lists of the gazetteer and context labelers.
_TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Madame", "Monsieur")
_GIVEN = frozenset(
    "Adam Alan Alice Amanda Amy Andrew Angela Ann Anna Anne Anthony Antonio Barbara Benjamin Betty Brian Carlos Carmen Carol Caroline Catherine Charles Christine Christopher Claire "
    "Daniel David Deborah Dennis Diana Donald Donna Dorothy Edward Elena Elizabeth Emily Emma Eric Erik Eva Fatima Francisco Frank Franz Gary George Gerhard Giovanni Giulia Gregory "
    "Hans Heather Heidi Helen Helga Henry Ingrid Isabel Ivan Jack Jacob James Jane Janet Jason Javier Jean Jeffrey Jennifer Jessica Joan John Jonathan José Joseph Joshua Juan Julia Jürgen "
    "Karen Karl Kathleen Kenneth Kevin Kimberly Klaus Larry Laura Lisa Linda Lucia Luis Manuel Margaret Maria Marie Mark Martha Mary Matthew Michael Michelle Miguel Mohammed Nancy Nicole "
    "Olga Pamela Patricia Paul Pedro Peter Philippe Pierre Rachel Rebecca Richard Robert Ronald Ruth Ryan Samantha Sandra Sarah Scott Sharon Sofia Stephanie Stephen Steven Susan "
    "Thomas Timothy Ursula Virginia Walter William Wolfgang".split()
)
_CUES = re.compile(r"(?:phone|tel|call|mobile|fax|ssn|social security|passport|iban|account|licen[cs]e no|id no|born|birth|name|contact|patient|customer|teléfono|telefon|téléphone)\b[^\n]{0,12}$", re.I)
_AGAINST = re.compile(r"(?:version|figure|table|page|isbn|total|price|order|equation|chapter|\$|€|£|%|#)\s*$", re.I)
_NUMBER = re.compile(r"(?<![0-9A-Za-z.,+])[0-9](?:[\x20()./-]{0,2}[0-9]){5,21}(?![0-9A-Za-z]|[.,][0-9])")
# A listed word is looked up, as a pattern of all of them would try each at every word.
_CAPITAL = re.compile(r"\b[A-Z][^\W\d_]+(?=\.?\x20[A-Z])")
_REST = re.compile(r"(\.?)\x20[A-Z][^\W\d_]+(?:\x20[A-Z][^\W\d_]+)?")
_HANDLE = re.compile(r"(?<![\w@.])@[A-Za-z][A-Za-z0-9_]{2,30}\b")
_SHAPED = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|0[0-9]{2,4}[\x20/-][0-9]{4,8}")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[/.-][01]?[0-9][/.-][0-3]?[0-9]|[0-3]?[0-9][/.-][01]?[0-9][/.-](?:19|20)[0-9]{2}")

#: Labelers and the vote that each gives when it gives one: 1 for personal data, 2 against.
LABELERS = {"shape": 1, "cue": 1, "gazetteer": 1, "title": 1, "against": 2, "bare": 2}
#: What the classifier sees: the span's kind, form and neighbours.
FEATURES = ("number", "name", "cued", "against", "titled", "listed", "shaped", "dated", "parts", "long", "uniform", "marked", "ended")
#: One bit for each labeler and feature.
BITS = len(LABELERS) + len(FEATURES)
_PART = re.compile(r"[0-9]+|[^\W\d_]+")


def _names(text: str) -> Iterator[tuple[int, int]]:
    """Spans of a title or a listed given name and one or two words after it."""
    last = 0
    for m in _CAPITAL.finditer(text):
        if m.start() >= last and ((titled := m[0] in _TITLES) or m[0] in _GIVEN) and (rest := _REST.match(text, m.end())) and (titled or not rest[1]):
            last = rest.end()
            yield m.start(), last


def candidates(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, number of the kind after BASE, end, code) of candidate spans. A code has a bit for each labeler that votes and each feature that holds."""
    numbers, handles = ((m.span() for m in pattern.finditer(text)) for pattern in (_NUMBER, _HANDLE))
    for kind, spans in enumerate((numbers, _names(text), handles if "@" in text else ())):
        for start, end in spans:
            span, before = text[start:end], text[max(0, start - CONTEXT) : start]
            cued, against = bool(_CUES.search(before)), bool(_AGAINST.search(before))
            first = span.split(" ", 1)[0].rstrip(".")
            shaped = kind == 0 and bool(_SHAPED.fullmatch(span))
            dated = kind == 0 and bool(_DATE.fullmatch(span))
            listed = kind == 1 and any(w in _GIVEN for w in span.split())
            titled = kind == 1 and first in _TITLES
            voting = (shaped, cued, listed, titled, against or dated)
            voting = (*voting, not any(voting[:4]))  # bare: nothing speaks for it
            parts = len(_PART.findall(span))
            uniform = len({c for c in span if not c.isalnum()}) < 2
            marked = before.rstrip(" ").endswith((":", "="))
            ended = text[end : end + 1] in ("", "\n", ".", ",", ";", ")")
            features = (kind == 0, kind == 1, cued, against, titled, listed, shaped, dated, parts > 2, len(span) > 12, uniform, marked, ended)
            code = 0
            for bit in (*voting, *features):
                code = code << 1 | bit
            yield start, len(BASE) + kind, end, code


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = Counter(code for t in texts(batch.column(0)) for *_, code in candidates(t))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["code", "n"])


def unpack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes (0 where a labeler gives none) and features of codes."""
    bits = np.stack([codes >> (BITS - 1 - i) & 1 for i in range(BITS)], axis=1).astype(int)
    k = len(LABELERS)
    return bits[:, :k] * np.array(list(LABELERS.values())), bits[:, k:].astype(float)


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of each row of votes, and each labeler's P(vote | class) as [labeler, class, vote]. Votes are taken as independent given the class."""
    start = (votes == 1).sum(1) - (votes == 2).sum(1)
    posterior = np.clip(0.35 + 0.3 * start, 0.02, 0.98)
    tables = np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        prior = np.clip((weight.sum(1) + 1) / (counts.sum() + 2), 0.01, 0.99)
        log = np.log(prior)[:, None] + np.zeros_like(weight)
        for k in range(votes.shape[1]):
            for v in range(3):  # Labelers are better than chance by assumption: pseudo-counts lean to their vote's class.
                lean = np.array([[6, 1, 3], [6, 3, 1]])[:, v]
                tables[k, :, v] = weight[:, votes[:, k] == v].sum(1) + lean
            tables[k] /= tables[k].sum(1, keepdims=True)
            log += np.log(tables[k][:, votes[:, k]])
        log -= log.max(0)
        new = np.exp(log[1]) / np.exp(log).sum(0)
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return posterior, tables


def logistic(features: np.ndarray, target: np.ndarray, counts: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic model on soft targets, by Newton steps."""
    x = np.c_[features, np.ones(len(features))]
    w, share = np.zeros(x.shape[1]), counts / max(counts.sum(), 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - target)) + 1e-4 * w
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1])
        w = w - np.linalg.solve(curve, slope)
    return w


class Classifier:
    """Span probabilities by code. The posteriors of the votes are its targets only: it sees the features of span and context."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.reliabilities, self.weights, self.probability = np.zeros((len(LABELERS), 2, 3)), np.r_[np.zeros(len(FEATURES)), -3.0], {}
        if len(codes):
            votes, features = unpack(codes)
            posterior, self.reliabilities = expectation_maximisation(votes, counts)
            self.weights = logistic(features, posterior, counts)
            p = 1 / (1 + np.exp(-np.clip(np.c_[features, np.ones(len(codes))] @ self.weights, -30, 30)))
            self.probability = dict(zip(codes.tolist(), p.tolist(), strict=True))


def train(docs: DataFrame, text_column: str = "text") -> Classifier:
    """Learns from the candidates of all documents. At most ``1 << BITS`` counts come to the driver, some dozens in practice."""
    counted = arrow(docs.select(F.col(text_column).alias("t")), _count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas().sort_values("code")
    return Classifier(counted["code"].to_numpy(np.int64), counted["n"].to_numpy(float))


def find(text: str, probability: dict[int, float]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base spans and of accepted candidates that overlap none, sorted."""
    base = base_spans(text)
    more = [x[:3] for x in candidates(text) if probability.get(x[3], 0) >= ACCEPT]
    return sorted([*base, *(x for x in more if not any(x[0] < e and s < x[2] for s, _, e in base))]) if more else base


def detect(docs: DataFrame, model: Classifier | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, spans array<struct<kind, start, end>> (code points, end exclusive), masked text."""
    probability = (model or train(docs, text_column)).probability
    kinds = (*BASE, *ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans, masked = [], []
            for t in batch.column(1).to_pylist():
                found = find(t or "", probability)
                spans.append([{"kind": kinds[k], "start": s, "end": e} for s, k, e in found])
                masked.append(None if t is None else mask(t, found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(masked, pa.string())], names=["doc_id", "spans", "masked"])

    return arrow(docs.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).alias("t")), run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>, masked string")


def mask(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in angle brackets."""
    out, at = [], 0
    for s, k, e in found:
        if s >= at:
            out += [text[at:s], f"<{(*BASE, *ADDED)[k]}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked and ``n_chars``, if there, counted again. Other columns stay."""
    probability = train(docs).probability
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([None if t is None else mask(t, find(t, probability)) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = arrow(docs, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest(spans: list[tuple[int, int, int]]) -> str:
    kinds = (*BASE, *ADDED)
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def report(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """The query's rows: doc_id, counts by base kind, digest of base spans, all spans."""
    probability = (model or train(docs)).probability

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t, probability) for t in texts(batch.column(1))]
            base = [[x for x in f if x[1] < len(BASE)] for f in found]
            counts = [pa.array([sum(x[1] == k for x in b) for b in base], pa.int64()) for k in range(len(BASE))]
            hashes = pa.array([hashlib.sha256(digest(b).encode()).hexdigest() for b in base])
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, hashes, pa.array([digest(f) for f in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return arrow(docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t")), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
