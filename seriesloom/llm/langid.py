"""Operator 7, language identification.

Sparse multinomial logistic regression on TF-IDF weighted character n-grams. The
n-grams of the lower-cased text, orders one to four, are hashed to a fixed number
of features. Inverse document frequencies are counted over every training row.
The weights are learned with follow-the-regularised-leader and elastic-net
penalties on a bounded sample of labelled rows (``per_language``), and a
temperature fitted on a held-back fifth of that sample calibrates the scores.
Learning runs in one task that reads the sample as a stream, once a round; only
the weights, a table of fixed size, reach the driver. Prediction is one pass over
the whole texts; a text beyond ``LONG`` characters is read in stretches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.common import dropped, slices, stored

ORDERS = (1, 2, 3, 4)
FEATURES = 1 << 16
#: Labelled rows of each language that the weights are learned from, about.
PER_LANGUAGE = 1500
#: Characters of one text whose n-grams are held at once.
LONG = 1_000_000
UNDETERMINED = "und"
_letter = re.compile(r"[^\W\d_]")
_ROUNDS = 4


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the features of all n-grams of all texts, one after
    another, and each text's number of them. n-grams never cross texts."""
    low = [t.lower() for t in texts]
    lengths = np.fromiter(map(len, low), np.int64, len(low))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    h = np.zeros(len(codes), np.uint64)
    for n in ORDERS:
        # h[i] is the hash of the n characters that end at i
        h = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + (codes + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        have = np.maximum(lengths - n + 1, 0)
        if n > 1:
            keep = np.ones(len(codes), bool)
            for back in range(min(n - 1, int(lengths.max(initial=0)))):
                at = ends - lengths + back
                keep[at[lengths > back]] = False
            kept = h[keep]
        else:
            kept = h
        yield ((kept * np.uint64(0xA24BAED4963EE407)) >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64), have


def stretches(text: str, long: int = LONG) -> Iterator[np.ndarray]:
    """The features of one text's n-grams, an order and a stretch at a time; an
    n-gram across two stretches is counted in the later one."""
    low, back = text.lower(), max(ORDERS) - 1
    for at in range(0, max(len(low), 1), long):
        for n, (found, _) in zip(ORDERS, grams([low[max(0, at - back) : at + long]]), strict=True):
            yield found[max(0, min(at, back) - n + 1) :]


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's features and their counts."""
    if len(text) <= LONG:
        return np.unique(np.concatenate([g for g, _ in grams([text])]), return_counts=True)
    total = np.zeros(FEATURES, np.int64)
    for found in stretches(text):
        total += np.bincount(found, minlength=FEATURES)
    used = np.flatnonzero(total)
    return used, total[used]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages, with the IDF folded in
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated probability of each text."""
        whole = [t or "" for t in texts]
        if not self.languages:
            return [UNDETERMINED] * len(whole), np.zeros(len(whole))
        logits, total = np.zeros((len(whole), len(self.languages))), np.zeros(len(whole))
        for i in [i for i, t in enumerate(whole) if len(t) > LONG]:
            for found in stretches(whole[i]):
                logits[i] += self.weights[found].sum(axis=0)
                total[i] += len(found)
        for found, have in grams([t if len(t) <= LONG else "" for t in whole]):
            has = np.flatnonzero(have)
            if len(has):
                at = np.cumsum(have)[has] - have[has]
                for k in range(len(self.languages)):  # a column at a time: sums in double precision
                    logits[has, k] += np.add.reduceat(self.weights[:, k][found], at, dtype=np.float64)
            total += have
        logits = (logits / np.maximum(total, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        blank = [_letter.search(t) is None for t in whole]
        return [UNDETERMINED if b else self.languages[i] for b, i in zip(blank, best, strict=True)], np.where(blank, 0.0, p.max(axis=1))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all the texts each feature occurs, and how many there are.
    Each task adds up its own rows; the sums are one row a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(FEATURES, np.int64), 0
        for batch in slices(batches, 250, "text", 250_000):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            seen = np.zeros((len(texts), FEATURES), bool) if len(texts) * FEATURES < 1 << 26 else None
            if seen is None:
                for t in texts:
                    total[counted(t)[0]] += 1
            else:
                for found, have in grams(texts):
                    seen[np.repeat(np.arange(len(texts)), have), found] = True
                total += seen.sum(axis=0)
            rows += len(texts)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], rows))], names=["f", "n"])

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    f, n = sums["f"].to_numpy(), sums["n"].to_numpy()
    out = np.zeros(FEATURES, np.int64)
    out[f[f >= 0]] = n[f >= 0]
    return out, int(n[f < 0].sum())


def sample(docs: DataFrame, rates: dict[str, float], id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``(label, draw, f, c)``: labelled rows as features and their counts, the
    given share of each language, picked by a hash of the id."""
    draw = (F.xxhash64(F.lit("sample"), F.col(id_col)).bitwiseAND(F.lit((1 << 40) - 1))) / float(1 << 40)
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])[F.col(label_col)]
    picked = docs.where(draw < rate).select(F.col(label_col).alias("label"), draw.alias("draw"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500, "text"):
            pairs = [counted(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f.astype("<u2").tobytes() for f, _ in pairs], pa.binary()), pa.array([c.astype("<f4").tobytes() for _, c in pairs], pa.binary())], names=["label", "draw", "f", "c"])

    return picked.mapInArrow(run, "label string, draw double, f binary, c binary")


class Ftrl:
    """Follow the regularised leader, per coordinate, for softmax outputs."""

    def __init__(self, features: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        u = x @ w
        p = np.exp(u - u.max())
        p /= p.sum()
        p[label] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", alpha: float = 0.5, l1: float = 0.002, l2: float = 0.01) -> Model:
    """Learn from the rows that have a label. No labelled row: a model without
    languages, which finds every text undetermined."""
    docs = docs.where(F.col(label_col).isNotNull()).withColumn(label_col, F.col(label_col).cast("string"))
    counts = {r[0]: r[1] for r in docs.groupBy(label_col).count().collect()}  # one row a language
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    df, n = document_frequencies(docs, text_col)
    idf = np.log((1 + n) / (1 + df)) + 1
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # one number a feature
    scale = 30.0

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weight = Ftrl(FEATURES + 1, len(languages), alpha, 1.0, l1, l2), shared.value
        final, logits, labels = None, [], []
        for batch in batches:
            for turn, label, f, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                at, x = np.frombuffer(f, "<u2").astype(np.int64), np.frombuffer(c, "<f4").astype(float)
                x = np.append(scale * x / max(1.0, x.sum()) * weight[at], 1.0)
                at = np.append(at, FEATURES)
                if turn < _ROUNDS:
                    model.step(at, x, languages.index(label))
                else:
                    final = model.weights() if final is None else final
                    logits.append(x @ final[at])
                    labels.append(languages.index(label))
        w = model.weights()
        w[:-1] *= weight[:, None] * scale
        temperature = _temperature(np.array(logits), np.array(labels)) if labels else 1.0
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([temperature])], names=["w", "temperature"])

    rows = stored(sample(docs, {k: min(1.0, per_language / c) for k, c in counts.items()}, id_col, text_col, label_col), "sample")
    held = F.pmod(F.xxhash64(F.lit("held"), "draw", "f"), F.lit(5)) == 0
    turns = F.when(held, F.array(F.lit(_ROUNDS))).otherwise(F.sequence(F.lit(0), F.lit(_ROUNDS - 1)))
    stream = rows.select(F.explode(turns).alias("turn"), "label", "f", "c", "draw").repartition(1).sortWithinPartitions("turn", "draw", "label", "f")
    spark, size = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "200")  # rows are large, and one task holds a batch of them
    try:
        found = stream.select("turn", "label", "f", "c").mapInArrow(learn, "w binary, temperature double").collect()  # one row, FEATURES x languages numbers
    finally:
        spark.conf.set(size, before)
    dropped(rows)
    if not found:
        return Model(languages, np.zeros((FEATURES, len(languages))), np.zeros(len(languages)), 1.0)
    w = np.frombuffer(found[0].w, float).reshape(FEATURES + 1, len(languages))
    return Model(languages, w[:-1], w[-1], found[0].temperature)


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    def loss(log_t: float) -> float:
        u = logits / math.exp(log_t)
        u = u - u.max(axis=1, keepdims=True)
        return float((np.log(np.exp(u).sum(axis=1)) - u[np.arange(len(u)), labels]).mean())

    low, high = math.log(0.2), math.log(5.0)
    for _ in range(40):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with two columns more: the language of each whole text and its
    calibrated probability. A text that is null or has no letter is ``und`` with
    score 0. All rows stay, repeated ones too; existing columns of those two
    names are replaced. An empty table stays empty.
    """
    docs = docs.drop(lang_col, score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features x languages numbers
    at = docs.columns.index(text_col)
    schema = T.StructType(list(docs.schema.fields)).add(lang_col, "string").add(score_col, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 250, text_col, 250_000):
            names, scores = shared.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang_col, score_col])

    return docs.mapInArrow(run, schema)


def accepted(lang: Column, score: Column, least: float = 0.5) -> Column:
    """Whether a document has a language: determined, at ``least`` likely."""
    return (lang != UNDETERMINED) & (score >= least)
