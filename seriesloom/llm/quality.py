"""Operator 6, quality: a linear-chain conditional random field over lines.

Every line of a text is a node labelled good or bad. Its features are its own,
its neighbours' and the place it takes; neighbouring labels share a weight.
The field is trained on a bounded sample of labelled documents (``per_label``),
whose lines take their document's label; forward-backward marginals of the lines,
weighted by their lengths, are the document's raw quality, and a logistic map
fitted on a held-back fifth of the sample makes a probability of it. Scoring is
one pass over whole texts with a model of about a hundred numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.common import slices

#: Labelled documents of either label that the field is trained on, about.
PER_LABEL = 1500
#: Characters of a document in that sample at most; all are scored.
LONGEST = 1_000_000
THRESHOLD = 0.3
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_STOPS = b".,;:'\"-()"
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _STOPS)
OWN = 14


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x OWN) and byte lengths of a text's lines."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    rows, seen = [], set()
    for line in lines:
        n = len(line)
        if not n:
            rows.append((0.0,) * (OWN - 2) + (1.0, 0.0))
            continue
        words = line.split()
        w = len(words) or 1
        upper = n - len(line.translate(None, _UPPER))
        lower = n - len(line.translate(None, _LOWER))
        rest = n - len(line.translate(None, _SYMBOLS))
        twice = sum(map(eq, words, words[1:]))
        rows.append(
            (
                upper / (upper + lower + 1),
                rest / n,
                min(1.0, 3 * rest / w),
                line.count(b"|") / w,
                line.count(b"!") / w,
                (n - len(line.translate(None, _DIGITS))) / n,
                twice / w,
                1 - len(set(words)) / w,
                min(1.0, w / 40) * (1 - len(set(words)) / w),
                min(2.0, n / w / 10),
                np.log1p(n) / 8,
                float(line[-1:] in (b".", b"!", b"?")),
                0.0,
                float(line in seen),
            )
        )
        seen.add(line)
    return np.array(rows), np.array([len(x) + 1 for x in lines], float)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Own features, the previous and the next line's, the line's place, and 1."""
    edge = np.zeros((1, own.shape[1]))
    first, last = np.zeros((len(own), 1)), np.zeros((len(own), 1))
    first[0], last[-1] = 1, 1
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), first, last, np.ones((len(own), 1))])


WIDTH = 3 * OWN + 3


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(unary: np.ndarray, pair: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward on many chains at once, laid out one after another.

    unary: the score of "good" at each node ("bad" is 0); pair[i, j]: the score of
    label i followed by j. Returns P(good) of each node, log Z of each chain, and
    the expected label pairs summed over each chain's links.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    n, top = len(unary), int(sizes[0]) if len(sizes) else 0
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    active = np.searchsorted(-sizes, -np.arange(top), side="left")  # chains longer than t
    alpha[starts, 1] = unary[starts]
    for t in range(1, top):
        at = starts[: active[t]] + t
        for j in (0, 1):
            alpha[at, j] = _log_add(alpha[at - 1, 0] + pair[0, j], alpha[at - 1, 1] + pair[1, j]) + (unary[at] if j else 0)
    for t in range(top - 1, 0, -1):
        at = starts[: active[t]] + t
        for i in (0, 1):
            beta[at - 1, i] = _log_add(pair[i, 0] + beta[at, 0], pair[i, 1] + unary[at] + beta[at, 1])
    log_z = np.zeros(len(lengths))
    log_z[order] = _log_add(alpha[starts, 0] + beta[starts, 0], alpha[starts, 1] + beta[starts, 1])
    node_z = np.repeat(log_z, lengths)
    good = np.exp(alpha[:, 1] + beta[:, 1] - node_z)
    follows = np.ones(n, bool)
    follows[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(follows)
    pairs = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            pairs[i, j] = np.exp(alpha[at - 1, i] + pair[i, j] + (unary[at] if j else 0) + beta[at, j] - node_z[at]).sum()
    return good, log_z, pairs


@dataclass
class Field:
    weights: np.ndarray
    pair: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted mean marginal of each text's lines."""
        feats, sizes, lengths = [], [], []
        for t in texts:
            own, size = line_features(t)
            feats.append(with_neighbours(own))
            sizes.append(size)
            lengths.append(len(own))
        if not feats:
            return np.zeros(0)
        lengths = np.array(lengths)
        good, _, _ = marginals(np.vstack(feats) @ self.weights, self.pair, lengths)
        weight, at = np.concatenate(sizes), np.cumsum(lengths) - lengths
        return np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(self.raw(texts)) + self.shift, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(texts: list[str | None], labels: np.ndarray, penalty: float = 1e-3, rounds: int = 300) -> Field:
    """Train on documents whose lines take the document's label. Fewer than two
    labels: a field that says only what the share of label 1 says."""
    if len(set(labels.tolist())) < 2:
        share = 0.5 if not len(labels) else float(np.clip(labels.mean(), 0.01, 0.99))
        return Field(np.zeros(WIDTH), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    held = np.arange(len(texts)) % 5 == 0
    chains = [with_neighbours(line_features(t)[0]) for t, h in zip(texts, held, strict=True) if not h]
    lengths = np.array([len(c) for c in chains])
    x, y = np.vstack(chains), np.repeat(labels[~held], lengths).astype(float)
    per = np.repeat(1 / lengths, lengths)  # each document counts once, however long
    links = np.zeros((2, 2))
    for label, n in zip(labels[~held].tolist(), lengths.tolist(), strict=True):
        links[label, label] += n - 1
    theta = np.zeros(WIDTH + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    docs = len(chains)
    for k in range(1, rounds + 1):
        good, _, pairs = marginals(x @ theta[:WIDTH], theta[WIDTH:].reshape(2, 2), lengths)
        g = np.concatenate([x.T @ ((good - y) * per) / docs, ((pairs - links) / len(x)).ravel()]) + penalty * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    field = Field(theta[:WIDTH], theta[WIDTH:].reshape(2, 2))
    u, target = _logit(field.raw([t for t, h in zip(texts, held, strict=True) if h])), labels[held].astype(float)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps, lightly damped
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((p - target) * u).sum() + 0.1 * (a - 1), (p - target).sum() + 0.01 * b])
        hess = np.array([[(w * u * u).sum() + 0.1, (w * u).sum()], [(w * u).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -0.5, 0.5)
    field.slope, field.shift = float(max(a, 0.05)), float(b)
    return field


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", longest: int = LONGEST) -> Field:
    """Train on labelled rows of ``docs``, about ``per_label`` of either label and of
    at most ``longest`` characters, in one task; about a hundred numbers come back.
    A doc_id with both labels counts as 0."""
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(F.col(label_col)).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in marks.groupBy("label").count().collect()}  # two numbers
    draw = F.xxhash64(F.lit("sample"), F.col("doc_id")).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    rate = F.when(F.col("label") == 1, min(1.0, per_label / counts.get(1, 1))).otherwise(min(1.0, per_label / counts.get(0, 1)))
    marks = marks.withColumn("draw", draw).where(F.col("draw") < rate)
    # The marks are bounded by per_label, twice.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "doc_id").where(F.coalesce(F.char_length("text"), F.lit(0)) <= longest)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, known = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            known += batch.column(1).to_pylist()
        field = fit(texts, np.array(known, int))
        yield pa.RecordBatch.from_arrays([pa.array([field.weights.tolist()]), pa.array([field.pair.ravel().tolist()]), pa.array([field.slope]), pa.array([field.shift])], names=["weights", "pair", "slope", "shift"])

    one = rows.repartition(1).sortWithinPartitions("draw", F.coalesce("text", F.lit(""))).select("text", "label")
    found = one.mapInArrow(learn, "weights array<double>, pair array<double>, slope double, shift double").collect()
    field = Field(np.array(found[0].weights), np.array(found[0].pair).reshape(2, 2), found[0].slope, found[0].shift) if found else fit([], np.zeros(0, int))
    # The sample holds both labels alike; the shift brings back their true shares.
    if len(counts) == 2:
        share = min(1.0, per_label / counts[1]) / min(1.0, per_label / counts[0])
        field.shift -= float(np.log(share))
    return field


def score(docs: DataFrame, field: Field, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, the probability that a whole text is good.

    Null counts as empty; an empty text is one empty line and has a score like
    any. All rows stay, repeated ones too; an existing column of that name is
    replaced. An empty table stays empty.
    """
    docs = docs.drop(score_col)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # about a hundred numbers
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, text_col):
            found = shared.value.score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType(list(docs.schema.fields)).add(score_col, "double"))
