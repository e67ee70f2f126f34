"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every text becomes the set of its lower-cased words, word pairs and pairs with one word
skipped, hashed into 2**bits coordinates. Training follows the FTRL-proximal rule with a
learning rate for each coordinate, over coordinates that two training rows or more have; its
L1 term leaves most weights at exactly zero, so the model is the short list of the others,
with a size that `bits` bounds. Scoring looks the coordinates of whole batches up at once.

The regression ranks well with few labels but shrinks towards the commoner label, so the
bias is set by cross-validation: each of `folds` parts of the training rows is scored by a
model of the others, and the bias moves by the cut that has the best F1 of these scores among
cuts with a precision of `precision` or more (by nothing where there is none).

Learning takes `bound` rows of `volume` bytes of text in all, at most; a text that alone is
larger is not learned from. Scores cover all rows and whole texts.

Edge cases: a null or empty text has no coordinates and gets the score of the bias alone; a
very long text is scored whole, in one piece of its own; a null doc_id is scored like any
other; repeated rows and rows of equal ids get the scores of their own texts; columns of the
input stay, but for one named like the score's column, which is replaced; an empty table
gives an empty result. Without labelled rows the model is the bias PRIOR alone, so every
score is about 0.12 and counts as predicted 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm import textnum as tn
from docquarry.llm.common import in_training_fold, labelled_sample, table

_U = np.uint64
#: Bias of a model without training rows: what is unknown is not rejected.
PRIOR = -2.0


@dataclass(frozen=True)
class Params:
    bits: int = 22
    bound: int = 12_000  # labelled rows to learn from, at most
    volume: int = 64 << 20  # bytes of their texts, at most
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 7.0
    l2: float = 0.5
    threshold: float = 0.5
    folds: int = 4
    precision: float = 0.9  # of the cut that sets the bias, on rows left out


def coordinates(texts: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, coordinates, row of each) for runs of texts; repeated ones included."""
    mask = _U((1 << bits) - 1)
    for a, b, data, offsets in tn.pieces(texts):
        data = tn.LOWER[data]
        starts, ends, docs = tn.words(data, offsets, tn.ALNUM)
        h = tn.word_hashes(data, starts, ends)
        parts, rows = [h], [docs]
        for gap in (1, 2):
            if len(h) > gap:
                same = docs[:-gap] == docs[gap:]
                parts.append(tn.mix(h[:-gap] * _U(3 + 2 * gap) + h[gap:])[same])
                rows.append(docs[:-gap][same])
        yield a, b, np.concatenate(parts) & mask, np.concatenate(rows)


Model = tuple[np.ndarray, np.ndarray, float]


def examples(texts: pa.Array, bits: int) -> list[np.ndarray]:
    """The distinct coordinates of each text."""
    out: list[np.ndarray] = []
    for a, b, at, rows in coordinates(texts, bits):
        keys = np.unique((rows.astype(_U) << _U(32)) | at)
        cut = np.searchsorted(keys, np.arange(b - a + 1).astype(_U) << _U(32))
        low = (keys & _U(0xFFFFFFFF)).astype(np.int32)
        out += [low[cut[i] : cut[i + 1]] for i in range(b - a)]
    return out


def ftrl(rows: list[np.ndarray], labels: np.ndarray, size: int, p: Params) -> tuple[np.ndarray, float]:
    """Weights of coordinates 0 to size - 1, and the bias."""
    z, n = np.zeros(size), np.zeros(size)
    bias, bias_n = PRIOR, 0.0

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= p.l1, 0.0, -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for at, label in zip(rows, labels, strict=True):
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
            root = np.sqrt(ni)
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / p.alpha * w
            n[at] = ni + g * g
            bias_n += g * g
            bias -= p.alpha / (p.beta + np.sqrt(bias_n)) * g
    return weights(z, n), float(bias)


def best_cut(raw: np.ndarray, labels: np.ndarray, precision: float) -> float:
    """Midway below the last score of the cut with the best F1 that is precise enough; 0 without one."""
    order = np.argsort(-raw, kind="stable")
    raw, hits = raw[order], np.cumsum(labels[order])
    taken = np.arange(1, len(raw) + 1)
    f1 = 2 * hits / (taken + hits[-1]) if len(raw) and hits[-1] else np.zeros(len(raw))
    f1[hits < precision * taken] = 0
    f1[:-1][raw[:-1] == raw[1:]] = 0  # equal scores stay together
    if not f1.any():
        return 0.0
    k = int(f1.argmax())
    return float(raw[k] + raw[min(k + 1, len(raw) - 1)]) / 2


def train(rows: list[np.ndarray], labels: np.ndarray, p: Params) -> Model:
    """Coordinates with a weight, their weights, and the bias."""
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0), PRIOR
    kept = np.flatnonzero(np.bincount(np.concatenate(rows), minlength=1 << p.bits) > 1)
    number = np.full(1 << p.bits, -1, np.int32)
    number[kept] = np.arange(len(kept))
    rows = [x[x >= 0] for x in (number[r] for r in rows)]
    fold, raw = np.arange(len(rows)) % p.folds, np.zeros(len(rows))
    for k in range(p.folds):
        inside = np.flatnonzero(fold != k)
        w, bias = ftrl([rows[i] for i in inside], labels[inside], len(kept), p)
        for i in np.flatnonzero(fold == k):
            raw[i] = w[rows[i]].sum() + bias
    w, bias = ftrl(rows, labels, len(kept), p)
    at = np.flatnonzero(w)
    return kept[at], w[at], bias - best_cut(raw, labels, p.precision)


def score_texts(texts: pa.Array, dense: np.ndarray, bias: float, bits: int) -> np.ndarray:
    out = np.full(len(texts), bias)
    for a, b, at, rows in coordinates(texts, bits):
        live = dense[at] != 0
        keys = np.unique((rows[live].astype(_U) << _U(32)) | at[live])
        out[a:b] += np.bincount((keys >> _U(32)).astype(np.int64), dense[(keys & _U(0xFFFFFFFF)).astype(np.int64)], b - a)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), label: str = "toxic") -> Model:
    """Learn from a bounded sample of labelled rows, in one task on an executor; only the sparse weights reach the driver."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, known = [], []
        for batch in batches:
            rows += examples(batch.column(0), p.bits)
            known.append(batch.column(1).to_numpy(zero_copy_only=False))
        at, w, bias = train(rows, np.concatenate([*known, np.zeros(0, np.int32)]), p)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w, bias))], ["at", "w"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sample = labelled_sample(docs, labels, label, p.bound).select(F.col("doc_id").cast("long"), text.alias("text"), "label")
    # one order for all runs, so that reruns give the same model
    order = Window.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.octet_length("text") <= p.volume
    sized = sample.where(fits).withColumn("volume", F.sum(F.octet_length("text").cast("long")).over(order)).where(F.col("volume") <= p.volume)
    got = sized.select("text", "label").mapInArrow(tn.tidy(learn), "at long, w double").toArrow()
    at, w = got["at"].to_numpy(), got["w"].to_numpy()
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0), PRIOR
    live = at >= 0
    return at[live], w[live], float(w[~live][0])


def score(docs: DataFrame, model: Model, p: Params = Params(), column: str = "score") -> DataFrame:
    """docs with a column of scores between 0 and 1; a column of that name is replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most 2**bits weights
    docs = docs.drop(column)
    fields = [f.name for f in docs.schema.fields]
    schema = docs.withColumn(column, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        dense = np.zeros(1 << p.bits)
        dense[at] = w
        for batch in batches:
            got = score_texts(batch.column("text"), dense, bias, p.bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*fields, column])

    return docs.mapInArrow(tn.tidy(run), schema)


def query(spark: SparkSession, sf_dir: str, p: Params = Params()) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, p)
    return score(docs.select("doc_id", "text"), model, p).select(
        "doc_id",
        (~in_training_fold(F.col("doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= p.threshold).cast("int").alias("predicted"),
    )
