"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole Arrow batches at once. Training takes a bounded sample of
labelled rows in one task on an executor: values are cut at quantiles to at most BINS bins,
and each level of a tree is split by sums of gradients in histograms. The trees are complete
binary trees flattened into three arrays (statistic, threshold, leaf value), so scoring is a
few numpy steps for a batch: go down one level of all trees' arrays at a time.

Edge cases: a null or empty text has all statistics 0 and is scored like any other; without
labelled rows every score is 0.5; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import textnum as tn
from docquarry.llm.common import in_training_fold, labelled_sample, table

_U = np.uint64
NAMES = (
    "words", "chars", "mean_word", "lines", "words_a_line", "upper", "digits", "symbols", "marks", "stops", "non_ascii",
    "distinct", "repeated_runs", "same_as_before", "repeated_lines", "one_letter", "long_words", "most_common",
)


@dataclass(frozen=True)
class Params:
    bound: int = 12_000  # labelled rows to learn from, at most
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.1
    l2: float = 1.0
    least: float = 3.0  # second derivatives in a leaf, at least
    threshold: float = 0.3


def _class(*chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(b"".join(chars))] = True
    return out


_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
_SYMBOL, _MARK, _STOP = _class(b"#*$%&|<>@^~_=+{}[]\\/"), _class(b"!?"), _class(b".,;:")
_HIGH, _LINE = _class(bytes(range(128, 256))), _class(b"\n")


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of NAMES for each text."""
    out = np.zeros((len(texts), len(NAMES)))
    for a, b, data, offsets in tn.pieces(texts):
        n = b - a
        starts, ends, docs = tn.words(data, offsets)
        size = np.diff(offsets).astype(float)

        def per_text(flags: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(flags)))
            return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

        words = tn.counts(docs, n).astype(float)
        one, chars = np.maximum(words, 1), np.maximum(size, 1)
        h = tn.word_hashes(data, starts, ends)
        length = ends - starts
        column = {
            "words": words,
            "chars": size,
            "mean_word": np.bincount(docs, length, n) / one,
            "upper": per_text(_UPPER[data]) / chars,
            "digits": per_text(_DIGIT[data]) / chars,
            "symbols": per_text(_SYMBOL[data]) / chars,
            "marks": per_text(_MARK[data]) / one,
            "stops": per_text(_STOP[data]) / one,
            "non_ascii": per_text(_HIGH[data]) / chars,
            "one_letter": np.bincount(docs, length == 1, n) / one,
            "long_words": np.bincount(docs, length > 15, n) / one,
        }
        owner, times = _groups(docs, h)
        column["distinct"] = tn.counts(owner, n) / one
        most = np.zeros(n)
        np.maximum.at(most, owner, times)
        column["most_common"] = most / one
        run, rows = tn.shingles(h, docs, 3)
        owner, times = _groups(rows, run)
        column["repeated_runs"] = np.bincount(owner, np.where(times > 1, times, 0), n) / one
        same = (h[1:] == h[:-1]) & (docs[1:] == docs[:-1])
        column["same_as_before"] = np.bincount(docs[1:], same, n) / one
        line = ~_LINE
        ls, le, ld = tn.words(data, offsets, line)
        lines = tn.counts(ld, n).astype(float)
        owner, _ = _groups(ld, tn.word_hashes(data, ls, le))
        column["lines"] = lines
        column["words_a_line"] = words / np.maximum(lines, 1)
        column["repeated_lines"] = (lines - tn.counts(owner, n)) / np.maximum(lines, 1)
        out[a:b] = np.stack([column[c] for c in NAMES], 1)
    return out


def _groups(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and the count of each distinct (text, hash)."""
    if not len(docs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # 40 bits of the hash beside the text's number within the piece: one sort of plain integers
    keys = np.sort((docs.astype(_U) << _U(40)) | (hashes >> _U(24)))
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[first] >> _U(40)).astype(np.int64), np.diff(np.append(first, len(keys)))


@dataclass
class Trees:
    """Node k of a tree has children 2k + 1 (value at most the threshold) and 2k + 2; leaves follow the inner nodes."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        trees, inner = self.feature.shape
        if not trees or not len(x):
            return out
        row = np.arange(len(x))[:, None]
        tree = np.arange(trees)[None, :]
        for at in range(0, len(x), 4096):
            some, r = x[at : at + 4096], row[: min(4096, len(x) - at)]
            node = np.zeros((len(some), trees), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (some[r, self.feature[tree, node]] > self.cut[tree, node])
            out[at : at + 4096] += self.leaf[tree, node - inner].sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def train(x: np.ndarray, y: np.ndarray, p: Params) -> Trees:
    inner, leaves = (1 << p.depth) - 1, 1 << p.depth
    none = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(x):
        return none
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, p.bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = [np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]  # bin <= k is x <= cut k
    raw = np.full(len(x), base)
    features, thresholds, values = [], [], []
    for _ in range(p.trees):
        score = 1 / (1 + np.exp(-raw))
        g, h = score - y, score * (1 - score)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), np.int64)
        for level in range(p.depth):
            first, n = (1 << level) - 1, 1 << level
            best, bf, bk = np.full(n, 1e-6), np.zeros(n, np.int64), np.full(n, -1)
            local = node - first
            G, H = np.bincount(local, g, n), np.bincount(local, h, n)
            for f, b in enumerate(binned):
                if not len(cuts[f]):
                    continue
                at = local * p.bins + b
                gl = np.cumsum(np.bincount(at, g, n * p.bins).reshape(n, p.bins), 1)[:, : len(cuts[f])]
                hl = np.cumsum(np.bincount(at, h, n * p.bins).reshape(n, p.bins), 1)[:, : len(cuts[f])]
                gr, hr = G[:, None] - gl, H[:, None] - hl
                gain = gl**2 / (hl + p.l2) + gr**2 / (hr + p.l2) - (G**2 / (H + p.l2))[:, None]
                gain[(hl < p.least) | (hr < p.least)] = -1
                k = gain.argmax(1)
                top = gain[np.arange(n), k]
                better = top > best
                best[better], bf[better], bk[better] = top[better], f, k[better]
            for i in np.flatnonzero(bk >= 0):
                feature[first + i], cut[first + i] = bf[i], cuts[bf[i]][bk[i]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        local = node - inner
        leaf = -p.rate * np.bincount(local, g, leaves) / (np.bincount(local, h, leaves) + p.l2)
        raw += leaf[local]
        features.append(feature)
        thresholds.append(cut)
        values.append(leaf)
    return Trees(base, np.array(features), np.array(thresholds), np.array(values))


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), label: str = "quality") -> Trees:
    """Trees from a bounded sample, grown in one task on an executor; they come back as flat arrays."""
    inner = (1 << p.depth) - 1
    fields = "base double, feature array<long>, cut array<double>, leaf array<double>"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], ["doc_id", "label", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(d, y, v) for batch in batches for d, y, v in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        rows.sort(key=lambda r: (r[0] is None, r[0], r[2]))
        t = train(np.array([r[2] for r in rows]), np.array([r[1] for r in rows], float), p)
        yield pa.RecordBatch.from_pylist([{"base": t.base, "feature": t.feature.ravel().tolist(), "cut": t.cut.ravel().tolist(), "leaf": t.leaf.ravel().tolist()}])

    sample = labelled_sample(docs, labels, label, p.bound).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "label")
    got = sample.mapInArrow(tn.tidy(measure), "doc_id long, label int, x array<double>").repartition(1).mapInArrow(tn.tidy(learn), fields).first()
    if got is None:
        return train(np.zeros((0, len(NAMES))), np.zeros(0), p)
    return Trees(got["base"], np.array(got["feature"], np.int64).reshape(-1, inner), np.array(got["cut"]).reshape(-1, inner), np.array(got["leaf"]).reshape(-1, inner + 1))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # trees * 2**depth numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(statistics(batch.column(1))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tn.tidy(run), "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str, p: Params = Params()) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), p)
    return score(docs, model).select("doc_id", (~in_training_fold(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))
