"""Secret scans: fixed patterns and a battery of randomness tests over candidate strings.

Fixed kinds, leftmost and without overlap within a kind, in code points, end exclusive:
  assign  name, sign and value as in `token = "..."`, the value of 12 characters or more
  access  `AKIA` and capitals or digits, 18 characters or more
  hex     lower-case hexadecimal digits, 16 or more
The battery adds kind `random`. Its candidates are runs of 20 or more letters, digits and
`+/_-` that have both a letter and a digit. The narrowest alphabet that holds a run is its
encoding, and against uniform draws from that alphabet three tests are made: chi-squared of
the character counts, runs about the middle of the alphabet, and lag-one serial correlation
of the ranks. Fisher's method combines their p-values to a score between 0 and 1, which is
uniform for random strings and near 0 for written ones.

False discoveries: written text gives the null distribution, in classes of length. The
ASCII letters and digits of every text are cut into consecutive runs, turn by turn of the
lengths of TAPE, from end to end; what stands between words becomes one `_`, `-` or `/` in
the runs that stand for paths and names, and goes in those that stand for joined words; the
last two characters become digits, as candidates have some. A candidate's p-value is the
share of these runs with a score as high, and Benjamini-Hochberg within each class of length
finds the lowest score that keeps the expected share of text among the reported runs at
`fdr`. A class with fewer than 1 / fdr - 1 such runs (19 by default; so short tables, and
texts in other scripts) has no proof of randomness and reports none; fixed kinds are found
all the same.

The first pass counts scores (histograms of fixed size are all that leaves it), the second
scans with the thresholds found. Nothing is shuffled but the counts.

Edge cases: null text counts as empty; a text without spans has the empty string; a
candidate that overlaps a fixed span is left to that span; repeated rows give repeated
results; an empty table gives an empty result; other columns stay, whatever their names. A
very long text is read whole, in one piece of its own.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import textnum as tn
from docquarry.llm.common import table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
SHORTEST = {"assign": 12, "access": 18, "hex": 16, "random": 20}
#: First lengths of the length classes.
CLASSES = (20, 24, 28, 32, 40, 64)
BINS = 400
FDR = 0.05
#: Lengths that written text is cut to in turn; every second one loses what stands between words.
TAPE = (20, 25, 24, 30, 28, 35, 32, 40, 40, 50, 64, 80)
_EDGES = np.concatenate(([0], np.cumsum(TAPE)))

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings from the narrowest on; a run takes the first that holds all its characters.
ALPHABETS = tuple(
    dict.fromkeys(
        (
            _DIGITS,
            _DIGITS + "abcdef",
            _DIGITS + "ABCDEF",
            _LOWER,
            _UPPER,
            _UPPER + "234567",
            _DIGITS + _LOWER,
            _DIGITS + _UPPER,
            _UPPER + _LOWER,
            _UPPER + _LOWER + _DIGITS,
            _UPPER + _LOWER + _DIGITS + "+/",
            _UPPER + _LOWER + _DIGITS + "-_",
            _UPPER + _LOWER + _DIGITS + "+/-_",
        )
    )
)
_RANK = np.full((len(ALPHABETS), 256), -1, np.int64)
for _i, _a in enumerate(ALPHABETS):
    _RANK[_i, list(_a.encode())] = np.arange(len(_a))
_SIZE = np.array([len(a) for a in ALPHABETS])
_WIDEST = int(_SIZE.max())


def _normal_tail(z: np.ndarray) -> np.ndarray:
    """P(Z > z) of a standard normal, by the complementary error function's rational approximation."""
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x)
    return np.where(z >= 0, tail, 1 - tail)


def randomness(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fisher's combination of the three tests for each run data[start:end]; 0 to 1, high for random runs."""
    k = len(starts)
    if not k:
        return np.zeros(0)
    n = ends - starts
    owner = np.repeat(np.arange(k), n)
    chars = data[np.arange(len(owner)) + np.repeat(starts - np.concatenate(([0], np.cumsum(n)[:-1])), n)]
    encoding, open_ = np.full(k, len(ALPHABETS) - 1), np.ones(k, bool)
    for i in range(len(ALPHABETS)):
        fits = np.bincount(owner, _RANK[i][chars] < 0, k) == 0
        encoding[open_ & fits] = i
        open_ &= ~fits
    m = _SIZE[encoding].astype(float)
    rank = _RANK[encoding[owner], chars]
    cells = np.bincount(owner * _WIDEST + rank, minlength=k * _WIDEST).reshape(k, _WIDEST)
    chi = np.einsum("ij,ij->i", cells, cells) * m / n - n
    p_chi = _normal_tail((chi - (m - 1)) / np.sqrt(2 * (m - 1) * np.maximum(n - 1, 1) / n))
    upper = rank * 2 >= m[owner]
    mate = owner[:-1] == owner[1:]
    runs = 1 + np.bincount(owner[:-1][mate], upper[:-1][mate] != upper[1:][mate], k)
    p_runs = 2 * _normal_tail(np.abs(runs - 1 - (n - 1) / 2) / np.sqrt(np.maximum(n - 1, 1) / 4))
    u = rank - (m[owner] - 1) / 2
    serial = np.bincount(owner[:-1][mate], u[:-1][mate] * u[1:][mate], k)
    p_serial = 2 * _normal_tail(np.abs(serial) / (np.sqrt(np.maximum(n - 1, 1)) * (m * m - 1) / 12))
    x = -(np.log(np.clip(p_chi, 1e-300, 1)) + np.log(np.clip(p_runs, 1e-300, 1)) + np.log(np.clip(p_serial, 1e-300, 1)))
    return np.exp(-x) * (1 + x + x * x / 2)


def _runs(texts: pa.Array) -> Iterator[tuple]:
    """For pieces of a batch: first and end row, bytes, offsets, and the candidates' starts, ends, rows, classes and bins."""
    for a, b, data, offsets in tn.pieces(texts):
        starts, ends, docs = tn.words(data, offsets, _TOKEN)
        long_ = ends - starts >= SHORTEST["random"]
        starts, ends, docs = starts[long_], ends[long_], docs[long_]
        digits = np.add.reduceat(np.append((data >= 48) & (data < 58), False).astype(np.int64), _pairs(starts, ends))[::2] if len(starts) else starts
        letters = np.add.reduceat(np.append(_LETTER[data], False).astype(np.int64), _pairs(starts, ends))[::2] if len(starts) else starts
        live = (digits > 0) & (letters > 0)
        starts, ends, docs = starts[live], ends[live], docs[live]
        cls = np.searchsorted(CLASSES, ends - starts, "right") - 1
        yield a, b, data, offsets, starts, ends, docs, cls, _bins(randomness(data, starts, ends))


def _pairs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.stack((starts, ends), 1).ravel()


def _bins(scores: np.ndarray) -> np.ndarray:
    return np.minimum((scores * BINS).astype(np.int64), BINS - 1)


def _written(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes and bins of the runs that stand for written text; each text is cut from end to end."""
    inside = _LETTER[data] | ((data >= 48) & (data < 58))
    kept = inside.copy()
    kept[1:] |= inside[:-1]  # the first of what stands between two words
    before = np.concatenate(([0], np.cumsum(kept)))[offsets]
    chars, gap, n = data[kept], ~inside[kept], np.diff(before)
    # a text lies on the endless tape from a place that its size fixes, so that short texts meet all lengths
    turn, span = len(TAPE), int(_EDGES[-1])
    at = (tn.mix(n.astype(np.uint64)) % np.uint64(span)).astype(np.int64)
    first = np.searchsorted(_EDGES, at)
    rounds, rest = np.divmod(at + n, span)
    count = np.maximum(rounds * turn + np.searchsorted(_EDGES, rest, "right") - 1 - first, 0)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    starts = before[doc] + k // turn * span + _EDGES[k % turn] - at[doc]
    size = np.array(TAPE)[k % turn]
    owner = np.repeat(np.arange(len(k)), size)
    place = np.arange(len(owner)) + np.repeat(starts - np.cumsum(size) + size, size)
    joined = k % 2 == 1
    stay = ~(gap[place] & joined[owner])
    owner, place = owner[stay], place[stay]
    made = np.where(gap[place], np.frombuffer(b"_-/", np.uint8)[owner % 3], chars[place])
    size = np.bincount(owner, minlength=len(k))
    ends = np.cumsum(size)
    live = size >= SHORTEST["random"]
    last = ends[live]
    number = tn.mix(starts[live].astype(np.uint64))
    made[last - 1], made[last - 2] = number % np.uint64(10) + np.uint64(48), number // np.uint64(10) % np.uint64(10) + np.uint64(48)
    return np.searchsorted(CLASSES, size[live], "right") - 1, _bins(randomness(made, last - size[live], last))


def thresholds(docs: DataFrame, fdr: float = FDR) -> list[int]:
    """The lowest score bin reported, by class of length; BINS where none may be."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(CLASSES) * BINS
        total = np.zeros((2, size), np.int64)  # candidates, written runs
        for batch in batches:
            for _, _, data, offsets, _, _, _, cls, bins in _runs(batch.column(0)):
                total[0] += np.bincount(cls * BINS + bins, minlength=size)
                cls, bins = _written(data, offsets)
                total[1] += np.bincount(cls * BINS + bins, minlength=size)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tn.tidy(count), "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    table_ = np.zeros(2 * len(CLASSES) * BINS)
    for row in counted.collect():  # 2 * classes * bins rows at most
        table_[row["at"]] = row["n"]
    candidates, written = table_.reshape(2, len(CLASSES), BINS)
    return [lowest_bin(candidates[c], written[c], fdr) for c in range(len(CLASSES))]


def lowest_bin(candidates: np.ndarray, written: np.ndarray, fdr: float) -> int:
    """Benjamini-Hochberg over binned scores: p of a bin is the share of written runs from it on, with one run added."""
    found = np.cumsum(candidates[::-1])[::-1]
    p = (1 + np.cumsum(written[::-1])[::-1]) / (1 + written.sum())
    good = np.flatnonzero((found > 0) & (p * found[0] <= fdr * found))
    return int(good[0]) if len(good) else len(candidates)


def spans_of(texts: pa.Array, limits: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """For each text its spans (start, number of the kind, end) in code points, in order."""
    limit = np.array(limits)
    for a, b, data, offsets, starts, ends, docs, cls, bins in _runs(texts):
        take = bins >= limit[cls]
        extra: dict[int, list[tuple[int, int]]] = {}
        for s, e, d in zip(starts[take].tolist(), ends[take].tolist(), docs[take].tolist(), strict=True):
            extra.setdefault(d, []).append((s, e))
        hs, he, hd = tn.words(data, offsets, _HEX)
        long_ = he - hs >= SHORTEST["hex"]
        for s, e, d in zip(hs[long_].tolist(), he[long_].tolist(), hd[long_].tolist(), strict=True):
            extra.setdefault(d, []).append((s, -e))  # a negative end marks hex
        for i in range(b - a):
            o = int(offsets[i])
            raw = data[o : offsets[i + 1]].tobytes()
            fixed = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw.lower()) if m.end(1) - m.start(1) >= SHORTEST["assign"]]
            if b"AKIA" in raw:
                fixed += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= SHORTEST["access"]]
            more = extra.get(i, ())
            fixed += [(s - o, 2, -e - o) for s, e in more if e < 0]
            fixed += [(s - o, 3, e - o) for s, e in more if e >= 0 and all(e - o <= x or s - o >= z for x, _, z in fixed)]
            if fixed and not raw.isascii():
                fixed = [(len(raw[:s].decode()), k, len(raw[:e].decode())) for s, k, e in fixed]
            yield sorted(fixed)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, limits: list[int]) -> DataFrame:
    """doc_id with the counts of the fixed kinds, the number of random runs, the digest of the fixed spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(spans_of(batch.column(1), limits))
            base = [[x for x in f if x[1] < 3] for f in found]
            columns = [pa.array([sum(x[1] == k for x in f) for f in found], pa.int64()) for k in range(4)]
            columns.append(pa.array([hashlib.sha256(_joined(f).encode()).hexdigest() for f in base], pa.string()))
            columns.append(pa.array([_joined(f) for f in found], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tn.tidy(run), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact(docs: DataFrame, limits: list[int], mark: str = "[secret]") -> DataFrame:
    """docs with each span (overlapping ones merged) replaced in text, and n_chars, where there is one, counted anew."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, columns = batch.column(at).to_pylist(), list(batch.columns)
            for i, spans in enumerate(spans_of(batch.column(at), limits)):
                if spans:
                    out, end = [], 0
                    for s, _, e in spans:
                        if s >= end:
                            out += [texts[i][end:s], mark]
                        end = max(end, e)
                    texts[i] = "".join([*out, texts[i][end:]])
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([len(t) if t is not None else n for t, n in zip(texts, columns[k].to_pylist(), strict=True)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(tn.tidy(run), docs.schema)


def query(spark: SparkSession, sf_dir: str, fdr: float = FDR) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, thresholds(docs, fdr))
