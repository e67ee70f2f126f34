"""The randomness battery on a table with planted keys, and beside paths and names that only look like keys."""

import random
import string

import numpy as np
import pyarrow as pa
import pytest

from docquarry.llm import secret_scan
from tests.llm.conftest import prose

SIGNS = string.ascii_letters + string.digits


def named(rng, text):
    words = [w.strip(".,\n") for w in text.split()]
    return rng.choice("_-/").join(rng.choice(words) for _ in range(rng.randint(4, 6))) + f"_{rng.randint(1, 2030)}"


@pytest.fixture(scope="module")
def planted():
    """Rows, and of each its planted string and whether that is a key; a third of the rows has none."""
    rng = random.Random(11)
    rows, said = [], {}
    for i in range(1500):
        text = prose(rng, rng.randint(40, 160))
        made = {0: "".join(rng.choice(SIGNS) for _ in range(40)), 1: "".join(rng.choice(SIGNS) for _ in range(24)), 2: named(rng, text)}.get(i % 6)
        if made:
            said[i] = made
            text = f"{text} {made} {prose(rng, 5)}"
        rows.append((i, text, "en", "s", len(text)))
    return rows, said


def test_planted_keys_are_found_and_names_are_not(run, write, planted):
    rows, said = planted
    found = {r["doc_id"]: [tuple(x.split(":")) for x in r["spans"].split(",") if x.startswith("random")] for r in run("op2_secret_scan", write(rows))}
    texts = {i: {rows[i][1][int(a) : int(b)] for _, a, b in spans} for i, spans in found.items()}
    share = lambda k: np.mean([said[i] in texts[i] for i in said if i % 6 == k])
    assert share(0) >= 0.95 and share(1) >= 0.8
    reported = sum(map(len, texts.values()))
    wrong = reported - sum(said.get(i) in t for i, t in texts.items() if i % 6 in (0, 1))
    assert wrong <= secret_scan.FDR * reported


def test_keys_are_redacted(spark, planted):
    rows, said = planted
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs, secret_scan.thresholds(docs)).collect()}
    assert np.mean([said[i] not in clean[i] for i in said if i % 6 == 0]) >= 0.95


def test_written_runs_cover_every_text():
    rng = random.Random(12)
    texts = [prose(rng, n) for n in (2, 30, 400, 3000)] + [None, "", "é" * 500]
    size = lambda t: sum(c.isalnum() and c.isascii() for c in t or "")
    n = {}
    for t in texts:
        for _, _, data, offsets, *_ in secret_scan._runs(pa.array([t], pa.string())):
            cls, bins = secret_scan._written(data, offsets)
            n[t] = len(cls)
            assert len(cls) == len(bins) and ((cls >= 0) & (cls < len(secret_scan.CLASSES))).all()
    assert all(abs(n[t] - size(t) / 40) <= 3 + size(t) / 200 for t in n)


def test_too_little_text_proves_nothing(spark):
    docs = spark.createDataFrame([(1, "one line with a1B2c3D4e5F6g7H8i9J0k1L2 in it")], "doc_id long, text string")
    assert secret_scan.thresholds(docs) == [secret_scan.BINS] * len(secret_scan.CLASSES)
