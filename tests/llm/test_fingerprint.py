"""Fingerprints digit by digit against a plain one-permutation MinHash."""

import random
import struct

import xxhash
from pyspark.sql import functions as F

from docquarry.llm import fingerprint


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(*values):
    """Spark's xxhash64: each value's hash is the next one's seed, and nulls are skipped."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v
        if raw is not None:
            seed = xxhash.xxh64(raw, seed=seed).intdigest()
    return signed(seed)


def plain(text):
    words = [w for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    h = [struct.pack("<q", hashed(w)) for w in words]
    shingles = [hashed(*h[k : k + 5]) for k in range(max(1, len(h) - 4))] if h else [42]
    bins = [None] * 256
    for s in sorted(shingles, reverse=True):
        bins[(s >> 56) + 128] = s
    out = ""
    for i, x in enumerate(bins):
        at = struct.pack("<i", i)
        asked = [bins[hashed(at, struct.pack("<i", a)) % 256] for a in range(1, 7)]
        x = next((y for y in [x, *asked] if y is not None), None)
        if x is None:
            x = min((hashed(at, struct.pack("<q", y >> 56)), y) for y in bins if y is not None)[1]
        out += f"{x & 255:02X}"
    return out


def test_digits(spark):
    rng = random.Random(20)
    texts = ["", None, "one", "one two three four", " \n\t ", "é ß 🙂 naïve Ω six"]
    texts += [" ".join(f"w{rng.randint(0, 500)}" for _ in range(n)) for n in (5, 6, 20, 100, 400, 3000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(rows.withColumn("fingerprint", F.lit("clash"))).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_likeness_is_without_bias(spark):
    """Over many pairs the mean of the estimates is the mean of the similarities."""
    rng = random.Random(22)
    rows, truth = [], 0.0
    for i in range(300):
        a = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
        b = a[: rng.randint(0, 200)]
        b += [f"x{rng.randint(0, 10**6)}" for _ in range(200 - len(b))]
        sets = [{tuple(t[k : k + 5]) for k in range(196)} for t in (a, b)]
        truth += len(sets[0] & sets[1]) / len(sets[0] | sets[1]) / 300
        rows.append((" ".join(a), " ".join(b)))
    pair = spark.createDataFrame(rows, "a string, b string")
    got = pair.select(F.avg(fingerprint.likeness(fingerprint.signature(F.col("a")), fingerprint.signature(F.col("b"))))).first()[0]
    assert abs(got - truth) < 0.01
