"""The pipeline's stages against what they should do to planted rows."""

import re
from collections import Counter

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, usual):
    d, rows, labels = usual
    docs = spark.read.parquet(f"{d}/documents.parquet")
    toxic = {i for i, _, t in labels if t}
    out, kept = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, d).cache()
        out[name] = kept
        if name != "packing":
            assert kept.columns == docs.columns
    ids = {name: Counter(r["doc_id"] for r in df.select("doc_id").collect()) for name, df in out.items()}
    assert {r[0] for r in rows} - set(ids["toxicity"]) <= toxic and len(toxic & set(ids["toxicity"])) <= 0.4 * len(toxic)
    assert all(i - i % 10 in ids["near_join"] for i in range(0, 120, 10)) and not any(i % 10 == 1 for i in ids["near_join"])
    assert ids["secret_scan"] == ids["near_join"]
    texts = {r["doc_id"]: r["text"] for r in out["secret_scan"].collect()}
    assert all("[secret]" in texts[i] and "AKIA" not in texts[i] for i in texts if i % 10 == 6)
    words = Counter()
    for r in out["mixing"].collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    total = sum(len(WORD.findall(t)) for t in texts.values())
    assert abs(sum(words.values()) - 1.5 * total) <= 5 and all(n <= 2 * len(WORD.findall(texts[i])) for i, n in words.items())
    assert set(ids["packing"]) == set(words)


def test_run_equals_the_stages(spark, usual):
    d, *_ = usual
    got = corpus_pipeline.run(spark, d)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    again = corpus_pipeline.run(spark, d)
    mine = lambda df: Counter((r["doc_id"], r["doc_tokens"]) for r in df.where("start = 0").collect())
    assert mine(got) == mine(again)


def test_empty_and_odd(spark, empty, odd):
    assert corpus_pipeline.run(spark, empty).count() == 0
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, odd[0])
    assert kept.count() > 0
