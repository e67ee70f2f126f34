import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docquarry import schemas
from docquarry.sources import files
from docquarry.streaming import ingest


def feed(path, forms):
    recent = {"form": forms, "accessionNumber": [f"0001-25-{i}" for i in range(len(forms))], "filingDate": ["2026-03-01"] * len(forms), "reportDate": [f"{2025 - i}-12-31" for i in range(len(forms))], "primaryDocument": [f"d{i}.htm" for i in range(len(forms))]}
    path.write_text(json.dumps({"company": "sea", "filings": {"recent": recent}}))
    return str(path)


def test_latest_reports_and_manifest(spark, tmp_path):
    feeds = files.submissions(spark, feed(tmp_path / "s.json", ["20-F/A", "20-F", "6-K", "20-F", "20-F"]))
    registry = schemas.companies(spark, [schemas.COMPANIES[0]])
    rows = files.manifest_of(feeds, registry).orderBy("fiscal_year").collect()
    assert [(r["key"], r["accession"]) for r in rows] == [("sea-2022", "0001-25-3"), ("sea-2024", "0001-25-1")]
    assert rows[0]["url"] == "https://www.sec.gov/Archives/edgar/data/1703399/0001253/d3.htm" and rows[0]["local_path"] == "data/raw/sea-2022_20-F.htm"
    with pytest.raises(ValueError, match="grab"):
        files.manifest_of(feeds, schemas.companies(spark))


def test_registry(spark):
    said = spark.createDataFrame([(" SE ",), ("grab",), ("Sea Limited",), (None,)], "c string")
    assert [r["short_name"] for r in schemas.find_company(said, "c", schemas.companies(spark)).collect()] == ["Sea", "Grab", None, None]
    assert spark.range(1).select(files.padded_cik(F.lit(1703399))).first()[0] == "0001703399"


def test_html_and_digests(spark, tmp_path):
    (tmp_path / "a.htm").write_bytes(b"x")
    row = files.html_files(spark, str(tmp_path / "*.htm")).first()
    assert row["sha256"] == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881" and row["bytes"] == 1
    said = spark.createDataFrame([("<ix:header/><p>a</p><script>x</script></body>",), ("<p>plain</p>",)], "h string")
    assert [r[0] for r in said.select(files.clean_html(F.col("h"))).collect()] == ["<ix:header/><p>a</p></body>", None]


HEAD = ",".join(schemas.QUESTION)


def test_questions(spark, tmp_path):
    row = 'q1,lookup,"What, ""now""?",5,Sea;Grab,2025; 2024,1|F-2;3,a b;c,TRUE\n'
    (tmp_path / "q.csv").write_text(f"﻿{HEAD}\n{row}", encoding="utf-8")
    q = files.read_questions(spark, str(tmp_path / "q.csv"))
    assert q.first()["question"] == 'What, "now"?'
    ev = [(r["n"], r["company"], r["year"], r["pages"], r["snippet"]) for r in files.evidence_of(q).orderBy("n").collect()]
    assert ev == [(0, "Sea", 2025, ["1", "F-2"], "a b"), (1, "Grab", 2024, ["3"], "c")]
    (tmp_path / "w.csv").write_bytes(f"{HEAD}\nq1,lookup,caf\xe9,,Sea,2025,1,x,FALSE\n".encode("cp1252"))
    assert files.read_questions(spark, str(tmp_path / "w.csv")).first()["question"] == "café"
    (tmp_path / "bad.csv").write_text("id,type\n")
    with pytest.raises(ValueError, match="header"):
        files.read_questions(spark, str(tmp_path / "bad.csv"))
    uneven = q.withColumn("gold_page", F.lit("1"))
    with pytest.raises(PySparkException, match="unequal length"):
        files.evidence_of(uneven).collect()


def test_blocks_traces_and_csv(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "é")], "doc_id long, block_seq int, text string")
    files.write_jsonl(rows.coalesce(1), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part*.json"))
    (tmp_path / "blocks").mkdir()
    (tmp_path / "blocks" / "sea-2025_blocks.jsonl").write_bytes(part.read_bytes())
    got = files.read_blocks(spark, str(tmp_path / "blocks" / "*_blocks.jsonl")).first()
    assert (got["filing"], got["text"]) == ("sea-2025", "é")
    trace = [{"event": "question", "question": "?"}, {"event": "step", "step": 1, "tool_calls": [{"name": "calculate", "input": {"expression": "1"}, "result": "1"}]}, {"event": "final", "answer": "a", "tool_calls": 1}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, trace)))
    read = {r["event"]: r for r in files.read_trace(spark, str(tmp_path / "t.jsonl")).collect()}
    assert read["step"]["calls"][0]["input"] == {"expression": "1"} and read["final"]["tool_calls_total"] == 1 and read["final"]["calls"] is None
    files.write_csv(spark.createDataFrame([(1, True)], "a int, b boolean").coalesce(1), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_text() == "a,b\n1,TRUE\n"


def test_index_guard(spark, tmp_path):
    rows = spark.createDataFrame([("c", "x", "fixed", [1.0])], "chunk_id string, text string, strategy string, vector array<float>")
    assert files.write_index(rows, str(tmp_path / "i"), "m1", body=450) == 1
    assert files.open_index(spark, str(tmp_path / "i"), "m1").count() == 1
    with pytest.raises(ValueError, match="made with 'm1'"):
        files.open_index(spark, str(tmp_path / "i"), "m2")


def test_streaming(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for k in range(2):
        spark.createDataFrame([(k, f"alpha beta{k} alpha")], "doc_id long, text string").write.mode("append").parquet(src)
        ingest.ingest(spark, src, out, cp).awaitTermination()
    rows = sorted((r["chunk_id"], r["term"], r["tf"]) for r in ingest.postings(spark, out).collect())
    assert rows == [(0, "alpha", 2), (0, "beta0", 1), (1, "alpha", 2), (1, "beta1", 1)]
