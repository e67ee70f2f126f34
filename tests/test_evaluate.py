import random

from pyspark.sql import functions as F

from docquarry.operators import evaluate as e

EV = "qid string, n int, company string, year int, pages array<string>"
HIT = "qid string, rank int, company string, year int, pages array<string>"


def test_sweep_matches_one_search_per_k(spark):
    rng = random.Random(1)
    ev = [(f"q{i}", n, rng.choice("AB"), 2025, rng.sample("12345", 2)) for i in range(30) for n in range(rng.randint(1, 3))]
    hits = [(f"q{i}", r, rng.choice("AB"), 2025, rng.sample("12345", 1)) for i in range(29) for r in range(1, 21)]
    got = {(r["qid"], r["k"]): r for r in e.retrieval_results(e.evidence_ranks(spark.createDataFrame(ev, EV), spark.createDataFrame(hits, HIT))).collect()}
    for q in {x[0] for x in ev}:
        mine = [x for x in ev if x[0] == q]
        for k in e.KS:
            seen = [h for h in hits if h[0] == q and h[1] <= k]
            match = lambda x, h: x[2:4] == h[2:4] and set(x[4]) & set(h[4])
            found = sum(any(match(x, h) for h in seen) for x in mine)
            first = min((h[1] for h in seen if any(match(x, h) for x in mine)), default=None)
            r = got[q, k]
            assert (r["strict_hit"], r["any_hit"], r["evidence_found"], r["first_hit_rank"]) == (found == len(mine), found > 0, f"{found}/{len(mine)}", first)


def test_hit_rates_have_totals(spark):
    rows = spark.createDataFrame([(5, "lookup", True, True), (5, "narrative", False, True), (3, "lookup", False, False)], "k int, type string, strict_hit boolean, any_hit boolean")
    assert sorted(tuple(r) for r in e.hit_rates(rows).select("k", "type", "strict", "any", "n").collect()) == [(3, "all", 0, 0, 1), (3, "lookup", 0, 0, 1), (5, "all", 1, 2, 2), (5, "lookup", 1, 1, 1), (5, "narrative", 0, 1, 1)]


def test_oracle_filter_is_a_product(spark):
    ev = spark.createDataFrame([("q", 0, "A", 2024, ["1"]), ("q", 1, "B", 2025, ["1"])], EV)
    rows = [("q", 1, 9.0, "C", 2024), ("q", 2, 7.0, "A", 2025), ("q", 3, 5.0, "B", 2025), ("q", 4, 7.0, "A", 2024)] + [("q", n, 8.0, "C", 2025) for n in range(10, 40)]
    scored = spark.createDataFrame(rows, "qid string, chunk_id int, score double, company string, year int")
    got = e.oracle_hits(scored, e.oracle_filters(ev), 2, [F.col("chunk_id").desc()])  # thirty better hits outside the filters take no rank
    assert sorted((r["rank"], r["chunk_id"], r["company"]) for r in got.collect()) == [(1, 4, "A"), (2, 2, "A")]


def test_citation_scores(spark):
    ev = spark.createDataFrame([("q", 0, "A", 2025, ["1", "2"]), ("q", 1, "A", 2025, ["9"]), ("r", 0, "B", 2025, ["1"])], EV)
    cited = spark.createDataFrame([("q", 0, "A", 2025, ["2", "5"]), ("q", 1, None, 2025, ["9"])], "qid string, c int, company string, year int, pages array<string>")
    hits = spark.createDataFrame([("q", 1, "A", 2025, ["5"])], HIT)
    got = {r["qid"]: (r["n_citations"], r["citations_correct"], r["gold_cited"], r["gold_total"], r["citations_retrieved"]) for r in e.citation_scores(cited, ev, hits).collect()}
    assert got == {"q": (2, 1, 1, 2, 1), "r": (0, 0, 0, 1, 0)}


def test_failures(spark):
    rows = [("q1", "comparison", "wrong", False, 0, 0), ("q2", "lookup", "partial", True, 0, 0), ("q3", "lookup", "abstained", True, 0, 0), ("q4", "lookup", "partial", False, 0, 0), ("q5", "lookup", "wrong", True, 2, 1), ("q6", "lookup", "wrong", True, 2, 2)]
    df = spark.createDataFrame(rows, "qid string, type string, grade string, found boolean, n int, r int")
    df = df.withColumn("category", e.failure_category(F.col("type"), F.col("grade"), F.col("found"), F.col("n"), F.col("r"))).withColumn("reason", F.lit("why"))
    assert [r["category"] for r in df.orderBy("qid").collect()] == ["multi-hop", "incomplete answer", "over-abstention", "wrong chunk", "hallucination", "bad table"]
    assert e.category_counts(df.limit(0)).count() == 6
    assert "## q5 (hallucination)" in e.report(df)


def test_retrieved_cells(spark):
    row = spark.createDataFrame([("a-2025 p.95|96; b-2025 p.88; a-2025 p.F-1",), ("",)], "c string")
    gold = F.array(F.struct(F.lit("a-2025").alias("filing"), F.array(F.lit("F-1")).alias("pages")), F.struct(F.lit("b-2025").alias("filing"), F.array(F.lit("88"), F.lit("1")).alias("pages")))
    assert [r[0] for r in row.select(e.gold_retrieved(gold, F.col("c"))).collect()] == [True, False]


def test_token_summary(spark):
    rng = random.Random(2)
    for n in (1, 2, 7, 40):
        sizes = [rng.randint(1, 30) for _ in range(n)]
        row = e.token_summary(spark.createDataFrame([("s", x) for x in sizes], "strategy string, n_tokens int")).first()
        at = sorted(sizes)
        assert (row["n"], row["median"], row["p95"], row["max"]) == (n, (at[(n - 1) // 2] + at[n // 2]) // 2, at[int(0.95 * (n - 1))], at[-1])


def test_summaries(spark):
    rows = spark.createDataFrame([("lookup", "correct", 2, 1, 10, 1, 0.5, True), ("lookup", "wrong", None, None, None, None, None, None)], "type string, grade string, steps int, tool_calls int, input_tokens int, output_tokens int, seconds double, hit_cap boolean")
    got = {r["type"]: (r["correct"], r["wrong"], r["n"]) for r in e.grade_summary(rows).collect()}
    assert got == {"lookup": (1, 1, 2), "all": (1, 1, 2)}
    cost = {r["type"]: (r["mean_steps"], r["capped"]) for r in e.cost_summary(rows).collect()}
    assert cost == {"lookup": (2.0, 1), "all": (2.0, 1)}


def test_gold_problems(spark):
    q = spark.createDataFrame([("q1", "comparison", ["=x"]), ("q2", "lookup", ["x"])], "qid string, type string, cells array<string>")
    ev = spark.createDataFrame([("q1", 0, "A", 2025, ["1"], "not there"), ("q2", 0, "Z", 2020, ["s4"], "x"), ("q2", 1, "A", 2025, ["1", "2"], "rose ... fast")], EV + ", snippet string")
    blocks = spark.createDataFrame([("A", 2025, "1", "Sales rose very fast.")], "company string, year int, page string, text string")
    got = {(r["qid"], r["severity"]) for r in e.gold_problems(q, ev, blocks).collect()}
    assert got == {("q1", "error"), ("q1", "warning"), ("q2", "error"), ("q2", "warning")}
