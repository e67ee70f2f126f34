"""Scoring of retrieval and answers as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.operators.search import top

CATEGORIES = ("wrong chunk", "bad table", "hallucination", "multi-hop", "over-abstention", "incomplete answer")
KS = (3, 5, 10, 20)
#: What a row of flagged_citation_scores may be.
FLAGS = ("cited", "gold", "hit")


def evidence_ranks(evidence: DataFrame, hits: DataFrame) -> DataFrame:
    """evidence (qid, n, company, year, pages) with the best rank of a hit on one of its pages, null if none."""
    h = hits.select(F.col("qid").alias("h_qid"), "rank", F.col("company").alias("h_company"), F.col("year").alias("h_year"), F.col("pages").alias("h_pages"))
    on = (F.col("qid") == F.col("h_qid")) & (F.col("company") == F.col("h_company")) & (F.col("year") == F.col("h_year")) & F.arrays_overlap("pages", "h_pages")
    return evidence.join(h, on, "left").groupBy("qid", "n").agg(F.min("rank").alias("rank"))


def retrieval_results(ranks: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """For each qid and k: strict (all evidence found), any, `m/n` found, first rank; one pass for all k."""
    spread = ranks.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    hit = F.coalesce(F.col("rank") <= F.col("k"), F.lit(False))
    found = F.sum(hit.cast("int"))
    return spread.groupBy("qid", "k").agg(
        (found == F.count(F.lit(1))).alias("strict_hit"),
        (found > 0).alias("any_hit"),
        F.concat(found.cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string")).alias("evidence_found"),
        F.min(F.when(hit, F.col("rank"))).alias("first_hit_rank"),
    )


def with_total(df: DataFrame, group: list[str], kind: str, *aggregates: Column) -> DataFrame:
    """Aggregates by group and kind, and by group with kind `all`."""
    keys = [F.col(c) for c in [*group, kind]]
    sets = [[F.col(c) for c in group] + [F.col(kind)], [F.col(c) for c in group]]
    out = df.groupingSets(sets, *keys).agg(F.grouping(kind).alias("_all"), *aggregates)
    return out.withColumn(kind, F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col(kind))).drop("_all")


def hit_rates(results: DataFrame) -> DataFrame:
    """Strict hits, any hits and questions by k and type, with a total for each k."""
    return with_total(results, ["k"], "type", F.sum(F.col("strict_hit").cast("int")).alias("strict"), F.sum(F.col("any_hit").cast("int")).alias("any"), F.count(F.lit(1)).alias("n"))


def oracle_filters(evidence: DataFrame) -> DataFrame:
    """Sorted distinct companies and years of each question's evidence."""
    return evidence.groupBy("qid").agg(F.array_sort(F.collect_set("company")).alias("companies"), F.array_sort(F.collect_set("year")).alias("years"))


def oracle_hits(scored: DataFrame, filters: DataFrame, k: int, ties: list[Column]) -> DataFrame:
    """Top k of all scored hits (qid, chunk_id, score, company, year) within each question's own filters, which come before
    the ranks; the filters are a product of lists, not of pairs."""
    kept = scored.join(filters, "qid").where(F.array_contains("companies", F.col("company")) & F.array_contains("years", F.col("year")))
    return top(kept.drop("companies", "years"), k, ties)


def citation_scores(cited: DataFrame, evidence: DataFrame, hits: DataFrame) -> DataFrame:
    """By qid: citations, those on a gold page, gold evidence cited, gold evidence, citations whose pages were retrieved.

    cited (qid, c, company, year, pages) has canonical companies; unknown ones match nothing.
    """
    rows = [df.select("qid", "company", "year", "pages", *(F.lit(flag == of).alias(flag) for flag in FLAGS)) for of, df in zip(FLAGS, (cited, evidence, hits), strict=True)]
    return flagged_citation_scores(rows[0].unionByName(rows[1]).unionByName(rows[2]))


def flagged_citation_scores(rows: DataFrame) -> DataFrame:
    """citation_scores of one table (qid, company, year, pages) whose flags say what a row is: cited, gold, hit, or several of them."""
    pages = [F.collect_list(F.when(F.col(flag), F.coalesce("pages", F.array().cast("array<string>")))).alias(flag) for flag in FLAGS]
    groups = rows.groupBy("qid", "company", "year").agg(*pages)
    known = F.col("company").isNotNull() & F.col("year").isNotNull()
    met = lambda a, b: F.when(known, F.size(F.filter(a, lambda x: F.exists(b, lambda y: F.arrays_overlap(x, y))))).otherwise(0)
    counts = {
        "gold_total": F.size("gold"), "n_citations": F.size("cited"), "citations_correct": met("cited", "gold"), "gold_cited": met("gold", "cited"), "citations_retrieved": met("cited", "hit"),
    }
    out = groups.groupBy("qid").agg(*(F.sum(x.cast("long")).alias(c) for c, x in counts.items()))
    return out.where("gold_total > 0 or n_citations > 0")


def grade_summary(answers: DataFrame) -> DataFrame:
    """Counts of each grade by type and in all."""
    counts = [F.sum((F.col("grade") == g).cast("int")).alias(g) for g in ("correct", "partial", "abstained", "wrong", "error")]
    return with_total(answers, [], "type", *counts, F.count(F.lit(1)).alias("n"))


def cost_summary(answers: DataFrame) -> DataFrame:
    """Means of the cost columns by type and in all; missing values do not count."""
    means = [F.avg(c).alias(f"mean_{c}") for c in ("steps", "tool_calls", "input_tokens", "output_tokens", "seconds")]
    return with_total(answers, [], "type", *means, F.sum(F.col("hit_cap").cast("int")).alias("capped"))


def failure_category(kind: Column, grade: Column, found: Column, n_citations: Column, citations_retrieved: Column) -> Column:
    """The suggested category; rules in order."""
    return (
        F.when((kind == "comparison") & ~found, "multi-hop")
        .when((grade == "partial") & found, "incomplete answer")
        .when((grade == "abstained") & found, "over-abstention")
        .when(~found, "wrong chunk")
        .when(citations_retrieved < n_citations, "hallucination")
        .otherwise("bad table")
    )


def retrieved_pages(cell: Column) -> Column:
    """array<struct(filing, pages)> of a cell such as `a-2025 p.95|96; b-2025 p.88`."""
    parts = F.filter(F.transform(F.split(cell, ";"), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, " p.", 1).alias("filing"), F.split(F.regexp_extract(p, r"^.*? p\.(.*)$", 1), r"\|").alias("pages")))


def gold_retrieved(evidence: Column, cell: Column) -> Column:
    """Whether each evidence (filing, pages) overlaps what the cell retrieved."""
    seen = retrieved_pages(cell)
    return F.forall(evidence, lambda e: F.exists(seen, lambda s: (s["filing"] == e["filing"]) & F.arrays_overlap(s["pages"], e["pages"])))


def category_counts(failures: DataFrame) -> DataFrame:
    """Counts by category, empty ones included."""
    all_ = failures.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return all_.join(failures.groupBy("category").agg(F.count(F.lit(1)).alias("n")), "category", "left").fillna(0, ["n"])


def report(failures: DataFrame) -> str:
    """Markdown of category counts and of the failed questions; for result sets of a question list."""
    counts = category_counts(failures).orderBy(F.col("n").desc(), "category").collect()
    lines = ["# Failures", "", "| category | n |", "|---|---|", *(f"| {r['category']} | {r['n']} |" for r in counts), ""]
    for r in failures.orderBy("qid").toLocalIterator():
        lines += [f"## {r['qid']} ({r['category']})", "", f"{r['grade']}: {r['reason']}", ""]
    return "\n".join(lines)


def token_summary(chunks: DataFrame) -> DataFrame:
    """count, median (cut to a whole number), p95 (by position, without interpolation) and max of n_tokens, by strategy."""
    sizes = chunks.groupBy("strategy", "n_tokens").agg(F.count(F.lit(1)).alias("times"))
    listed = sizes.groupBy("strategy").agg(F.sum("times").alias("n"), F.max("n_tokens").alias("max"), F.array_sort(F.collect_list(F.struct("n_tokens", "times"))).alias("sizes"))
    at = F.floor(0.95 * (F.col("n") - 1))
    return listed.select("strategy", "n", _at(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)).alias("median"), _at(at, at).alias("p95"), "max")


def _at(a: Column, b: Column) -> Column:
    """Mean, cut to a whole number, of the values at positions a and b of the counted, sorted sizes."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("x"), F.lit(None).cast("int").alias("y"))

    def step(s: Column, p: Column) -> Column:
        seen = s["seen"] + p["times"]
        value = p["n_tokens"].cast("int")
        return F.struct(seen.alias("seen"), F.coalesce(s["x"], F.when(a < seen, value)).alias("x"), F.coalesce(s["y"], F.when(b < seen, value)).alias("y"))

    return F.aggregate(F.col("sizes"), start, step, lambda s: F.floor((s["x"] + s["y"]) / 2).cast("int"))


def over_budget(chunks: DataFrame, limit: int = 512) -> DataFrame:
    return chunks.where(F.col("n_tokens") > limit)


def gold_problems(questions: DataFrame, evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """(qid, severity, message) of a gold set held against its blocks.

    questions (qid, type, cells array<string>), evidence (qid, n, company, year, pages,
    snippet), blocks (company, year, page, text).
    """
    from docquarry.functions.text import snippet_in

    row = lambda severity, message: [F.col("qid"), F.lit(severity).alias("severity"), message.alias("message")]
    out = questions.where(F.exists("cells", lambda c: c.rlike(r"^[=+\-@]"))).select(*row("error", F.lit("a cell starts like a formula")))
    filings = blocks.select("company", "year").distinct()
    out = out.unionByName(evidence.join(filings, ["company", "year"], "left_anti").select(*row("error", F.format_string("no filing of %s in %d", "company", F.col("year").cast("int")))))
    out = out.unionByName(evidence.where(F.exists("pages", lambda p: p.startswith("s"))).select(*row("error", F.lit("a page without a printed label"))))
    b = blocks.select(F.col("company").alias("b_company"), F.col("year").alias("b_year"), "page", F.col("text").alias("b_text"))
    matched = evidence.join(b, (F.col("company") == F.col("b_company")) & (F.col("year") == F.col("b_year")) & snippet_in(F.col("snippet"), F.col("b_text")), "left")
    found = matched.groupBy("qid", "n").agg(F.first("pages").alias("pages"), F.collect_set("page").alias("found"))
    out = out.unionByName(found.where(~F.arrays_overlap("pages", "found")).select(*row("error", F.lit("evidence is on none of its pages"))))
    lacking = F.array_except("pages", "found")
    out = out.unionByName(found.where(F.arrays_overlap("pages", "found") & (F.size(lacking) > 0)).select(*row("warning", F.concat(F.lit("snippet is not on p."), F.array_join(lacking, ", ")))))
    out = out.unionByName(evidence.where(F.size(F.split("snippet", r"\s+")) > 12).select(*row("warning", F.lit("snippet has more than 12 words"))))
    filings_of = evidence.groupBy("qid").agg(F.countDistinct("company", "year").alias("n"))
    few = questions.where("type = 'comparison'").join(filings_of, "qid", "left").where(F.coalesce("n", F.lit(0)) < 2)
    return out.unionByName(few.select(*row("warning", F.lit("a comparison of fewer than two filings"))))
