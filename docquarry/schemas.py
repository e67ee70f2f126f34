"""Schemas of the tables that pass between stages, and the registry of companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMPANY = "key string, short_name string, full_name string, cik int, ticker string"
MANIFEST = "key string, company string, cik int, fiscal_year int, form string, accession string, filing_date string, report_date string, primary_document string, url string, local_path string, bytes long, sha256 string"
BLOCK = "doc_id long, block_seq int, page_seq int, page string, kind string, level int, is_bold boolean, item string, subitem string, section string, text string, caption string, header array<string>, rows array<string>"
CHUNK = "chunk_id string, text string, filing string, company string, year int, page string, pages array<string>, page_seq int, section string, item string, is_table boolean, strategy string, n_tokens int"
QUESTION = ("id", "type", "question", "gold_answer", "gold_company", "gold_year", "gold_page", "evidence", "verified")
TRACE = "event string, question string, model string, max_steps int, search_mode string, step int, forced boolean, stop_reason string, text string, seconds double, usage struct<input_tokens: long, output_tokens: long>, answer string, steps int, hit_cap boolean"
TOOL_CALLS = "array<struct<name: string, input: map<string, string>, result: string>>"

#: The registry: key, short name, full name, number, ticker. Others can be passed wherever it is used.
COMPANIES = [("sea", "Sea", "Sea Limited", 1703399, "SE"), ("grab", "Grab", "Grab Holdings Limited", 1855612, "GRAB")]


def companies(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or COMPANIES, COMPANY)


def find_company(names: DataFrame, column: str, registry: DataFrame) -> DataFrame:
    """names with short_name of the company whose key, short name or ticker it is, without regard to case; null if unknown."""
    said = registry.select("short_name", F.explode(F.array_distinct(F.array(F.lower("key"), F.lower("short_name"), F.lower("ticker")))).alias("_said"))
    return names.join(F.broadcast(said), F.lower(F.trim(F.col(column))) == F.col("_said"), "left").drop("_said")  # the registry is a list in code


def filing_key(company: Column, year: Column) -> Column:
    return F.concat_ws("-", company, year.cast("string"))


def available_years(filings: DataFrame) -> DataFrame:
    return filings.groupBy("company").agg(F.array_sort(F.collect_set("year")).alias("years"))
