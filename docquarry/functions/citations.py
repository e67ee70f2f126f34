"""Page citations such as `[Name, FY2025, pp.12-14 and F-3]`, parsed and written as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar of citations.
BRACKET = r"\[([^\[\]]+)\]"
BODY = r"(?is)^\s*([^,]+?)\s*,\s*FY\s*(\d{4})\s*,\s*(pp?\.[^\n]+)$"
PREFIX = r"(?i)^pp?\.\s*"
RANGE = r"^(?:([A-Za-z])-)?(\d+)\s*[-–—]\s*(?:[A-Za-z]-)?(\d+)$"
PAGE = r"^(?:[A-Za-z]-)?\d+$"
WIDEST = 50


def parse_pages(text: Column) -> Column:
    """Page labels of a list with ranges; null if any part is malformed or there is none."""
    tokens = F.transform(F.split(text, r",|\band\b"), lambda t: F.regexp_replace(F.trim(t), PREFIX, ""))
    tokens = F.filter(tokens, lambda t: t != "")

    def pages(t: Column) -> Column:
        mark, a, b = (F.regexp_extract(t, RANGE, k) for k in (1, 2, 3))
        start, end = a.try_cast("long"), b.try_cast("long")
        labels = F.transform(F.sequence(start, end), lambda n: F.concat(F.when(mark != "", F.concat(mark, F.lit("-"))).otherwise(F.lit("")), n.cast("string")))
        span = F.when((start <= end) & (end <= start + WIDEST), labels)
        return F.when(t.rlike(RANGE), span).when(t.rlike(PAGE), F.array(t))

    found = F.transform(tokens, pages)
    return F.when((F.size(found) > 0) & ~F.exists(found, lambda p: p.isNull()), F.flatten(found))


def parse_citations(text: Column) -> Column:
    """array<struct(company, year, pages)> of the well-formed citations, in order; malformed ones are left out."""

    def one(body: Column) -> Column:
        part = lambda k: F.regexp_extract(body, BODY, k)
        return F.when(body.rlike(BODY), F.struct(F.trim(part(1)).alias("company"), part(2).cast("int").alias("year"), parse_pages(part(3)).alias("pages")))

    bodies = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BRACKET), F.lit(1))
    return F.filter(F.transform(bodies, one), lambda c: c.isNotNull() & c["pages"].isNotNull())


def citation(company: Column, year: Column, pages: Column) -> Column:
    return F.format_string("[%s, FY%d, p.%s]", company, year.cast("int"), F.array_join(pages, ", "))
