"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that become a blank, that vanish, and that have a plain form.
BLANKS = "  " + "".join(chr(c) for c in range(0x2002, 0x200B))
GONE = "​﻿­"
PLAIN = {"‑": "-", ";": ";"}
# What a table cell may hold to count as a value.
CURRENCY = r"(?:US\$|S\$|\$|RMB|€|£)"
VALUE = r"^\(?[-−]?" + CURRENCY + r"?[-−]?\d[\d,]*(?:\.\d+)?\)?%?\)?$"
DASHES = ("-", "--", "—", "–", "−")
SMALL_WORDS = ("a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "into", "nor", "of", "on", "or", "per", "the", "to", "vs", "with")
# Numbers, years and dates in answers.
NUMBER = r"\d[\d,]*(?:\.\d+)?"
YEAR = r"^(?:19|20)\d\d$"
DATE = r"[A-Z][a-z]+ \d{1,2},? (?:19|20)\d\d"


def normalize(text: Column) -> Column:
    """Plain blanks, hyphens and semicolons, no invisible characters, single spaces, trimmed."""
    plain = F.translate(text, BLANKS + "".join(PLAIN) + GONE, " " * len(BLANKS) + "".join(PLAIN.values()))
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def keyword_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def is_value(text: Column) -> Column:
    """Whether a cell is a number or a dash; bare years are not."""
    return ~text.rlike(YEAR) & (text.isin(*DASHES) | text.rlike(VALUE))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))


def title(text: Column) -> Column:
    """An all-capitals heading in title case with small words; other headings as they are; no final stops."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"\.+$", ""))
    words = F.filter(F.split(F.lower(bare), r"(?U)\s+"), lambda w: w != "")

    def capital(w: Column) -> Column:
        at = F.length(F.regexp_extract(w, "^[^a-z]*", 0))
        return F.concat(F.substring(w, F.lit(1), at), F.upper(F.substring(w, at + 1, F.lit(1))), F.substring(w, at + 2, F.length(w)))

    cased = F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*SMALL_WORDS), w).otherwise(capital(w))), " ")
    return F.when((F.upper(bare) == bare) & (F.lower(bare) != bare), cased).otherwise(bare)


def header(full_name: Column, year: Column, section: Column, limit: int = 60) -> Column:
    """The context line of a chunk, cut to `limit` word tokens."""
    return first_tokens(F.format_string("%s | FY%d annual report (20-F) | %s", full_name, year.cast("int"), section), limit)


def word_tokens(text: Column) -> Column:
    """Tokens of the default tokenizer: runs of characters that are not white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))


def count_tokens(text: Column, special: bool = False) -> Column:
    return F.size(word_tokens(text)) + (2 if special else 0)


def first_tokens(text: Column, limit: int) -> Column:
    """The text up to the end of its token number `limit`."""
    pieces = F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0))
    return F.when(F.size(pieces) <= limit, text).otherwise(F.array_join(F.slice(pieces, 1, limit), ""))


def numbers_in(text: Column) -> Column:
    """Distinct numbers of a text in plain form; fiscal years, dates and bare years are left out."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)FY\s*\d{4}", " "), DATE, " ")
    raw = F.regexp_extract_all(bare, F.lit(NUMBER), F.lit(0))

    def plain(x: Column) -> Column:
        joined = F.regexp_replace(x, ",", "")
        return F.when(joined.contains("."), F.regexp_replace(F.regexp_replace(joined, "0+$", ""), r"\.$", "")).otherwise(joined)

    pairs = F.transform(raw, lambda x: F.struct(x.alias("raw"), plain(x).alias("n")))
    kept = F.filter(pairs, lambda p: ~(p["n"].rlike(YEAR) & ~p["raw"].contains(",")))
    return F.array_distinct(F.transform(kept, lambda p: p["n"]))


def number_check(gold: Column, answer: Column) -> Column:
    """struct(found, total) of gold numbers in the answer, its brackets left out; null if gold has none."""
    wanted, said = numbers_in(gold), numbers_in(F.regexp_replace(answer, r"\[[^\]]*\]", " "))
    return F.when(F.size(wanted) > 0, F.struct(F.size(F.array_intersect(wanted, said)).alias("found"), F.size(wanted).alias("total")))


def needs_review(grade: Column, check: Column) -> Column:
    """Whether the grade and the numbers disagree."""
    odd = ((grade == "correct") & (check["found"] == 0)) | ((grade == "wrong") & (check["found"] == check["total"]))
    return F.coalesce(odd, F.lit(False))


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def snippet_in(snippet: Column, text: Column) -> Column:
    """Whether the parts of a snippet, between `...`, stand in the text in order; a snippet without parts does not."""
    parts = F.filter(F.transform(F.split(squash(snippet), r"\.\.\."), lambda p: F.trim(p)), lambda p: p != "")
    body = squash(text)

    def step(at: Column, part: Column) -> Column:
        found = F.locate_at(part, body, at) if hasattr(F, "locate_at") else F.call_function("locate", part, body, at)
        return F.when(at > 0, F.when(found > 0, found + F.length(part)).otherwise(F.lit(0))).otherwise(F.lit(0))

    return F.aggregate(parts, F.lit(1), step).between(1, 2**31 - 1) & (F.size(parts) > 0)


def parse_grade(reply: Column, grades: tuple[str, ...] = ("correct", "partial", "wrong", "abstained")) -> Column:
    """struct(grade, reason) from a grader's reply that holds a JSON object; grade `error` if unusable."""
    found = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "grade string, reason string")
    grade = F.lower(F.trim(found["grade"]))
    usable = F.coalesce(grade.isin(*grades), F.lit(False))
    reason = F.when(usable, F.trim(F.coalesce(found["reason"], F.lit("")))).otherwise(F.concat(F.lit("unusable grader reply: "), F.substring(F.coalesce(reply, F.lit("")), 1, 80)))
    return F.struct(F.when(usable, grade).otherwise(F.lit("error")).alias("grade"), reason.alias("reason"))


def true_false(value: Column) -> Column:
    return F.upper(value.cast("string"))
