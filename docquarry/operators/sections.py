"""Page labels, lead-ins and sections of raw blocks, as window plans over each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from docquarry.functions.text import title

# What page labels, items, sub-items and lead-ins look like.
LABEL = r"^(?:\d{1,3}|F-\d{1,3}|[ivxlc]{1,6})$"
ITEM = r"(?i)^ITEM\s*(\d{1,2})([A-K]?)\s*\.\s*(.*)$"
SUBITEM = r"^([A-H])\.\s*([A-Z].{2,90})$"
LEAD_IN = r"(?i)following tables?|tables? below"
FRONT_MATTER, FINANCIALS = "Front matter", "Item 18. Financial Statements"
HEADING_CHARS, RUNNING_PAGES, LEAD_IN_CHARS = 120, 5, 400


def _along(*part: str) -> WindowSpec:
    return Window.partitionBy("doc_id", *part).orderBy("block_seq")


def _so_far(*part: str) -> WindowSpec:
    return _along(*part).rowsBetween(Window.unboundedPreceding, 0)


def _earlier(*part: str) -> WindowSpec:
    return _along(*part).rowsBetween(Window.unboundedPreceding, -1)


def with_labels(blocks: DataFrame) -> DataFrame:
    """Contents links go; the last block of a page but tables is its label, and goes, if it looks like one; else `s` and its number."""
    rows = blocks.where(~((F.col("kind") == "text") & (F.lower("text") == "table of contents")))
    page = Window.partitionBy("doc_id", "page_seq")
    last = F.max(F.when(F.col("kind") != "table", F.col("block_seq"))).over(page)
    bare = F.replace(F.col("text"), F.lit(" "), F.lit(""))
    rows = rows.withColumn("is_label", (F.col("block_seq") == last) & (F.col("kind") != "table") & bare.rlike(LABEL))
    label = F.max(F.when(F.col("is_label"), bare)).over(page)
    rows = rows.withColumn("page", F.coalesce(label, F.concat(F.lit("s"), F.col("page_seq").cast("string"))))
    return rows.where(~F.coalesce("is_label", F.lit(False))).drop("is_label")


def with_lead_ins(blocks: DataFrame) -> DataFrame:
    """A table's caption starts with the text before it if that leads in to it; long ones with their last sentence."""
    before, kind = F.lag("text").over(_along()), F.lag("kind").over(_along())
    rows = blocks.withColumn("before", F.when((F.col("kind") == "table") & (kind != "table") & (before.endswith(":") | before.rlike(LEAD_IN)), before))
    last = F.element_at(F.split("before", r"\. "), -1)
    lead = F.when(F.length("before") > LEAD_IN_CHARS, F.substring(last, F.greatest(F.lit(1), F.length(last) - LEAD_IN_CHARS + 1), F.lit(LEAD_IN_CHARS))).otherwise(F.col("before"))
    caption = F.when(lead.isNull(), F.col("caption")).otherwise(F.concat_ws("\n", lead, F.when(F.col("caption") != "", F.col("caption"))))
    rows = rows.withColumn("caption", caption)
    whole = F.array_join(F.concat(F.when(F.col("caption") != "", F.array("caption")).otherwise(F.array().cast("array<string>")), "header", "rows"), "\n")
    return rows.withColumn("text", F.when(F.col("kind") == "table", whole).otherwise(F.col("text"))).drop("before")


def running_headers(blocks: DataFrame) -> DataFrame:
    """(doc_id, text) of short bold lines on RUNNING_PAGES pages or more."""
    short = blocks.where(F.col("is_bold") & (F.length("text") <= HEADING_CHARS))
    return short.groupBy("doc_id", "text").agg(F.countDistinct("page_seq").alias("pages")).where(F.col("pages") >= RUNNING_PAGES).select("doc_id", "text")


def with_sections(blocks: DataFrame) -> DataFrame:
    """Items must rise by (number, letter), sub-items by letter within an item; topics are other bold lines.

    Acceptance is a running maximum, since the last accepted key is the largest candidate so
    far, and filling forward is the last value so far; no row-by-row state is needed.
    """
    head = F.when(F.col("is_bold") & (F.length("text") <= HEADING_CHARS), F.col("page_seq"))
    pages = F.size(F.collect_set(head).over(Window.partitionBy("doc_id", "text")))  # running_headers without a second parse of the blocks
    rows = blocks.withColumn("running", F.when(pages >= RUNNING_PAGES, F.lit(True)))
    text, short = F.col("text"), F.length("text") <= HEADING_CHARS
    is_text = F.col("kind") == "text"
    upper = (F.upper(text) == text) & (F.lower(text) != text)
    rows = rows.withColumn("fin", F.max(F.col("page").startswith("F-")).over(_so_far()))
    rows = rows.withColumn("fin0", F.col("fin") & ~F.coalesce(F.max("fin").over(_earlier()), F.lit(False)))
    key = F.struct(F.regexp_extract("text", ITEM, 1).try_cast("int").alias("number"), F.upper(F.regexp_extract("text", ITEM, 2)).alias("letter"), F.regexp_extract("text", ITEM, 3).alias("name"))
    rows = rows.withColumn("key", F.when(is_text & short & text.rlike(ITEM) & (F.col("is_bold") | upper) & ~F.col("fin"), key))
    order = F.struct(F.col("key.number"), F.col("key.letter"))
    rows = rows.withColumn("order", F.when(F.col("key").isNotNull(), order))
    most = F.max("order").over(_earlier())
    floor = F.struct(F.lit(0).alias("number"), F.lit("").alias("letter"))
    rows = rows.withColumn("is_item", F.coalesce(F.col("order") > F.coalesce(most, floor), F.lit(False)))
    name = F.trim(F.concat(F.lit("Item "), F.col("key.number").cast("string"), F.col("key.letter"), F.lit(". "), title(F.col("key.name"))))
    rows = rows.withColumn("item_text", F.when(F.col("is_item"), name).when(F.col("fin0"), F.lit(FINANCIALS)))
    rows = rows.withColumn("item", F.last("item_text", True).over(_so_far())).withColumn("seg", F.sum((F.col("is_item") | F.col("fin0")).cast("int")).over(_so_far()))
    letter = F.when(is_text & ~F.col("is_item") & F.col("item").isNotNull() & short & ~F.col("fin") & text.rlike(SUBITEM) & ~text.endswith("."), F.regexp_extract("text", SUBITEM, 1))
    rows = rows.withColumn("letter", letter)
    rows = rows.withColumn("is_sub", F.coalesce(F.col("letter") > F.coalesce(F.max("letter").over(_earlier("seg")), F.lit("")), F.lit(False)))
    sub = F.when(F.col("is_sub"), F.concat(F.col("letter"), F.lit(". "), title(F.regexp_extract("text", SUBITEM, 2))))
    rows = rows.withColumn("subitem", F.coalesce(F.last(sub, True).over(_so_far("seg")), F.lit(""))).withColumn("sseg", F.sum(F.col("is_sub").cast("int")).over(_so_far("seg")))
    is_topic = is_text & ~F.col("is_item") & ~F.col("is_sub") & F.col("is_bold") & short & ~text.endswith(".") & text.rlike("[A-Za-z]{3}") & F.col("running").isNull()
    rows = rows.withColumn("is_topic", is_topic)
    topic = F.last(F.when(F.col("is_topic"), text), True).over(_so_far("seg", "sseg"))
    level = F.when(F.col("is_item"), 1).when(F.col("is_sub"), 2).when(F.col("is_topic"), 3).otherwise(0)
    item = F.coalesce("item", F.lit(FRONT_MATTER))
    section = F.concat_ws(" > ", item, F.when(F.col("subitem") != "", F.col("subitem")), topic)
    rows = rows.withColumn("section", section).withColumn("item", item).withColumn("level", level)
    rows = rows.withColumn("kind", F.when(F.col("level") > 0, F.lit("heading")).otherwise(F.col("kind")))
    return rows.select("doc_id", "block_seq", "page_seq", "page", "kind", "level", "is_bold", "item", "subitem", "section", "text", "caption", "header", "rows")


def blocks_of(raw: DataFrame) -> DataFrame:
    return with_sections(with_lead_ins(with_labels(raw)))


def label_runs(labels: DataFrame, *group: str) -> DataFrame:
    """Runs of consecutive numbers n within each group: first, last and length."""
    island = F.col("n") - F.row_number().over(Window.partitionBy(*group).orderBy("n"))
    return labels.select(*group, "n").distinct().withColumn("island", island).groupBy(*group, "island").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count(F.lit(1)).alias("length")).drop("island")


def report(blocks: DataFrame) -> DataFrame:
    """Blocks, characters, items, sub-items and topics of each document."""
    kind: Column = F.col("kind")
    return blocks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("chars"),
        F.sum((kind == "table").cast("int")).alias("tables"), F.sum((F.col("level") == 1).cast("int")).alias("items"),
        F.sum((F.col("level") == 2).cast("int")).alias("subitems"), F.sum((F.col("level") == 3).cast("int")).alias("topics"),
    )
