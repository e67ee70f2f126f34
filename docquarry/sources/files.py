"""Readers and writers: manifests, submission feeds, HTML, JSON lines, CSV, indexes, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.schemas import BLOCK, MANIFEST, QUESTION, TOOL_CALLS, TRACE, filing_key

# The form that is wanted, how many of it, and where a document lies in the archive.
FORM, REPORTS = "20-F", 2
ARCHIVE = "https://www.sec.gov/Archives/edgar/data/%d/%s/%s"
SUBMISSIONS = "company string, filings struct<recent: struct<form: array<string>, accessionNumber: array<string>, filingDate: array<string>, reportDate: array<string>, primaryDocument: array<string>>>"
# Fixed value: a script that servers add before the end of a page.
INJECTED = r"(?is)<script\b[^>]*>(?:(?!</script>).)*</script>\s*(?=</body>)"


def padded_cik(cik: Column) -> Column:
    return F.lpad(cik.cast("string"), 10, "0")


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """Feeds with a company key and parallel arrays of filings."""
    return spark.read.schema(SUBMISSIONS).option("multiLine", True).json(path)


def latest_reports(feeds: DataFrame, n: int = REPORTS, form: str = FORM) -> DataFrame:
    """The first n filings of exactly that form of each company, in feed order."""
    r = F.col("filings.recent")
    names = {"form": "form", "accession": "accessionNumber", "filing_date": "filingDate", "report_date": "reportDate", "primary_document": "primaryDocument"}
    rows = feeds.select("company", F.posexplode(F.arrays_zip(*[r[v].alias(v) for v in names.values()])).alias("at", "f"))
    rows = rows.select("company", "at", *[F.col("f")[v].alias(k) for k, v in names.items()]).where(F.col("form") == form)
    w = Window.partitionBy("company").orderBy("at")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).drop("at", "n")


def manifest_of(feeds: DataFrame, registry: DataFrame, n: int = REPORTS) -> DataFrame:
    """Manifest rows without digests; raises if a company has fewer reports than wanted."""
    reports = latest_reports(feeds, n)
    short = registry.join(reports.groupBy(F.col("company").alias("key")).agg(F.count(F.lit(1)).alias("n")), "key", "left").where(F.coalesce("n", F.lit(0)) < n)
    lacking = [r["key"] for r in short.select("key").limit(20).collect()]
    if lacking:
        raise ValueError(f"fewer than {n} {FORM} filings: {', '.join(lacking)}")
    rows = reports.join(F.broadcast(registry.select(F.col("key").alias("company"), "cik")), "company")  # the registry is a list in code
    year = F.substring("report_date", 1, 4).cast("int")
    key = filing_key(F.col("company"), year)
    url = F.format_string(ARCHIVE, "cik", F.replace(F.col("accession"), F.lit("-"), F.lit("")), "primary_document")
    return rows.select(key.alias("key"), "company", "cik", year.alias("fiscal_year"), "form", "accession", "filing_date", "report_date", "primary_document", url.alias("url"), F.concat(F.lit("data/raw/"), key, F.lit(f"_{FORM}.htm")).alias("local_path"))


def manifest(spark: SparkSession, path: str, registry: DataFrame) -> DataFrame:
    """Filings of a manifest joined to their companies."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    names = registry.select(F.col("key").alias("company"), "short_name", "full_name")
    return rows.join(F.broadcast(names), "company")


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content and digest of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes"))


def clean_html(html: Column) -> Column:
    """Without the script servers add; null if it is no inline report."""
    bare = F.regexp_replace(html, INJECTED, "")
    return F.when(F.lower(bare).contains("ix:header"), bare)


def changed(files: DataFrame, pinned: DataFrame) -> DataFrame:
    """Files whose digest differs from, or lacks in, the pinned manifest."""
    return files.join(pinned.select("key", "sha256"), ["key", "sha256"], "left_anti")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_blocks(spark: SparkSession, glob: str) -> DataFrame:
    """Block files named <filing>_blocks.jsonl, with the filing from the name; raises if no file is there. Files without rows are no error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where):
        raise FileNotFoundError(f"no blocks at {glob}")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_blocks\.jsonl", 1)
    return spark.read.schema(BLOCK).json(glob).withColumn("filing", name)


def _decoded(raw: bytes) -> str:
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp1252", errors="replace")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question rows, UTF-8 with or without mark, else cp1252; the header must be exactly QUESTION.

    Question lists are files that people keep by hand; they are decoded as whole files.
    """
    text = F.pandas_udf(lambda raw: raw.map(_decoded), "string")(F.col("content"))
    lines = spark.read.format("binaryFile").load(path).select(text.alias("text"))
    head = [r["h"] for r in lines.select(F.trim(F.split("text", "\n")[0]).alias("h")).distinct().limit(2).collect()]
    if head != [",".join(QUESTION)]:
        raise ValueError(f"the header of {path} is {head}, not {','.join(QUESTION)}")
    fixed = lines.select(F.regexp_replace("text", "^[^\n]*\n", "").alias("text"))
    # records end at line ends outside quotes: an even number of quotes follows
    records = F.filter(F.split("text", r'\r?\n(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda r: F.trim(r) != "")
    schema = ", ".join(f"{c} string" for c in QUESTION)
    rows = fixed.select(F.explode(records).alias("r")).select(F.from_csv("r", schema, {"multiLine": "true", "escape": '"'}).alias("q")).select("q.*")
    return rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in QUESTION])


def evidence_of(questions: DataFrame) -> DataFrame:
    """(qid, n, company, year, pages, snippet) from cells with `;` between entries and `|` between pages; unequal lengths raise."""
    cell = lambda c, sep: F.transform(F.split(c, sep), lambda x: F.trim(x))
    parts = {"company": "gold_company", "year": "gold_year", "pages": "gold_page", "snippet": "evidence"}
    zipped = questions.select(F.col("id").alias("qid"), *[cell(v, ";").alias(k) for k, v in parts.items()])
    sizes = [F.size(k) for k in parts]
    equal = (sizes[0] == sizes[1]) & (sizes[1] == sizes[2]) & (sizes[2] == sizes[3])
    checked = zipped.withColumn("qid", F.when(equal, F.col("qid")).otherwise(F.raise_error(F.concat(F.lit("cells of unequal length in question "), F.col("qid")))))
    rows = checked.select("qid", F.posexplode(F.arrays_zip(*parts)).alias("n", "e"))
    return rows.select("qid", "n", F.col("e.company"), F.col("e.year").cast("int").alias("year"), cell(F.col("e.pages"), r"\|").alias("pages"), F.col("e.snippet"))


def write_csv(df: DataFrame, path: str) -> None:
    """Results as CSV; booleans as TRUE and FALSE."""
    flags = {c: F.upper(F.col(c).cast("string")) for c, t in df.dtypes if t == "boolean"}
    df.withColumns(flags).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_index(chunks: DataFrame, path: str, model: str, **settings: object) -> int:
    """A chunk table with vectors, partitioned by strategy, and a row of its settings; the number of rows."""
    chunks.write.mode("overwrite").partitionBy("strategy").parquet(f"{path}/chunks")
    meta = [(model, str(sorted(settings.items())))]
    chunks.sparkSession.createDataFrame(meta, "embed_model string, settings string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return chunks.sparkSession.read.parquet(f"{path}/chunks").count()


def open_index(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The chunk table; raises if it was embedded by another model."""
    made = spark.read.schema("embed_model string, settings string").json(f"{path}/meta").first()
    if made is None or made["embed_model"] != model:
        raise ValueError(f"the index at {path} was made with {made and made['embed_model']!r}, not {model!r}; build it anew")
    return spark.read.parquet(f"{path}/chunks")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Trace records; `tool_calls` is a list in steps and a number in final records, so each is read by its event."""
    lines = spark.read.text(path)
    base = F.from_json("value", TRACE)
    calls = F.from_json(F.get_json_object("value", "$.tool_calls"), TOOL_CALLS)
    total = F.get_json_object("value", "$.tool_calls").try_cast("long")
    rows = lines.select(base.alias("r"), F.when(base["event"] == "step", calls).alias("calls"), F.when(base["event"] == "final", total).alias("tool_calls_total"))
    return rows.select("r.*", "calls", "tool_calls_total")
