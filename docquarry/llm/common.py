"""Helpers the training-data operators share: table access, shared scratch tables, folds."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.sources.tables import read_table

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = r"[\x20\x09-\x0D]+"

_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, removed when the driver's JVM ends.

    Where that setting is absent a folder of this machine is taken, but only in local mode,
    where no other machine has to see it; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    jvm = spark.sparkContext._jvm
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _scratch:
            _scratch[app] = tempfile.mkdtemp(prefix="docquarry-")
            atexit.register(shutil.rmtree, _scratch[app], ignore_errors=True)
        base = _scratch[app]
    path = f"{base.rstrip('/')}/docquarry-{uuid.uuid4().hex}"
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df to the shared scratch folder and read it back: lineage ends at durable files."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/t"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_training_fold(doc_id: Column) -> Column:
    """Rows whose labels may be learned from: crc32 of the id's digits is not a multiple of 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """At most `bound` training rows (doc_id, text, label): those whose id has the smallest hash.

    The ids are bounded by `bound`, which is what makes their broadcast safe. An id with
    several label rows counts once, with its largest label; an id with several documents
    keeps each of them, so a sample can exceed `bound` only by repeated ids.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & in_training_fold(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
