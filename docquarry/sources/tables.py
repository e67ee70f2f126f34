"""Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows take long for their bytes: texts, pages, turns and vectors.
HEAVY = frozenset({"documents", "pages", "conversations", "embeddings"})
#: Bytes of a row group as writers make them; one task reads a row group.
ROW_GROUP = 128 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table; heavy ones are dealt over all cores where they would leave some idle."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows) if name in HEAVY else rows


def spread(rows: DataFrame) -> DataFrame:
    """rows as they are if their files and row groups are as many as cores, else dealt evenly over the cores.

    A small table in one file is one row group, which one task reads however many cores there
    are. Large tables have more files than cores and are never shuffled here. Columns and
    filters still reach the scan.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if len(rows._jdf.inputFiles()) >= cores:
        return rows
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < ROW_GROUP * cores else rows
