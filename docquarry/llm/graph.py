"""Connected components of large sparse graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, component), the least node of each component.

    Alternates two steps until nothing changes: every node links its greater neighbours to
    the least of all its neighbours and itself, then its lesser neighbours likewise. The
    number of rounds grows with the logarithm of the longest path. Each round's edges are
    written to the shared folder. Minima are summed up before the shuffle; the join that
    hands them back can be split by Spark where a node has very many neighbours.
    """
    edges = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _step(both, F.col("b") > F.col("a"))
        small = _step(large, F.lit(True))
        edges = materialize(small)
        # a sum of hashes tells sets of distinct edges apart; the count guards the empty one
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == state:
            break
        state = (now["n"], now["h"])
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _step(edges: DataFrame, live) -> DataFrame:
    """Link the neighbours b of a for which `live` holds, and a itself, to the least of a and its neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("m", "a").alias("m"))
    linked = edges.where(live).join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("k").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(own).where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
