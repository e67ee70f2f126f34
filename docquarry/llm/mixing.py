"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Each source has a weight and a size, the sum of its rows' sizes. The budget is shared by
weight; a source whose share is above `epochs` times its size is clamped there, and its
excess is shared by weight among the others, until none is above. A source with target t
and size s repeats all its rows floor(t / s) times. The fraction left is filled with whole
rows in the order of a seeded hash; the row at the end of the fraction gives only the words
that still fit, so each source meets its target to the word.

The rows at the end of the fraction are found without ordering a source: sizes are summed
over slices of the hash range (16**SLICE_DIGITS for each source, however large it is), the slice that
holds the end is found from these sums, and only its rows are ordered.

The hash is the md5 of seed and doc_id, which SQL engines share, so that the whole mix can be
stated in SQL. Up to BROADCAST sources are planned exactly on the driver and broadcast; more
stay a table: their weights come from ranks counted by range partitions, and the level of the
water from repeated sums over the table.

Edge cases: a null source is a source of its own, last in code-point order; a null or empty
text has size 0 and is taken 0 words; a very long text is counted whole; a source of size 0
has target 0; a null doc_id is hashed as the empty string; an empty table gives an empty
result; rows with equal ids and sizes are interchangeable, and each is counted; only doc_id,
source and text are read, and repeat() carries rows as structs, so other columns, whatever
their names, do no harm.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import SEPARATORS, WORD, materialize, table

#: Hexadecimal digits of the hash that name a slice.
SLICE_DIGITS = 3
EPOCHS = 2
#: Sources up to which their table is broadcast.
BROADCAST = 10_000
#: Share of all sizes that the query mixes, in percent, and its sources' weights, repeating.
PERCENT = 150
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[int], budget: Fraction, epochs: int = EPOCHS) -> list[Fraction]:
    """Targets of the sources, exactly; they sum to the budget if the caps allow it."""
    caps = [Fraction(epochs * s) for s in sizes]
    target = [Fraction(0)] * len(sizes)
    open_, left = set(range(len(sizes))), budget
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] > caps[i] * weight} if weight else set()
        if not over:
            for i in open_:
                target[i] = left * weights[i] / weight if weight else Fraction(0)
            break
        for i in over:
            target[i] = caps[i]
            left -= caps[i]
        open_ -= over
    return target


def plan(sized: DataFrame, percent: int = PERCENT, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> tuple[DataFrame, bool]:
    """A row for each source (its size, target, whole repetitions and the words of the fraction), and whether they are few enough to broadcast.

    Only the totals of BROADCAST sources at most reach the driver.
    """
    totals = materialize(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")))
    if totals.count() > BROADCAST:
        return plan_many(totals, percent, weights, epochs), False
    rows = totals.collect()
    rows.sort(key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    sizes = [r["source_size"] for r in rows]
    share = [weights[i % len(weights)] for i in range(len(rows))]
    targets = water_fill(sizes, share, Fraction(percent * sum(sizes), 100), epochs)
    out = []
    for r, t in zip(rows, targets, strict=True):
        whole = int(t // r["source_size"]) if r["source_size"] else 0
        out.append((r["source"], r["source_size"], float(t), whole, int(t - whole * r["source_size"])))
    schema = T.StructType([T.StructField(n, t) for n, t in (("source", T.StringType()), ("source_size", T.LongType()), ("target", T.DoubleType()), ("whole", T.LongType()), ("part", T.LongType()))])
    return sized.sparkSession.createDataFrame(out, schema), True


def plan_many(totals: DataFrame, percent: int = PERCENT, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """plan() without any row of a source on the driver; targets are exact to double precision."""
    ranged = totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged.withColumn("n", F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1))
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("rows"))  # one row for each partition
    before = F.coalesce(F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(F.broadcast(counts.select("range", before.alias("before"))), "range")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("before") + F.col("n"), F.lit(len(weights))) + 1).cast("int"))
    table_ = materialize(placed.select("source", "source_size", weight.alias("weight"), (epochs * F.col("source_size")).alias("cap")))
    total, all_weight = table_.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = Fraction(percent * total, 100)
    level, state = budget / all_weight if all_weight else Fraction(0), None
    while True:  # the level of the water rises as sources are capped
        over = F.col("weight") * float(level) > F.col("cap")
        capped, gone = table_.where(over).agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if (capped, gone) == state or gone == all_weight:
            break
        state, level = (capped, gone), (budget - capped) / (all_weight - gone)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * float(level))
    whole = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return table_.select("source", "source_size", target.alias("target"), whole.alias("whole"), F.floor(target - whole * F.col("source_size")).cast("long").alias("part"))


def mix(sized: DataFrame, planned: tuple[DataFrame, bool], seed: int = 0) -> DataFrame:
    """sized (doc_id, source, size) with its source's figures and the words taken of each row.

    `sized` should be a written table, as it is read three times. With more sources than may
    be broadcast the joins are shuffled, and Spark splits those of large sources.
    """
    sources, few = planned
    hint = F.broadcast if few else lambda df: df
    sources = hint(sources)
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    slot = F.substring(hashed, 1, SLICE_DIGITS)
    sized = sized.withColumn("slot", slot)
    sums = sized.groupBy("source", "slot").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        sums.withColumn("through", F.sum("words").over(run))
        .join(sources, sums["source"].eqNullSafe(sources["source"]))
        .where((F.col("through") > F.col("part")) & (F.col("through") - F.col("words") <= F.col("part")))
        .select(sources["source"].alias("end_source"), F.col("slot").alias("end_slot"), (F.col("part") - F.col("through") + F.col("words")).alias("end_part"))
    )
    joined = (
        sized.join(sources, sized["source"].eqNullSafe(sources["source"]), "left")
        .drop(sources["source"])
        .join(hint(ends), F.col("source").eqNullSafe(F.col("end_source")), "left")  # a row for each source at most
    )
    # without an end (the fraction is the whole source, which only a source of size 0 has) nothing is left out
    inside = joined.where(F.col("slot").eqNullSafe(F.col("end_slot")))
    outside = joined.where(~F.col("slot").eqNullSafe(F.col("end_slot")))
    order = Window.partitionBy("source").orderBy(hashed, "doc_id", "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = inside.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("end_part") - before)))
    outside = outside.withColumn("extra", F.when(F.col("slot") < F.col("end_slot"), F.col("size")).otherwise(F.lit(0)))
    taken = (F.col("whole") * F.col("size") + F.col("extra")).cast("long")
    keep = [c for c in sized.columns if c != "slot"]
    return inside.unionByName(outside).select(*keep, "source_size", "target", "whole", taken.alias("taken"))


def query(spark: SparkSession, sf_dir: str, seed: int = 0) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mix(sized, plan(sized), seed).select("doc_id", "size", "source_size", "target", "taken")


def repeated(docs: DataFrame, seed: int = 0) -> DataFrame:
    """docs as often as the mix takes their words.

    The rows are written once with their sizes, and the sources' figures go to them: only rows
    of the slices at the ends of the fractions are dealt out, so texts are neither shuffled nor
    sorted. With more sources than may be broadcast, rows and their words are joined.
    """
    size = word_count(docs["text"]).alias("size")
    rows = materialize(docs.select("doc_id", "source", size, F.struct(*docs.columns).alias("row")))  # a struct, so that no name clashes
    planned = plan(rows)
    if not planned[1]:
        return repeat(docs, mix(rows.drop("row"), planned, seed))
    return _copies(mix(rows, planned, seed).where(F.col("taken") > 0).select("row", "size", "taken"))


def repeat(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """docs as often as its words are taken: whole copies, then a last one cut to the words that are left.

    Rows taken 0 words go; of rows with equal ids and sizes each is taken as the most taken
    of them.
    """
    chosen = mixed.where(F.col("taken") > 0).groupBy("doc_id", "size").agg(F.max("taken").alias("taken")).select(F.struct("doc_id", "size", "taken").alias("mix"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), word_count(docs["text"]).alias("size"))  # a struct, so that no name clashes
    met = rows.join(chosen, F.col("row.doc_id").eqNullSafe(F.col("mix.doc_id")) & (F.col("size") == F.col("mix.size")))
    return _copies(met.select("row", "size", F.col("mix.taken").alias("taken")))


def _copies(rows: DataFrame) -> DataFrame:
    """The rows of (row, size, taken), each as often as it is taken; n_chars, where there is one, is counted anew in cut copies."""
    row, size, taken = F.col("row"), F.col("size"), F.col("taken")
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((taken - 1) / size))))
    words = F.least(size, taken - F.col("copy") * size)
    pieces = F.regexp_extract_all(row["text"], F.lit(SEPARATORS[:-1] + "*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(pieces, 1, words.cast("int")), "")
    shorter = row.withField("text", cut)
    names = {f.name: f.dataType for f in rows.schema["row"].dataType.fields}
    if "n_chars" in names:
        shorter = shorter.withField("n_chars", F.char_length(cut).cast(names["n_chars"]))
    return copies.select(F.when(words < size, shorter).otherwise(row).alias("row")).select("row.*")
