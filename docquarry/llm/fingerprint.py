"""Document fingerprints: one-permutation MinHash in DataFrame operations only.

The words of a text are hashed once each, and every run of five words gives one shingle
hash (a text of fewer words has itself as its only one). The top bits of a shingle's mixed
hash name its bin, and the bin keeps the least of them. An empty bin takes the value of the
first bin that is not empty in a random order of its own (optimal densification: the order
depends on the bin alone, so two texts with the same empty bins borrow alike). The low BITS
bits of each bin's value are the fingerprint, written as hexadecimal digits. Of two texts
with Jaccard similarity J, bins agree with probability J + (1 - J) / 2**BITS; likeness()
takes the share of bins that agree and removes that bias, within 0 and 1.

Sorting the hashes of a text puts each bin's least value first, so that no per-bin scan is
needed; all steps are array expressions of one row, without any shuffle.

Edge cases: a null text counts as empty; texts without words have one fixed shingle and so
are equal to each other in likeness; a very long text is hashed whole, in its own row;
repeated texts have equal fingerprints; rows of equal ids follow each other in the order of
their texts, null ids come last; the query reads doc_id and text alone, and fingerprints()
keeps other columns but replaces one named `fingerprint`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import SEPARATORS, table

BINS_LOG2 = 8
BINS = 1 << BINS_LOG2
BITS = 8
#: Taken from the low bits, so that they fit a signed byte.
HALF = 1 << (BITS - 1)
WORDS = 5
#: Documents in one slice of the order by doc_id, and slices at most.
SLICE, SLICES = 500, 4096
#: Bins that an empty one asks at random before it ranks all.
ASKED = 6


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, n: int = WORDS) -> Column:
    """Hashes of the runs of n words."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")

    def runs(hashes: Column) -> Column:
        starts = F.slice(hashes, 1, F.greatest(F.size(hashes) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, n)]))

    some = let(F.transform(words, lambda x: F.xxhash64(x)), runs)
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.xxhash64(F.lit(None).cast("string"))))


def signature(text: Column) -> Column:
    """The low bits of each bin's value, BINS bytes; entry i belongs to the i-th bin in signed order."""
    low = 64 - BINS_LOG2
    none = F.lit((1 << low) - 1)  # these low bits mark an empty bin
    marks = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda b: F.shiftleft(b.cast("long"), low).bitwiseOR(none))

    def least(hashes: Column) -> Column:
        return F.filter(hashes, lambda x, i: (i == 0) | (F.shiftright(x, low) != F.shiftright(F.get(hashes, i - 1), low)))

    def open_(bins: Column) -> Column:
        return F.transform(bins, lambda x: F.when(x.bitwiseAND(none) != none, x))

    def value(bins: Column, x: Column, i: Column) -> Column:
        """x, or of an empty bin i the value of the first bin that has one among a few at random, else of all in an order of bin i's own."""
        asked = [F.get(bins, F.pmod(F.xxhash64(i, F.lit(a)), F.lit(BINS)).cast("int")) for a in range(1, ASKED + 1)]
        ranked = F.transform(F.array_compact(bins), lambda y: F.struct(F.xxhash64(i, F.shiftright(y, low)).alias("order"), y.alias("value")))
        return F.coalesce(x, *asked, F.array_min(ranked)["value"])

    def fill(bins: Column) -> Column:
        return F.transform(bins, lambda x, i: (value(bins, x, i).bitwiseAND(F.lit((1 << BITS) - 1)) - F.lit(HALF)).cast("byte"))

    hashes = F.sort_array(F.concat(shingle_hashes(text), marks))
    return let(let(let(hashes, least), open_), fill)


def packed(signature_: Column) -> Column:
    """The signature as a string of hexadecimal digits."""
    return F.array_join(F.transform(signature_, lambda x: F.lpad(F.hex(x.cast("int") + HALF), BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimate of the Jaccard similarity from two signatures."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (same - chance) / (1 - chance))


def with_next(docs: DataFrame, derived: dict[str, Column], slices: int | None = None) -> DataFrame:
    """docs (doc_id, text) with the derived columns of text, and text and these of the next row as next_<column>.

    The next row is that with the next lower doc_id, after the last the first. Rows with
    equal ids come in the order of their text; null ids last. Ids are cut into slices at
    quantiles; within a slice the next row is one window step away, and the first rows of the
    slices, one each, are handed to the slice before. So the texts are shuffled once.
    """
    columns = ["text", *derived]
    if slices is None:
        slices = min(max(1, docs.count() // SLICE), SLICES)
    cuts = docs.select(F.percentile_approx("doc_id", [k / slices for k in range(1, slices)], 10 * slices)).first()[0] if slices > 1 else []
    cuts = sorted({int(c) for c in cuts or []})
    place = F.coalesce(F.lit(len(cuts)) - _below(cuts, F.col("doc_id")), F.lit(len(cuts) + 1))
    sliced = docs.select("doc_id", "text", place.alias("slice"))
    w = Window.partitionBy("slice").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    ids = sliced.groupBy("slice").agg(F.max("doc_id").alias("first_id")).withColumnRenamed("slice", "its")
    here = (F.col("slice") == F.col("its")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    firsts = sliced.join(F.broadcast(ids), here)  # ids: a row for each slice, so slices + 1 at most
    firsts = firsts.withColumn("n", F.row_number().over(w)).where("n = 1").select("slice", "text").withColumns(derived)
    around = Window.orderBy("slice")
    before = ids.select(F.col("its").alias("slice")).select("slice", F.lag("slice").over(around).alias("before"), F.max("slice").over(Window.partitionBy(F.lit(1))).alias("last"))
    handed = firsts.join(F.broadcast(before), "slice").select(F.coalesce("before", "last").alias("to"), *[F.col(c).alias(f"first_{c}") for c in columns])
    steps = sliced.withColumns(derived).select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns], F.lead(F.lit(True)).over(w).alias("inside"))
    joined = steps.join(handed, steps["slice"] == handed["to"], "left")
    ahead = [F.when(F.col("inside"), F.col(f"next_{c}")).otherwise(F.col(f"first_{c}")).alias(f"next_{c}") for c in columns]
    return joined.select("doc_id", *columns, *ahead)


def _below(cuts: list[int], value: Column) -> Column:
    """How many of the ascending cuts are less than value, by binary search; null for null."""
    n = len(cuts)
    if not n:
        return F.when(value.isNotNull(), F.lit(0))
    edges = F.from_json(F.lit(str(cuts)), "array<long>")
    steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)]

    def go(found: Column, step: Column) -> Column:
        return F.when((found + step <= n) & (F.get(edges, found + step - 1) < value), found + step).otherwise(found)

    return F.when(value.isNotNull(), F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), go))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with its fingerprint as a string of hexadecimal digits."""
    return docs.withColumn("fingerprint", packed(signature(F.col("text"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, {"signature": signature(F.col("text"))})
    third = F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("*", signature(F.col("edited")).alias("edited_signature"))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("signature")).alias("fingerprint"),
        packed(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
