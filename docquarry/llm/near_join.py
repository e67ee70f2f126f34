"""N-gram Jaccard join: a MinHash LSH forest with exact verification.

Texts are sets of five-word shingles; two texts are linked if the Jaccard similarity of
their sets is 0.8 or more. The steps:

1. Equal texts are one node, represented by the least doc_id; copies follow as members.
2. The forest: each of TREES trees puts a node under the sequence of its DEPTH min-hashes, a
   path from the root of a prefix trie. Prefixes are shortened to `shortest_prefix` at the
   least, the length with which the forest reaches the target recall for pairs at the
   threshold. The nodes under one prefix of that length are a branch, and meet in one task.
3. Branches of one node, and those whose nodes all lie together in an earlier tree at full
   length, have nothing new and go. Sums for this are made before the shuffle.
4. A branch of more than BLOCK nodes is cut into blocks by hash, and every two blocks meet
   in a task of their own, so no task holds a whole crowded branch.
5. There the nodes' paths are sorted, so each prefix of the trie is a run of rows. From the
   whole paths on, the matched prefix is shortened by one min-hash at a time; the pairs that
   first match at that length are verified exactly, on shingle sets built anew from whole
   texts. Shortening ends as soon as the recall is reached: of a verified pair with similarity
   s, matches at length n or more have the chance p = 1 - (1 - s**n)**TREES, so it stands for
   (1 - p) / p pairs that are still to come; their sum, with three standard deviations and
   three unseen pairs at the threshold added, must be within 1 - RECALL of all. Crowds of near
   copies are done after long prefixes; where few links or none are found, or links near the
   threshold, prefixes are shortened to the end.
   A pair is verified once: in the tree where it matches longest, the first of several.
6. Verified pairs leave as counts for each node and as one edge to the least linked node of
   each local component, so a group of n near copies never becomes n * n rows.
7. Connected components of the edges are the classes.

Recall: a pair at the threshold shares a branch with probability 0.9992; within a branch
shortening leaves out 0.001 of its links at the most, as estimated from above. Nothing that
is found is dropped, and what is reported has been verified.

Edge cases: null counts as empty; an empty text has no shingle, so it is linked with nothing
and shares a class with the other empty texts as copies; a text of one to four words has
itself as its only shingle; a very long text is hashed whole, in one piece; a null doc_id is
left out, as it names no document; repeated rows of an id with different texts are each a
node under that id with one result row per distinct (doc_id, text); only doc_id and text are
read, so other columns, whatever their names, do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import textnum as tn
from docquarry.llm.common import materialize, table
from docquarry.llm.graph import components

_U = np.uint64
WORDS = 5
SIMILARITY = 0.8
TREES, DEPTH = 10, 6
RECALL = 0.999
BLOCK = 256


def matched(similarity: np.ndarray | float, length: int, trees: int = TREES) -> np.ndarray | float:
    """The chance that two texts match for that length in one of the trees."""
    return 1 - (1 - similarity**length) ** trees


def shortest_prefix(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The length to which prefixes are shortened at the least: the longest that gives the recall at the threshold; 1 at least."""
    return next((n for n in range(depth, 1, -1) if matched(similarity, n, trees) >= recall), 1)


def enough(found: np.ndarray, length: int, similarity: float = SIMILARITY, trees: int = TREES, recall: float = RECALL) -> bool:
    """Whether pairs of the similarities found, with prefixes down to that length, are all but 1 - recall of those there are."""
    p, worst = matched(found, length, trees), matched(similarity, length, trees)
    missed = ((1 - p) / p).sum() + 3 * np.sqrt(((1 - p) / p**2).sum()) + 3 * (1 - worst) / worst
    return bool(missed <= (1 - recall) * (len(found) + missed))


def shingle_sets(texts: pa.Array, n: int = WORDS, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, shingle hashes, row of each) with texts of fewer than n words as one shingle; repeats included."""
    for a, b, data, offsets in tn.pieces(texts, limit):
        starts, ends, docs = tn.words(data, offsets)
        h = tn.word_hashes(data, starts, ends)
        s, rows = tn.shingles(h, docs, n)
        words = tn.counts(docs, b - a)
        short = np.flatnonzero((words > 0) & (words < n))
        if len(short):
            first = np.concatenate(([0], np.cumsum(words)))[short]
            whole = np.zeros(len(short), _U)
            for k in range(n - 1):
                more = words[short] > k
                at = np.minimum(first + k, len(h) - 1)
                whole = np.where(more, whole * _U(0xC2B2AE3D27D4EB4F) + h[at] + _U(1), whole)
            s, rows = np.concatenate((s, tn.mix(whole + _U(n)))), np.concatenate((rows, short))
            order = np.argsort(rows, kind="stable")
            s, rows = s[order], rows[order]
        yield a, b, s, rows


def signatures(texts: pa.Array, count: int) -> np.ndarray:
    """count min-hashes for each text; texts without shingles have all ones."""
    out = np.full((len(texts), count), 0xFFFFFFFFFFFFFFFF, _U)
    by = tn.seeds(count, 11)
    for a, _, s, rows in shingle_sets(texts):
        if len(s):
            first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            for k in range(count):
                x = s * by[k]
                out[a + rows[first], k] = np.minimum.reduceat(x ^ (x >> _U(32)), first)
    return out


def paths(texts: pa.Array, trees: int, depth: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts, trees, levels) of hashes of the prefixes of `shortest` to `depth` min-hashes, signed, and whether a text has no shingle."""
    s = signatures(texts, trees * depth).reshape(len(texts), trees, depth)
    key = np.zeros((len(texts), trees), _U)
    out = np.zeros((len(texts), trees, depth - shortest + 1), _U)
    for k in range(depth):
        key = tn.mix(key * _U(0x9FB21C651E98DF25) + s[:, :, k])
        if k + 1 >= shortest:
            out[:, :, k + 1 - shortest] = key
    return out.view(np.int64), (s == _U(0xFFFFFFFFFFFFFFFF)).all((1, 2))


def nodes(docs: DataFrame, trees: int, depth: int, shortest: int) -> DataFrame:
    """(doc_id, digest, empty, paths) of each row: the digest of its text and the hashes of its prefixes, tree by tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        each = trees * (depth - shortest + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                texts = some.column(1)
                keys, empty = paths(texts, trees, depth, shortest)
                digest = [hashlib.sha256((t or "").encode()).digest()[:16] for t in texts.to_pylist()]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, each), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(digest, pa.binary()), pa.array(empty), lists], ["doc_id", "digest", "empty", "paths"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(tn.tidy(run), "doc_id long, digest binary, empty boolean, paths array<long>")


def first_matches(paths_: np.ndarray, left: np.ndarray, right: np.ndarray, tree: int) -> np.ndarray:
    """(left, right): the level at which a pair is to be verified in this tree, -1 where another tree has it."""
    mine = np.zeros((len(left), len(right)), np.int8)
    best = np.zeros_like(mine)
    for t in range(paths_.shape[1]):
        same = np.zeros_like(mine)
        for level in range(paths_.shape[2]):
            _, run = np.unique(paths_[:, t, level], return_inverse=True)
            same += run[left][:, None] == run[right][None]
        if t < tree:
            best = np.maximum(best, same)
        elif t == tree:
            mine = same
        else:
            best = np.maximum(best, same - 1)  # a later tree has a pair if it matches longer
    return np.where(mine > best, mine, 0) - 1


class Linker:
    """Jaccard similarities of sets against the sets of `right`, whose hashes lie sorted in one array."""

    def __init__(self, sets: list[np.ndarray], right: np.ndarray, similarity: float) -> None:
        self.sets, self.right, self.similarity = sets, right, similarity
        self.sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(right)), self.sizes[right])
        flat = np.concatenate([sets[j] for j in right]) if len(owner) else np.zeros(0, _U)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]

    def linked(self, i: int, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of right that are linked with i, of those that may be, and the similarities; sizes too far apart are not looked up."""
        size, others = self.sizes[i], self.sizes[self.right]
        may = may & (np.minimum(size, others) >= self.similarity * np.maximum(size, others) - 1e-9) & (others > 0)
        if not may.any():
            return np.zeros(0, np.int64), np.zeros(0)
        lo, hi = np.searchsorted(self.flat, self.sets[i], "left"), np.searchsorted(self.flat, self.sets[i], "right")
        n = hi - lo
        lo, n = lo[n > 0], n[n > 0]
        at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        shared = np.bincount(self.owner[at], minlength=len(self.right))
        j = np.flatnonzero(may & (shared > 0) & (shared >= self.similarity * (size + others - shared) - 1e-9))
        return j, shared[j] / (size + others[j] - shared[j])


def branch_links(sets: list[np.ndarray], paths_: np.ndarray, tree: int, left: np.ndarray, right: np.ndarray, shortest: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray, int]:
    """Linked pairs (i of left, j of right) of a branch, each once, and the length at which shortening ended."""
    trees, levels = paths_.shape[1:]
    level_of = first_matches(paths_, left, right, tree)
    if left is right:
        level_of[np.tril_indices(len(left))] = -1
    linker = Linker(sets, right, similarity)
    i, j, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(0)
    for level in range(levels - 1, -1, -1):
        here = level_of == level
        for k in np.flatnonzero(here.any(1)):
            js, like = linker.linked(left[k], here[k])
            i.append(np.full(len(js), left[k]))
            j.append(right[js])
            found = np.append(found, like)
        if level and enough(found, shortest + level, similarity, trees, recall):
            break
    return np.concatenate(i), np.concatenate(j), shortest + level


def _verify(ids: np.ndarray, texts: pa.Array, paths_: np.ndarray, block: np.ndarray, tree: int, left: int, right: int, shortest: int, similarity: float, recall: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, the links of each, and the least id of its local component."""
    sets: list[np.ndarray] = []
    for a, b, s, rows in shingle_sets(texts):
        cut = np.searchsorted(rows, np.arange(b - a + 1))
        sets += [np.unique(s[cut[i] : cut[i + 1]]) for i in range(b - a)]
    a = np.flatnonzero(block == left)
    i, j, _ = branch_links(sets, paths_, tree, a, a if left == right else np.flatnonzero(block == right), shortest, similarity, recall)
    links = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
    root = np.arange(len(ids))
    while True:  # least index of the neighbours, until it rests
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            break
    return ids, links, ids[root]


def links(docs: DataFrame, similarity: float = SIMILARITY, trees: int = TREES, block: int = BLOCK, depth: int = DEPTH, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, digest), the texts (digest, node), and of the linked nodes (node, n, root) with one row or more for each."""
    shortest = shortest_prefix(similarity, trees, depth, recall)
    levels = depth - shortest + 1
    rows = materialize(nodes(docs, trees, depth, shortest))
    least = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("empty").alias("empty"), F.first("paths").alias("paths")))

    # a branch for each tree and shortest prefix; whole paths of trees before it are summed up to see whether its nodes all match there
    roots = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.get("paths", t * levels))
    ends = F.transform(F.sequence(F.lit(0), F.lit(trees - 2)), lambda t: F.get("paths", t * levels + levels - 1)) if trees > 1 else F.array().cast("array<long>")
    spread = least.where(~F.col("empty")).select("digest", ends.alias("ends"), F.posexplode(roots).alias("tree", "key"))
    earlier = [F.when(F.col("tree") > t, F.col("ends")[t]) for t in range(trees - 1)]
    sums = [F.min(k).alias(f"lo{t}") for t, k in enumerate(earlier)] + [F.max(k).alias(f"hi{t}") for t, k in enumerate(earlier)]
    met = F.lit(False)
    for t in range(trees - 1):
        met = met | ((F.col("tree") > t) & (F.col(f"lo{t}") == F.col(f"hi{t}")))
    open_ = spread.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n"), *sums).where((F.col("n") > 1) & ~met)
    open_ = materialize(open_.select("tree", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64("digest", "tree"), F.col("blocks")).cast("int")
    inside = spread.select("digest", "tree", "key").join(open_, ["tree", "key"]).withColumn("mine", mine)
    meetings = materialize(
        inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "digest", "tree", "key", "mine", F.least("mine", "other").alias("left"), F.greatest("mine", "other").alias("right")
        )
    )
    needed = materialize(meetings.select("digest").distinct().join(least.select("digest", "node", "paths"), "digest"))
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("node"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(needed, "node").where(F.substring(F.unhex(F.sha2("text", 256)), 1, 16) == F.col("digest")).dropDuplicates(["digest"])
    full = meetings.join(texts, "digest")

    def verify(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        paths_ = group["paths"].combine_chunks().flatten().to_numpy().reshape(len(group), trees, levels)
        tree, _, left, right = (k.as_py() for k in key)
        ids, n, root = _verify(group["node"].to_numpy(), group["text"].combine_chunks(), paths_, group["mine"].to_numpy(), tree, left, right, shortest, similarity, recall)
        live = n > 0
        return pa.table({"node": ids[live], "n": n[live], "root": root[live]})

    found = full.groupBy("tree", "key", "left", "right").applyInArrow(verify, "node long, n long, root long")
    return rows.select("doc_id", "digest"), least.select("digest", "node"), materialize(found)


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, digest, node, class_id, n_links): a row for each distinct (doc_id, text) of a row with an id."""
    rows, texts, found = links(docs, similarity)
    of = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).select("node", "component")
    n = found.groupBy("node").agg(F.sum("n").cast("long").alias("n"))
    # joined to the texts, one row each, before their copies: the join with these is then one that Spark can split
    known = texts.join(n, "node", "left").join(of, "node", "left")
    known = materialize(known.select("digest", "node", F.coalesce("component", "node").alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links")))
    return rows.distinct().join(known, "digest").select("doc_id", "digest", "node", "class_id", "n_links")


def digest_of(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)), 1, 16)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each class, the one with the least doc_id; rows without an id stay, and so do repeated rows of what is kept."""
    of = classes(docs, similarity)
    gone = of.where(F.col("doc_id") != F.col("class_id")).select(F.struct("doc_id", "digest").alias("gone"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), digest_of(docs["text"]).alias("digest"))  # a struct, so that no name clashes
    same = (F.col("row.doc_id") == F.col("gone.doc_id")) & (F.col("digest") == F.col("gone.digest"))
    return rows.join(gone, same, "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str, similarity: float = SIMILARITY) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), similarity).select("doc_id", "class_id", "n_links")
