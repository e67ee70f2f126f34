"""Substring dedup: passages that documents share, found by compact windows of min-hashes.

A text is the sequence of its five-word shingles, and a passage a run of LEAST shingles (50
words) or more. For each of HASHES functions the Cartesian tree of a text's hash values
gives its compact windows: all passages between l and r that contain c have their min-hash
at c, so two texts that share a passage have a window with the same min-hash, each around
its own copy of it. The steps:

1. Windows whose min-hash only one document has go; counting is summed up before the shuffle.
2. The others are grouped by min-hash alone, so inserted or deleted words separate nothing. A
   window's section is its shingles less than LEAST away from c. Windows with equal sections
   share a passage: each is paired with the least and the greatest document of these.
3. Different sections of a group meet. Of SMALL or fewer every pair with enough shingles in
   common (bitmaps tell, and lose none) is a candidate. Of more, shingles that one window of
   the group alone has are struck out, and windows with too few others have no partner; those
   with equal others, at equal places around c, are a class, for which one is compared. Pairs
   of classes are verified, those with most in common first, until every pair that may pass is
   verified or already connected by verified pairs; the pairs that connect are candidates, and
   each other window of a class with one that it shares a passage with. More than BLOCK
   windows are struck out by parts of their shingles and compared in blocks of classes.
4. Interval join: two windows aligned at c overlap from the larger l to the smaller r, and as
   far beyond as insertions may shift them; the overlaps of a pair of documents at one shift,
   over all functions, are one candidate.
5. Both texts' stretches are fetched, and the shared passages in them are verified exactly,
   from either side and wherever in a passage its changes lie:
   Jaccard similarity of the shingle sets of SIMILARITY or more, LEAST shingles or more.

An exactly repeated passage of 50 words or more is found by every function with certainty;
one with similarity 0.8 shares a min-hash by at least one of three with probability 0.992.

The result has a row for each passage of a candidate: doc_id, start, end, other_id (less than
doc_id), other_start, other_end (word positions, end exclusive), similarity, and group_id, the
least id of the documents that hang together by such rows. Not every pair of a large group has
a row, but all its documents have the group.

Edge cases: null text counts as empty; a text of fewer than 50 words has no passage; a very
long text is searched whole, in one piece; a null doc_id is left out; rows with the same id
count as one document, each of whose texts is searched; a passage that only its own document
repeats is not reported; only doc_id and text are read, so other columns, whatever their names,
do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import textnum as tn
from docquarry.llm.common import materialize, table
from docquarry.llm.graph import components
from docquarry.llm.windows import compact_windows

_U = np.uint64
WORDS = 5
LEAST = 46
SIMILARITY = 0.8
HASHES = 3
#: Windows of a group that meet in one task, and the most whose pairs all are candidates.
BLOCK, SMALL = 512, 32
_BITS = 2048


#: Spark's setting by which a write's shuffles leave the disk as it ends; else they stay until the driver collects its garbage.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _settled(df: DataFrame, *done: DataFrame) -> DataFrame:
    """df in the shared folder; the tables `done` and the shuffles that made it go, since their sum would take several times the input's disk."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANED, "false")
    conf.set(_CLEANED, "true")
    try:
        out = materialize(df)
    finally:
        conf.set(_CLEANED, before)
    jvm = df.sparkSession._jvm
    for table_ in done:
        for path in {f.rsplit("/", 1)[0] for f in table_.inputFiles()}:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return out


def window_rows(docs: DataFrame, hashes: int = HASHES, least: int = LEAST) -> DataFrame:
    """(key, hash, doc_id, c, l, r, section) of each compact window; section is a hash of its shingles less than `least` away from c."""
    by = tn.seeds(hashes, 5)
    turn = np.arange(1, hashes + 1, dtype=_U) * by[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "hash", "doc_id", "c", "l", "r", "section"]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, data, offsets in tn.pieces(batch.column(1)):
                starts, ends, docs_ = tn.words(data, offsets)
                s, rows = tn.shingles(tn.word_hashes(data, starts, ends), docs_, WORDS)
                edges = np.concatenate(([0], np.cumsum(tn.counts(rows, b - a))))
                sums = _sums(s)
                for k in range(hashes):
                    x = s * by[k]
                    c, l, r = compact_windows(x ^ (x >> _U(32)), edges, least)  # noqa: E741
                    doc, key = rows[c], tn.mix(s[c] + turn[k])
                    section = _section(sums, c, *_around(c, l, r, least))
                    at = [pa.array((v - edges[doc]).astype(np.int32)) for v in (c, l, r)]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(c), k, np.int32)), pa.array(ids[a + doc]), *at, pa.array(section.view(np.int64))], names)

    return docs.mapInArrow(tn.tidy(run), "key long, hash int, doc_id long, c int, l int, r int, section long")


def _around(c: np.ndarray, l: np.ndarray, r: np.ndarray, least: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """First and end position of the windows' sections: every passage of `least` shingles around c, `least` or more in all."""
    return np.maximum(l, c - least + 1), np.minimum(r, c + least - 1) + 1


def _sums(s: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, _U), np.cumsum(s * tn._power(tn.BASE, len(s)), dtype=_U)))


def _section(sums: np.ndarray, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    inside = (sums[hi] - sums[lo]) * tn._power(tn.INVERSE, len(sums))[lo]
    return tn.mix(tn.mix(inside + (c - lo).astype(_U)) + (hi - lo).astype(_U))


def _unshared(least: int, similarity: float) -> int:
    """Shingles that two passages have beside their common ones, at the most, if they have no lesser passages at that similarity.

    Of two halves of a passage one is as similar, so that these have under 2 * least shingles in the shorter text.
    """
    return math.floor((1 / similarity - 1) * (2 * least - 1) + 1e-9)


def _reach(least: int, similarity: float) -> int:
    """Shingles of the longer of two such passages, at the most."""
    return 2 * least - 1 + _unshared(least, similarity)


def sections(docs: DataFrame, wanted: DataFrame, least: int = LEAST) -> DataFrame:
    """wanted (doc_id, windows: array of structs with c, l, r, section, reach and others), a row for each window with `shingles`, 32 bits of each of its shingles less than reach away from c, and the fewest different ones in `least` of these."""
    kind = wanted.schema["windows"].dataType.elementType
    names = kind.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for a, b, data, offsets in tn.pieces(batch.column(2)):
                    lists = batch.column(1).slice(a, b - a)
                    doc = np.repeat(np.arange(b - a), lists.value_lengths().to_numpy())
                    windows, ids = pa.RecordBatch.from_struct_array(lists.flatten()), batch.column(0).slice(a, b - a)
                    starts, ends, docs_ = tn.words(data, offsets)
                    s, rows = tn.shingles(tn.word_hashes(data, starts, ends), docs_, WORDS)
                    edges = np.concatenate(([0], np.cumsum(tn.counts(rows, b - a))))
                    c, l, r = (windows.column(n).to_numpy().astype(np.int64) + edges[doc] for n in ("c", "l", "r"))  # noqa: E741
                    lo, hi = _around(c, l, r, least)
                    inside = np.flatnonzero(r < edges[doc + 1])
                    same = _section(_sums(s), c[inside], lo[inside], hi[inside]) == windows.column("section").to_numpy().view(_U)[inside]
                    take = inside[same]  # the others are of another text of this id
                    lo, hi = _around(c, l, r, windows.column("reach").to_numpy())
                    n = hi[take] - lo[take]
                    cut = np.concatenate(([0], np.cumsum(n)))
                    low = s[np.arange(cut[-1]) + np.repeat(lo[take] - cut[:-1], n)].astype(np.uint32)
                    binary = pa.Array.from_buffers(pa.binary(), len(take), [None, pa.py_buffer((cut * 4).astype(np.int32)), pa.py_buffer(low)])
                    windows = windows.take(pa.array(take))
                    order = np.sort(np.repeat(np.arange(len(take)), n) << 32 | low)
                    fewest = np.full(len(take), least, np.int32)
                    for i in np.unique(order[1:][order[1:] == order[:-1]] >> 32).tolist():
                        fewest[i] = _fewest(low[cut[i] : cut[i + 1]], least)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[take])), *windows.columns, pa.array(fewest), binary], ["doc_id", *names, "fewest", "shingles"])

    schema = ", ".join(["doc_id long", *(f"{f.name} {f.dataType.simpleString()}" for f in kind.fields), "fewest int", "shingles binary"])
    return wanted.join(docs, "doc_id").select("doc_id", "windows", "text").mapInArrow(tn.tidy(run), schema)


def _shared(least: int, similarity: float) -> int:
    """Shingles that passages of `least` or more share at that similarity, at the least: of equal lengths 2s / (1 + s) of them."""
    return math.ceil(2 * similarity / (1 + similarity) * least - 1e-9)


def _alike(x: np.ndarray, y: np.ndarray, cx: int, cy: int, least: int, similarity: float) -> bool:
    """Whether x and y, with the min-hash at cx and cy, share a passage; 0 is a shingle that no other has."""
    x, y = x.astype(_U), y.astype(_U)
    for v, side in ((x, 1), (y, 2)):
        lone = np.flatnonzero(v == 0)
        v[lone] = (lone.astype(_U) << _U(34)) + (_U(side) << _U(32))
        if len(v) < least:  # others fill it up
            more = (np.arange(len(v), least).astype(_U) << _U(34)) + (_U(side) << _U(32))
            x, y = (np.concatenate((x, more)), y) if side == 1 else (x, np.concatenate((y, more)))
    left, right = min(cx, cy), min(len(x) - cx, len(y) - cy)
    if left + right >= least:  # a stretch about as long at one shift tells without a search
        total = np.zeros(left + right + 1, np.int64)
        np.cumsum(x[cx - left : cx + right] == y[cy - left : cy + right], out=total[1:])
        inside = total[least:] - total[:-least]
        k = int(inside.argmax())
        if inside[k] >= _shared(least, similarity):
            a, b = cx - left + k, cy - left + k
            if inside[k] == least or _likeness(x[a : a + least], y[b : b + least]) >= similarity - 1e-9:
                return True
    return bool(common_spans(x, y, least, similarity))


def _fewest(x: np.ndarray, least: int) -> int:
    """The fewest different values in `least` consecutive ones."""
    order = np.argsort(x, kind="stable")
    before = np.full(len(x), -1)
    same = x[order][1:] == x[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    runs = np.lib.stride_tricks.sliding_window_view(before, least)
    return int((runs < np.arange(len(runs))[:, None]).sum(1).min())


def _bitmaps(flat: np.ndarray, cut: np.ndarray, common: int) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of each section's shingles, and how many bits two sections must share to have `common` shingles in common: none is lost."""
    n = np.diff(cut)
    bits = np.zeros((len(n), _BITS), bool)
    bits[np.repeat(np.arange(len(n)), n), (flat * np.uint32(2654435761)) >> np.uint32(21)] = True
    return np.packbits(bits, axis=1).view(_U), common - (n - bits.sum(1))


def _hopeful(patterns: list[tuple[int, np.ndarray]], fewest: np.ndarray, least: int, similarity: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """A function of i and others that tells with which of them i may share a passage; it leaves out none that does.

    Two passages with c different shingles in common have c * (1 - similarity) / similarity others at the most, and one of
    the two has half of these or fewer. So in one of two patterns there must be a stretch that has so many of the other's
    shingles and so few else, as long as what a passage of `least` has in common with another at the least.
    """
    size = np.array([len(x) for _, x in patterns])
    wide = max(least, int(size.max()))
    grid = np.zeros((len(patterns), wide), np.int64)  # of each pattern; 0 is a shingle that no other has
    values, ids = np.unique(np.concatenate([np.zeros(1, np.uint32), *(x for _, x in patterns)]), return_inverse=True)
    grid[np.arange(wide) < size[:, None]] = ids[1:]
    fresh = np.zeros(grid.size, bool)  # the first of equal ones
    fresh[np.unique(grid + np.arange(len(grid))[:, None] * len(values), return_index=True)[1]] = True
    loss = (fresh.reshape(grid.shape) | (grid == 0)).astype(np.float32)
    gain = np.float32((1 - similarity) / (2 * similarity))
    length = np.clip(np.ceil(similarity * fewest - 1e-9), 1, least).astype(np.int64)
    place = np.full(len(values), -1)

    def dense(hit: np.ndarray, loss: np.ndarray, length: np.ndarray) -> np.ndarray:
        total = np.zeros((len(hit), wide + 1), np.float32)
        np.cumsum(np.where(hit, gain, -loss), 1, out=total[:, 1:])
        start = np.arange(wide + 1) - length[:, None]
        before = np.take_along_axis(np.minimum.accumulate(total, 1), np.maximum(start, 0), 1)
        return ((total - before >= -1e-3) & (start >= 0)).any(1)

    def may(i: int, others: np.ndarray) -> np.ndarray:
        place[grid[i]] = np.arange(wide)
        place[0] = -1
        own, at = place[grid[i]], place[grid[others]]
        place[grid[i]] = -1
        out = dense(at >= 0, loss[others], np.full(len(others), length[i]))
        rest = np.flatnonzero(~out)
        if len(rest):
            there = np.zeros((len(rest), wide + 1), bool)
            there[np.arange(len(rest))[:, None], at[rest]] = True
            there[:, wide] = False
            out[rest] = dense(there[:, own], loss[i], length[others[rest]])
        return out

    return may


def _forest(maps: np.ndarray, half: np.ndarray, lost: np.ndarray, side: np.ndarray, alike: Callable[[int, int], bool], may: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Verified pairs that connect all that verified pairs connect, those with most in common first, and of one block before others.

    Every pair that may pass and is not yet connected is verified, so none over the threshold is skipped. Passages have as
    many shingles in common as the sum of their halves, of which a bitmap loses `lost` at the most. Where that was not
    enough once, `may` tells with which others it is worth a search.
    """
    n = len(maps)
    weight = np.zeros((n, n), np.int16)
    for i in range(0, n, 64):
        common = np.bitwise_count(maps[i : i + 64, None] & maps[None]).sum(2, dtype=np.int16)
        good = common + np.minimum(lost[i : i + 64, None], lost[None]) >= half[i : i + 64, None] + half[None] - 1e-9
        weight[i : i + 64] = np.where(good, np.maximum(common, 1) + 8 * (side[i : i + 64, None] == side[None]), 0)
    root, told, out = np.arange(n), np.zeros(n, bool), []
    np.fill_diagonal(weight, 0)
    while True:
        best = weight.argmax(1)
        ask = np.flatnonzero(weight[np.arange(n), best] > 0)
        if not len(ask):
            return out
        for i in ask.tolist():
            j = int(best[i])
            if root[i] != root[j] and weight[i, j]:
                if alike(i, j):
                    out.append((i, j))
                    root[root == root[j]] = root[i]
                    continue
                weight[i, j] = weight[j, i] = 0
                others = np.flatnonzero((weight[i] > 0) & (root != root[i]))
                if len(others) and not told[i]:
                    no = others[~may(i, others)]
                    weight[i, no] = weight[no, i] = 0
                    told[i] = True
        weight[root[:, None] == root[None]] = 0


def _lone(flat: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether no other owner has the value."""
    order = np.lexsort((owner, flat))
    v, o = flat[order], owner[order]
    head = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    size = np.diff(np.append(head, len(v)))
    out = np.empty(len(v), bool)
    out[order] = np.repeat(o[head] == o[head + size - 1], size)
    return out


def _joined(patterns: list[tuple[int, np.ndarray]], fewest: np.ndarray, side: np.ndarray, least: int, similarity: float) -> tuple[list[bool], list[tuple[int, int]]]:
    """Of patterns (place of the min-hash, shingles), whose passages have `fewest` different shingles at the least: whether its own copies share a passage, and verified pairs that connect all."""
    live = [np.unique(x[x != 0]) for _, x in patterns]
    maps, lost = _bitmaps(np.concatenate(live), np.concatenate(([0], np.cumsum([len(x) for x in live]))), 0)
    alike = lambda i, j: _alike(patterns[i][1], patterns[j][1], patterns[i][0], patterns[j][0], least, similarity)
    return [alike(i, i) for i in range(len(patterns))], _forest(maps, similarity / (1 + similarity) * fewest, -lost, side, alike, _hopeful(patterns, fewest, least, similarity))


def _groups(names: list[str], make: Callable[[pa.Table, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """make of all rows of whole groups, which are equal in `names` and follow each other, with first row and size of each."""

    def whole(table_: pa.Table) -> Iterator[pa.RecordBatch]:
        table_ = table_.combine_chunks()
        ids = [table_[n].to_numpy() for n in names]
        first = np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in ids], 0))))
        return make(table_, first, np.diff(np.append(first, table_.num_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = [*(rest or []), batch]
            if all(batch.column(batch.schema.get_field_index(n))[-1].equals(rest[0].column(batch.schema.get_field_index(n))[0]) for n in names):
                continue  # sorted: all of one group
            now = pa.Table.from_batches(rest)
            last = np.flatnonzero(np.any([x != x[-1] for x in (now[n].to_numpy() for n in names)], 0))
            k = int(last[-1]) + 1  # the last group may go on in the next batch
            yield from whole(now.slice(0, k))
            rest = now.slice(k).to_batches()
        if rest:
            yield from whole(pa.Table.from_batches(rest))

    return tn.tidy(run)


_WINDOW = "struct<doc_id: long, c: int, l: int, r: int>"
_KIND = pa.struct([("doc_id", pa.int64()), ("c", pa.int32()), ("l", pa.int32()), ("r", pa.int32())])


def _windows(table_: pa.Table, rows: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([table_[n].combine_chunks().take(pa.array(rows)).cast(k.type) for n, k in zip(("doc_id", "c", "l", "r"), _KIND, strict=True)], fields=list(_KIND))


def met(windows: DataFrame, least: int = LEAST, similarity: float = SIMILARITY) -> DataFrame:
    """(hash, a, b) of the pairs of windows of groups that one task takes."""
    names = ["key", "doc_id", "c", "l", "r", "hash", "reach", "fewest", "shingles"]

    def pairs(table_: pa.Table, first: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        doc, c, l, reach, fewest = (table_[n].to_numpy() for n in ("doc_id", "c", "l", "reach", "fewest"))  # noqa: E741
        shingles = table_["shingles"].to_pylist()
        cut = np.concatenate(([0], np.cumsum([len(x) // 4 for x in shingles])))
        flat = np.frombuffer(b"".join(shingles), np.uint32)
        at = c - np.maximum(l, c - reach + 1)
        small = size <= SMALL
        own = np.flatnonzero(np.repeat(small, size))
        found = [np.zeros((2, 0), np.int64)]
        if len(own):
            maps, need = _bitmaps(np.concatenate([flat[cut[i] : cut[i + 1]] for i in own]), np.concatenate(([0], np.cumsum(np.diff(cut)[own]))), least - _unshared(least, similarity))
            n = (np.repeat(first + size, size)[own] - own - 1).astype(np.int64)
            i = np.repeat(np.arange(len(own)), n)
            j = i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            for k in range(0, len(i), 1 << 16):
                x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                good = (np.bitwise_count(maps[x] & maps[y]).sum(1) >= np.maximum(need[x], need[y])) & (doc[own[x]] != doc[own[y]])
                found.append(np.stack((own[x[good]], own[y[good]])))
        for f, n in zip(first[~small].tolist(), size[~small].tolist(), strict=True):
            part = flat[cut[f] : cut[f + n]].copy()
            part[_lone(part, np.repeat(np.arange(n), np.diff(cut[f : f + n + 1])))] = 0
            classes: dict[tuple[int, bytes], list[int]] = {}
            for i in range(f, f + n):
                x = part[cut[i] - cut[f] : cut[i + 1] - cut[f]]
                live = np.flatnonzero(x)
                if len(live) and len(np.unique(x[live])) >= similarity * fewest[i] - 1e-9:
                    classes.setdefault((int(at[i] - live[0]), x[live[0] : live[-1] + 1].tobytes()), []).append(i)
            if classes:
                members = list(classes.values())
                itself, edges = _joined([(a, np.frombuffer(x, np.uint32)) for a, x in classes], np.array([min(fewest[m]) for m in members]), np.zeros(len(classes)), least, similarity)
                hub = {k: m[0] for k, (m, x) in enumerate(zip(members, itself, strict=True)) if x}
                for i, j in edges:
                    hub.setdefault(i, members[j][0])
                    hub.setdefault(j, members[i][0])
                out = [(members[i][0], members[j][0]) for i, j in edges] + [(i, h) for k, h in hub.items() for i in members[k]]
                found.append(np.array([x for x in out if doc[x[0]] != doc[x[1]]], np.int64).reshape(-1, 2).T)
        both = np.concatenate(found, 1)
        if both.shape[1]:
            i, j = np.where(doc[both[0]] > doc[both[1]], both, both[::-1])
            yield pa.RecordBatch.from_arrays([table_["hash"].combine_chunks().take(pa.array(i)), _windows(table_, i), _windows(table_, j)], ["hash", "a", "b"])

    dealt = windows.select(*names).repartition("key").sortWithinPartitions("key", "doc_id", "c")
    return dealt.mapInArrow(_groups(["key"], pairs), f"hash int, a {_WINDOW}, b {_WINDOW}")


def _parts(n: np.ndarray, block: int) -> np.ndarray:
    """Parts of the shingles of groups of n windows: one task sorts as many as 8 blocks have, some MB, since each window has a row in every part."""
    return np.ceil(n / (8 * block)).astype(_U)


def met_widely(windows: DataFrame, least: int = LEAST, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """The same of groups that many tasks share.

    Shingles that one window of a group alone has are told by parts of the shingles. Windows with equal others, at equal
    places around c, are a class, for which one is compared, in blocks of classes.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, l, reach, n = (batch.column(batch.schema.get_field_index(x)).to_numpy().astype(np.int64) for x in ("c", "l", "reach", "n"))  # noqa: E741
            shingles = batch.column(batch.schema.get_field_index("shingles")).to_pylist()
            size = np.array([len(x) // 4 for x in shingles])
            row = np.repeat(np.arange(len(size)), size)
            flat = np.frombuffer(b"".join(shingles), np.uint32)
            where = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.maximum(l - c, 1 - reach)[row]
            part = tn.mix(flat.astype(_U)) % _parts(n, block)[row]
            order = np.lexsort((part, row))
            row, part, value = row[order], part[order].astype(np.int32), ((where + (1 << 20)) << 32 | flat.astype(np.int64))[order]
            head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (part[1:] != part[:-1]))))
            lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(row)).astype(np.int32)), pa.array(value))
            key, section = (batch.column(batch.schema.get_field_index(x)).take(pa.array(row[head])) for x in ("key", "section"))
            yield pa.RecordBatch.from_arrays([key, pa.array(part[head]), section, lists], ["key", "part", "section", "its"])

    def shared(table_: pa.Table, first: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        lists = table_["its"].combine_chunks()
        n = lists.value_lengths().to_numpy()
        value = lists.flatten().to_numpy()
        row, group = np.repeat(np.arange(len(n)), n), np.repeat(np.repeat(np.arange(len(first)), size), n)
        keep = ~_lone(group << 32 | (value & 0xFFFFFFFF), row)
        cut = np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=len(n))))).astype(np.int32)
        out = pa.RecordBatch.from_arrays([table_["key"].combine_chunks(), table_["section"].combine_chunks(), pa.ListArray.from_arrays(pa.array(cut), pa.array(value[keep]))], ["key", "section", "its"])
        yield out.filter(pa.array(np.diff(cut) > 0))

    dealt = windows.select("key", "section", "n", "c", "l", "reach", "shingles").mapInArrow(tn.tidy(deal), "key long, part int, section long, its array<long>")
    dealt = dealt.repartition("key", "part").sortWithinPartitions("key", "part")
    its = dealt.mapInArrow(_groups(["key", "part"], shared), "key long, section long, its array<long>")
    its = its.groupBy("key", "section").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("its")))).alias("its"))
    window = F.struct("doc_id", "c", "l", "r")
    members = its.join(windows.select("key", "section", "hash", "fewest", window.alias("own")), ["key", "section"])
    # a passage has in common with another that share of its different shingles at the least
    members = members.where(F.size(F.array_distinct(F.transform("its", lambda x: x.bitwiseAND(0xFFFFFFFF)))) >= similarity * F.col("fewest") - 1e-9)
    members = _settled(members.withColumn("class", F.xxhash64("its")))
    classes = _settled(members.groupBy("key", "class").agg(F.min(F.struct("own", "hash", "its")).alias("w"), F.min("fewest").alias("fewest")).select("key", "class", "w.*", "fewest"))
    blocks = classes.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    met_ = classes.join(blocks, "key").withColumn("mine", F.pmod("class", F.col("blocks")).cast("int"))
    met_ = met_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met_ = met_.select("key", F.least("mine", "other").alias("left"), F.greatest("mine", "other").alias("right"), "mine", "class", "hash", "own.*", "fewest", "its")

    def edges(table_: pa.Table, first: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        left, right, side, fewest = (table_[n].to_numpy() for n in ("left", "right", "mine", "fewest"))
        lists = table_["its"].combine_chunks()
        cut = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        value = lists.flatten().to_numpy()
        where, flat = (value >> 32) - (1 << 20), (value & 0xFFFFFFFF).astype(np.uint32)
        found = []
        for f, n in zip(first.tolist(), size.tolist(), strict=True):
            patterns = []
            for i in range(f, f + n):
                w = where[cut[i] : cut[i + 1]]
                x = np.zeros(w[-1] - w[0] + 1, np.uint32)
                x[w - w[0]] = flat[cut[i] : cut[i + 1]]
                patterns.append((int(-w[0]), x))
            itself, joined = _joined(patterns, fewest[f : f + n], side[f : f + n], least, similarity)
            if left[f] != right[f]:
                joined = [(i, j) for i, j in joined if side[f + i] != side[f + j]]  # the others are found where the block meets itself
            else:
                joined += [(i, i) for i in range(n) if itself[i]]
            found += [(f + i, f + j) for i, j in joined]
        if found:
            i, j = np.array(found).T
            of = lambda name, rows: table_[name].combine_chunks().take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([of("key", i), of("hash", i), of("class", i), of("class", j), _windows(table_, i), _windows(table_, j)], ["key", "hash", "x", "y", "a", "b"])

    # comparing takes long for its bytes, so its partitions are not to be merged
    parts = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met_ = met_.repartition(parts, "key", "left", "right").sortWithinPartitions("key", "left", "right", "class")
    joined = _settled(met_.mapInArrow(_groups(["key", "left", "right"], edges), f"key long, hash int, x long, y long, a {_WINDOW}, b {_WINDOW}"))
    # all of a class hang together by its first window, or else by one of another class
    one = lambda c, w: joined.select("key", F.col(c).alias("class"), F.struct((F.col("x") != F.col("y")).alias("far"), F.col(w).alias("hub")).alias("h"))
    hubs = one("x", "b").unionByName(one("y", "a")).groupBy("key", "class").agg(F.min("h").alias("h"))
    pairs = members.join(hubs, ["key", "class"]).select("hash", F.col("own").alias("a"), F.col("h.hub").alias("b")).unionByName(joined.select("hash", "a", "b"))
    swap = F.col("a.doc_id") < F.col("b.doc_id")
    return pairs.where("a.doc_id != b.doc_id").select("hash", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))


def candidates(docs: DataFrame, hashes: int = HASHES, least: int = LEAST, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, other_id, shift, start, end, other_start, other_end, hashes): stretches of shingles to verify."""
    rows = window_rows(docs, hashes, least)
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key")
    shared = _settled(shared)
    kept = _settled(rows.join(shared, "key").select("key", "hash", "doc_id", "c", "l", "r", "section"), shared)
    window = F.struct("doc_id", "c", "l", "r")
    ends = _settled(kept.groupBy("key", "section").agg(F.first("hash").alias("hash"), F.min(window).alias("first"), F.max(window).alias("last")))
    # windows with equal sections share them: each is paired with the first and the last
    equal = kept.select("key", "section", "hash", window.alias("own")).join(ends.where("first.doc_id < last.doc_id").drop("hash"), ["key", "section"])
    # the window with the greater id comes first
    both = F.array(F.struct(F.col("own").alias("a"), F.col("first").alias("b")), F.struct(F.col("last").alias("a"), F.col("own").alias("b")))
    pairs = equal.select("hash", F.explode(F.filter(both, lambda p: p["a"]["doc_id"] > p["b"]["doc_id"])).alias("p")).select("hash", "p.a", "p.b")
    # different sections meet
    groups = ends.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    reach = F.when(F.col("n") > SMALL, _reach(least, similarity)).otherwise(least).cast("int").alias("reach")
    wanted = ends.join(groups, "key").select("first.doc_id", F.struct("key", "hash", "section", "n", reach, "first.c", "first.l", "first.r").alias("w")).groupBy("doc_id").agg(F.collect_list("w").alias("windows"))
    inside = _settled(sections(docs, wanted, least))
    pairs = pairs.unionByName(met(inside.where(F.col("n") <= block), least, similarity))
    pairs = pairs.unionByName(met_widely(inside.where(F.col("n") > block), least, similarity, block))
    # insertions may shift a passage on either side of c
    slack, shift = F.lit(_unshared(least, similarity)), F.col("shift")
    pairs = pairs.withColumn("shift", F.col("a.c") - F.col("b.c")).select(
        F.col("a.doc_id").alias("doc_id"), F.col("b.doc_id").alias("other_id"), "shift", "hash",
        F.greatest("a.l", F.col("b.l") + shift - slack).alias("start"), (F.least("a.r", F.col("b.r") + shift + slack) + 1).alias("end"),
        F.greatest("b.l", F.col("a.l") - shift - slack).alias("other_start"), (F.least("b.r", F.col("a.r") - shift + slack) + 1).alias("other_end"),
    )
    edges = [F.min(c).alias(c) if c.endswith("start") else F.max(c).alias(c) for c in ("start", "end", "other_start", "other_end")]
    found = pairs.groupBy("doc_id", "other_id", "shift").agg(*edges, F.expr("bit_count(bit_or(shiftleft(1, hash)))").alias("hashes"))
    return _settled(found, kept, ends, inside)


def stretches(docs: DataFrame, wanted: DataFrame, at_once: int = 1024) -> DataFrame:
    """wanted (doc_id, start, end), distinct, with `piece`, the text of the words under shingles start to end; texts of an id that end before it have no row.

    A text goes to its spans once, or once for each `at_once` of them, and all are cut in one pass.
    """
    many = wanted.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / at_once).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("start", "end"), F.col("parts")).alias("part")
    lists = wanted.join(many, "doc_id").groupBy("doc_id", part).agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for a, b, data, offsets in tn.pieces(batch.column(2)):
                    lists_ = batch.column(1).slice(a, b - a)
                    doc = np.repeat(np.arange(b - a), lists_.value_lengths().to_numpy())
                    spans = pa.RecordBatch.from_struct_array(lists_.flatten())
                    start, end = (spans.column(k).to_numpy() for k in (0, 1))
                    starts, ends, docs_ = tn.words(data, offsets)
                    edges = np.concatenate(([0], np.cumsum(tn.counts(docs_, b - a))))
                    first, last = edges[doc] + start, edges[doc] + end + WORDS - 2
                    live = np.flatnonzero(last < edges[doc + 1])
                    lo, hi = starts[first[live]], ends[last[live]]
                    cut = np.concatenate(([0], np.cumsum(hi - lo)))
                    flat = data[np.arange(cut[-1]) + np.repeat(lo - cut[:-1], hi - lo)]
                    text = pa.Array.from_buffers(pa.string(), len(live), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(flat)])
                    ids = batch.column(0).slice(a, b - a).take(pa.array(doc[live]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(start[live]), pa.array(end[live]), text], ["doc_id", "start", "end", "piece"])

    return lists.join(docs, "doc_id").select("doc_id", "spans", "text").mapInArrow(tn.tidy(run), "doc_id long, start int, end int, piece string")


def shared_spans(a: np.ndarray, b: np.ndarray, least: int = LEAST, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """(start, end, other start, other end, similarity) of passages shared by two sequences of shingles that are about aligned."""
    if len(a) < least or len(b) < least:
        return []
    hit, place = _nearest(a, b)
    total = np.zeros(len(hit) + 1, np.int64)
    np.cumsum(hit, out=total[1:])
    # equal lengths and similarity s share 2s / (1 + s) of their shingles
    dense = total[least:] - total[:-least] >= _shared(least, similarity)
    if not dense.any():
        return _chained(a, b, hit, place, least, similarity)
    edge = np.diff(np.concatenate(([0], dense.astype(np.int8), [0])))
    out = []
    for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + least - 1, strict=True):
        found, rest = [], [(s, e)]
        while rest:  # a part that has too much else in between is cut at its greatest jump
            x, y = rest.pop()
            if y - x < least:
                continue
            if span := _span(a, b, x, y, hit, place, least, similarity):
                found.append(span)
                continue
            at = np.flatnonzero(hit[x:y]) + x
            jump = np.abs(np.diff(place[at]) - 1) + np.diff(at) - 1
            if jump.any():
                k = int(np.argmax(jump))
                rest += [(int(at[k + 1]), int(at[-1]) + 1), (int(at[0]), int(at[k]) + 1)]
        if not found and e - s > least:  # or else its densest
            k = s + int(np.argmax(total[s + least : e + 1] - total[s : e + 1 - least]))
            found = [_span(a, b, k, k + least, hit, place, least, similarity)]
        out += filter(None, found)
    return out or _chained(a, b, hit, place, least, similarity)


def _chained(a, b, hit, place, least, similarity):
    """The longest passage whose common shingles follow each other in both sequences, wherever the others lie."""
    at = np.flatnonzero(hit)
    if len(at) < _shared(least, similarity):
        return []
    there = place[at]
    if (there[1:] <= there[:-1]).any():
        keep = _increasing(there)
        at, there = at[keep], there[keep]
    n, best = len(at), None
    # n shingles in common of x and y are similar enough if (1 + similarity) * n >= similarity * (x + y), so from p to q if the score of q is not far below that of p
    score = (1 + similarity) * np.arange(n) - similarity * (at + there)
    low, most = np.minimum.accumulate(score), score + 1 - similarity + 1e-9
    last = np.minimum(np.searchsorted(at, at - least + 1, "right"), np.searchsorted(there, there - least + 1, "right")) - 1
    ends = np.flatnonzero((last >= 0) & (low[np.maximum(last, 0)] <= most))
    if len(ends):
        first = np.searchsorted(-low, -most[ends], "left")
        k = np.argmax(at[ends] - at[first])
        best = int(first[k]), int(ends[k])
    few = _shared(least, similarity) - 1  # steps between the fewest of them, which the longest passage that they may fill has within it
    if not best and (n <= few or (at[few:] - at[: n - few] + there[few:] - there[: n - few]).min() + 2 > (1 + similarity) / similarity * (least - 1) + 1e-6):
        return []
    for m in range(min(n, least - 1), _shared(least, similarity) - 1, -1):  # those that others must fill up to `least`
        if best:
            break
        p, q = np.arange(n - m + 1), np.arange(m - 1, n)
        size = np.maximum(at[q] - at[p] + 1, least) + np.maximum(there[q] - there[p] + 1, least)
        good = np.flatnonzero((1 + similarity) * m >= similarity * size - 1e-9)
        if len(good):
            best = int(good[0]), int(good[0]) + m - 1
    if not best:
        return []
    s, e, s2, e2 = (int(x) for i in (at, there) for x in (i[best[0]], i[best[1]] + 1))
    s, s2 = (min(x, max(0, y - least)) for x, y in ((s, e), (s2, e2)))
    e, e2 = max(e, s + least), max(e2, s2 + least)
    likeness = _likeness(a[s:e], b[s2:e2])
    return [(s, e, s2, e2, likeness)] if likeness >= similarity - 1e-9 else []


def _likeness(x: np.ndarray, y: np.ndarray) -> float:
    x, y = _distinct(x), _distinct(y)
    z = np.sort(np.concatenate((x, y)))
    both = int(np.count_nonzero(z[1:] == z[:-1]))
    return both / (len(x) + len(y) - both)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = x[1:] != x[:-1]
    return x if new.all() else np.concatenate((x[:1], x[1:][new]))


def _increasing(x: np.ndarray) -> np.ndarray:
    """Positions of a longest increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = []
    for i, v in enumerate(x.tolist()):
        k = bisect_left(tails, v)
        before.append(ends[k - 1] if k else -1)
        tails[k : k + 1], ends[k : k + 1] = [v], [i]
    out, i = [], ends[-1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1])


def common_spans(a: np.ndarray, b: np.ndarray, least: int = LEAST, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """shared_spans from whichever side has them, or the whole of both."""
    out = shared_spans(a, b, least, similarity) or [(s, e, s2, e2, x) for s2, e2, s, e, x in shared_spans(b, a, least, similarity)]
    if not out and min(len(a), len(b)) >= least and (x := _likeness(a, b)) >= similarity - 1e-9:
        out = [(0, len(a), 0, len(b), x)]
    return out


def _nearest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether b has each value of a, and where: of several places the nearest to the value's own."""
    order = np.argsort(b)
    known = b[order]
    new = known[1:] != known[:-1]
    if new.all():  # one place each
        rank = np.minimum(np.searchsorted(known, a), len(known) - 1)
        return known[rank] == a, order[rank]
    known = np.concatenate((known[:1], known[1:][new]))
    rank = np.minimum(np.searchsorted(known, a), len(known) - 1)
    hit = known[rank] == a
    n = len(a) + len(b)
    sorted_ = np.sort(np.searchsorted(known, b) * n + np.arange(len(b)))
    after = np.searchsorted(sorted_, rank * n + np.arange(len(a)))
    best = np.full(len(a), n)
    place = np.zeros(len(a), np.int64)
    for at in (np.maximum(after - 1, 0), np.minimum(after, len(b) - 1)):
        there, far = sorted_[at] % n, np.abs(sorted_[at] % n - np.arange(len(a)))
        better = (sorted_[at] // n == rank) & (far < best)
        best, place = np.where(better, far, best), np.where(better, there, place)
    return hit, place


def _span(a, b, s, e, hit, place, least, similarity):
    at = np.flatnonzero(hit[s:e]) + s
    if not len(at):
        return None
    if at[-1] + 1 - at[0] >= least:
        s, e = at[0], at[-1] + 1
    shift = place[at] - at
    near = place[at][np.abs(shift - np.median(shift)) <= least]
    if not len(near):
        return None
    s2, e2 = int(near.min()), int(near.max()) + 1
    likeness = _likeness(a[s:e], b[s2:e2])
    return (int(s), int(e), s2, e2, likeness) if likeness >= similarity - 1e-9 else None


def _shingles(texts: pa.Array) -> Iterator[np.ndarray]:
    for a, b, data, offsets in tn.pieces(texts):
        starts, ends, docs = tn.words(data, offsets)
        s, rows = tn.shingles(tn.word_hashes(data, starts, ends), docs, WORDS)
        cut = np.searchsorted(rows, np.arange(b - a + 1))
        yield from (s[cut[i] : cut[i + 1]] for i in range(b - a))


def _plain_spans(left: list[np.ndarray], right: list[np.ndarray], least: int, similarity: float) -> list[list[tuple[int, int, int, int, float]] | None]:
    """common_spans of each left and right, all at once, where no value repeats and one dense stretch lies at one shift; else None."""
    n = len(left)
    na, nb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    out: list = [None] * n
    a, b = np.concatenate(left), np.concatenate(right)
    if not len(a) or not len(b):
        return out
    ra, rb = np.repeat(np.arange(n), na), np.repeat(np.arange(n), nb)
    pa_, pb = np.arange(len(a)) - np.repeat(np.cumsum(na) - na, na), np.arange(len(b)) - np.repeat(np.cumsum(nb) - nb, nb)
    row, value, side = np.concatenate((ra, rb)), np.concatenate((a, b)), np.repeat((False, True), (len(a), len(b)))
    order = np.lexsort((side, value, row))
    row, value, side = row[order], value[order], side[order]
    same = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
    plain = nb >= least
    plain[row[1:][same & (side[1:] == side[:-1])]] = False
    met_ = np.flatnonzero(same & ~side[:-1] & side[1:])
    hit, place = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
    at = order[met_]
    hit[at], place[at] = True, pb[order[met_ + 1] - len(a)]
    total = np.concatenate(([0], np.cumsum(hit)))
    # the first and last window that are dense, and whether all between are
    first = np.flatnonzero(pa_ + least <= np.repeat(na, na))
    first = first[total[first + least] - total[first] >= _shared(least, similarity)]
    if not len(first):
        return out
    own = ra[first]
    head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    tail = np.append(head[1:], len(first)) - 1
    one = first[tail] - first[head] == tail - head
    head, tail = head[one & plain[own[head]]], tail[one & plain[own[head]]]
    # from the first to the last hit of the stretch, if these are `least` apart
    hits = np.flatnonzero(hit)
    s, e = first[head], first[tail] + least
    x, y = np.searchsorted(hits, s), np.searchsorted(hits, e) - 1
    wide = hits[y] + 1 - hits[x] >= least
    lo, hi = np.where(wide, hits[x], s), np.where(wide, hits[y] + 1, e)
    shift = place[hits] - pa_[hits]
    turn = np.concatenate(([0], np.cumsum(shift[1:] != shift[:-1])))
    common = y - x + 1
    start, end = place[hits[x]], place[hits[y]] + 1
    likeness = common / ((hi - lo) + (end - start) - common)
    good = (turn[x] == turn[y]) & (likeness >= similarity - 1e-9)
    for i, *span in zip(own[head][good].tolist(), pa_[lo][good].tolist(), (pa_[hi - 1] + 1)[good].tolist(), start[good].tolist(), end[good].tolist(), likeness[good].tolist(), strict=True):
        out[i] = [tuple(span)]
    return out


def passages(docs: DataFrame, hashes: int = HASHES, least: int = LEAST, similarity: float = SIMILARITY, block: int = BLOCK, together: int = 64) -> DataFrame:
    """together: candidates of one stretch of the lesser document that one task verifies."""
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = candidates(docs, hashes, least, similarity, block)
    found = found.select("doc_id", "other_id", "start", "end", "other_start", "other_end")
    # one side's texts are fetched, then the other's, and shuffled once each; those of pairs are the most that the disk has to hold
    left, right = ["doc_id", "start", "end"], ["other_id", "other_start", "other_end"]
    wanted = _settled(found.groupBy(*right).agg(F.ceil(F.count(F.lit(1)) / together).cast("int").alias("parts")))
    spans = wanted.select(*(F.col(r).alias(c) for r, c in zip(right, left, strict=True)))
    pieces = stretches(docs, spans).select(*(F.col(c).alias(r) for r, c in zip(right, left, strict=True)), F.col("piece").alias("b"))
    pieces = _settled(pieces.join(wanted, right))
    part = F.pmod(F.xxhash64(*left), F.col("parts")).cast("int").alias("part")
    dealt = found.join(wanted, right).select(*left, *right, part)
    dealt = _settled(dealt.join(stretches(docs, found.select(*left).distinct()).withColumnRenamed("piece", "a"), left), found, wanted)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "end", "other_id", "other_start", "other_end", "similarity"]
        kinds = [pa.int64()] * 6 + [pa.float64()]
        for batch in batches:
            out = []
            ids, others, starts, starts2 = (batch.column(k).to_pylist() for k in range(4))
            left, right = list(_shingles(batch.column(4))), list(_shingles(batch.column(5)))
            for k in range(0, len(left), 256):
                many = _plain_spans(left[k : k + 256], right[k : k + 256], least, similarity)
                for i, spans in enumerate(many, k):
                    for s, e, s2, e2, likeness in common_spans(left[i], right[i], least, similarity) if spans is None else spans:
                        o, o2 = starts[i], starts2[i]
                        out.append((ids[i], o + s, o + e + WORDS - 1, others[i], o2 + s2, o2 + e2 + WORDS - 1, likeness))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, start long, end long, other_id long, other_start long, other_end long, similarity double"
    # verifying takes long for its bytes, so its partitions are not to be merged
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = pieces.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met_ = dealt.repartition(n, *right, "part").join(split.repartition(n, *right, "part"), [*right, "part"])
    rows = met_.select("doc_id", "other_id", "start", "other_start", "a", "b").mapInArrow(tn.tidy(verify), schema).dropDuplicates(["doc_id", "start", "end", "other_id", "other_start", "other_end"])
    rows = _settled(rows, dealt, pieces)
    group = components(rows.select(F.col("doc_id").alias("a"), F.col("other_id").alias("b"))).select(F.col("node").alias("doc_id"), F.col("component").alias("group_id"))
    return rows.join(group, "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
