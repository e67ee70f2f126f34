"""Packing: minimum bin slack over a histogram of lengths.

Every document becomes its token ids and an end id, cut into pieces of at most a window. A
task takes pieces until it holds BUFFER tokens, packs them into full windows and goes on with
what is left, less than a window, and new pieces; at its end the rest is packed too. So each
task packs its own rows in one pass, in bounded memory, and a lost task is simply run again.
Only the histogram of the held lengths is planned:

1. A bitset dynamic programme over the remaining multiset (counts split into powers of two)
   finds the subset sum closest to the window, and backtracking gives how many pieces of each
   length it takes.
2. That filling is repeated as often as the remaining counts allow, so each step uses up a
   length and the steps are few.
3. If it leaves slack, one more piece is cut so that its first part fills the window exactly;
   its second part goes back to the multiset.
4. At the task's end, when less than a window is left, the window becomes the largest power of
   two that is not above it. So no sequence needs padding, and a task ends in 12 short
   sequences at the most.

Sequences are numbered by task (its partition's number, times 2**32) and in order, so a rerun
over equally partitioned input gives the same ones.

Edge cases: a null or empty text is the end id alone; a very long text is tokenized whole and
cut into windows; a null doc_id packs like others; repeated rows are packed once each; only
doc_id and text are read, so other columns, whatever their names, do no harm; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import textnum as tn
from docquarry.llm.common import table

WINDOW = 4096
END = 2
#: Words whose ids a worker keeps, and bytes of text it looks up at a time.
CACHE, PIECE = 1_500_000, 3 << 19
#: Tokens that a task holds before it packs them.
BUFFER = 1 << 22

# ---------------------------------------------------------------- planning


@dataclass
class Share:
    """Pieces number first .. first + count - 1 of an original length, from token `start` of the piece on."""

    origin: int
    first: int
    count: int
    start: int


@dataclass
class Plan:
    """Rows (origin, first, count, start, keep, sequence, skip, per, offset), and the shares that are left.

    Pieces number first + k of length origin give `keep` tokens from `start` on; sequence +
    (skip + k) // per gets them, at offset + (skip + k) % per * keep.
    """

    rows: list[tuple[int, ...]] = field(default_factory=list)
    rest: list[Share] = field(default_factory=list)
    sequences: int = 0


def best_filling(counts: dict[int, int], window: int) -> dict[int, int]:
    """The sub-multiset of lengths with the largest sum not above the window, long lengths first."""
    mask = (1 << (window + 1)) - 1
    reach, steps = 1, []
    for length in sorted((n for n in counts if n <= window), reverse=True):
        left, k = min(counts[length], window // length), 1
        while left:
            take = min(k, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            if reach >> window:
                left = 0
                break
            left -= take
            k *= 2
        if reach >> window:
            break
    total = reach.bit_length() - 1
    filling: dict[int, int] = defaultdict(int)
    for before, length, take in reversed(steps):
        if not (before >> total) & 1:
            filling[length] += take
            total -= length * take
    return dict(filling)


def plan(histogram: dict[int, int], window: int = WINDOW, last: bool = True) -> Plan:
    """Fill windows from the multiset of lengths; what is less than a window stays, unless this is the last plan."""
    out = Plan()
    pools: dict[int, list[Share]] = {n: [Share(n, 0, c, 0)] for n, c in histogram.items() if c > 0}
    counts = {n: c for n, c in histogram.items() if c > 0}
    total = sum(n * c for n, c in counts.items())

    def use(length: int, per: int, repeats: int, offset: int, keep: int) -> None:
        """Put `per` pieces a sequence into `repeats` sequences, their first `keep` tokens each; what is cut off goes back."""
        need, skip = per * repeats, 0
        counts[length] -= need
        if not counts[length]:
            del counts[length]
        pool = pools[length]
        while need:
            share = pool[-1]
            n = min(need, share.count)
            out.rows.append((share.origin, share.first, n, share.start, keep, out.sequences, skip, per, offset))
            if keep < length:
                pools.setdefault(length - keep, []).append(Share(share.origin, share.first, n, share.start + keep))
                counts[length - keep] = counts.get(length - keep, 0) + n
            share.first, share.count, need, skip = share.first + n, share.count - n, need - n, skip + n
            if not share.count:
                pool.pop()

    while total >= (1 if last else window):
        size = window if total >= window else 1 << (total.bit_length() - 1)
        filling = best_filling(counts, size)
        slack = size - sum(n * k for n, k in filling.items())
        cut = 0
        if slack:
            # a piece that is longer than the slack; there is one, as at least `size` tokens are left
            spare = [n for n, c in counts.items() if n > slack and c > filling.get(n, 0)]
            cut = max(spare)
        most = total // size
        repeats = min([counts[n] // (k + (n == cut)) for n, k in filling.items()] + ([counts[cut] // (1 + filling.get(cut, 0))] if cut else []) + [max(1, most)])
        offset = 0
        for n, k in sorted(filling.items(), reverse=True):
            use(n, k, repeats, offset, n)
            offset += n * k
        if cut:
            use(cut, 1, repeats, offset, slack)
        out.sequences += repeats
        total -= size * repeats
    out.rest = [share for pool in pools.values() for share in pool if share.count]
    return out


# ---------------------------------------------------------------- tokens

_tokenizers: dict[str, Words] = {}

_STOP = np.zeros(256, bool)
_STOP[[44, 46]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True


def _lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes in lower case up to U+00FF, and which of them belong to letters up to there."""
    low, letter = tn.LOWER[data], _LETTER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    value = data[second]
    signs = (value == 0x97) | (value == 0xB7)  # the signs of multiplication and division are no letters
    low[second] = np.where((value < 0x9F) & ~signs, value + 32, value)
    letter[second] = ~signs
    letter[second - 1] = ~signs
    return low, letter


class Words:
    """Ids of words, found once by a worker and kept in sorted arrays under the words' hashes."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes among the keys, and whether they are there."""
        at = np.searchsorted(self.keys, hashes)
        if not len(self.keys):
            return at, np.zeros(len(hashes), bool)
        return at, self.keys[np.minimum(at, len(self.keys) - 1)] == hashes

    def learn(self, hashes: np.ndarray, words: list[str], simple: np.ndarray) -> None:
        """New words with their sorted, distinct hashes; simple ones are one run of letters each to the tokenizer, so many go in one call."""
        ids: list = [None] * len(words)
        rest = np.flatnonzero(~simple).tolist()
        for i, e in zip(rest, self.tokenizer.encode_batch([words[i] for i in rest], add_special_tokens=False), strict=True):
            ids[i] = e.ids
        easy = np.flatnonzero(simple).tolist()
        for k in range(0, len(easy), 1000):
            some = easy[k : k + 1000]
            found = self.tokenizer.encode(" ".join([words[i] for i in some]), add_special_tokens=False)
            flat = found.ids
            cut = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(some) + 1)).tolist()
            for i, a, b in zip(some, cut[:-1], cut[1:], strict=True):
                ids[i] = flat[a:b]
        size = np.array([len(x) for x in ids], np.int64)
        place, _ = self.find(hashes)  # the hashes are sorted, and so stay the keys
        self.keys = np.insert(self.keys, place, hashes)
        self.at = np.insert(self.at, place, len(self.pool) + np.cumsum(size) - size)
        self.size = np.insert(self.size, place, size)
        self.pool = np.concatenate((self.pool, np.array([x for y in ids for x in y], np.uint32)))


def token_ids(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """Each text's ids without special ones; null counts as empty.

    The tokenizer drops white space, joins nothing across it, and takes letters and the stops
    after them apart, without regard to case. So a text's ids are those of its parts in turn,
    and the parts of a whole batch are looked up at once. Texts that may hold special tokens
    go to the tokenizer as they are.
    """
    known = _tokenizers.get(path) or _tokenizers.setdefault(path, Words(path))
    for a, b, data, offsets in tn.pieces(texts, PIECE):
        if len(known.keys) > CACHE:
            known.forget()
        low, letter = _lowered(data)
        starts, ends, docs = tn.words(low, offsets)
        last = np.maximum.accumulate(np.where(_STOP[low], -1, np.arange(len(low))))  # last byte so far that is no stop
        core = np.maximum(last[ends - 1] + 1, starts) if len(ends) else ends
        other = np.concatenate(([0], np.cumsum(~letter)))
        simple = (core > starts) & (other[core] == other[starts])
        core = np.where(simple, core, ends)
        parts = 1 + (core < ends)
        first = np.cumsum(parts) - parts
        total = int(parts.sum())
        lo, hi, plain = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, bool)
        lo[first], hi[first], plain[first] = starts, core, simple
        two = np.flatnonzero(parts == 2)
        lo[first[two] + 1], hi[first[two] + 1] = core[two], ends[two]
        hashes, sample, which = np.unique(tn.word_hashes(low, lo, hi), return_index=True, return_inverse=True)
        _, there = known.find(hashes)
        if not there.all():
            new = sample[~there]
            raw = low.tobytes()
            known.learn(hashes[~there], [raw[x:y].decode() for x, y in zip(lo[new].tolist(), hi[new].tolist(), strict=True)], plain[new])
        at, _ = known.find(hashes)
        size, begin = known.size[at][which], known.at[at][which]
        flat = known.pool[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
        cut = np.concatenate(([0], np.cumsum(np.bincount(np.repeat(docs, parts), size, b - a)))).astype(np.int64)
        special = set((np.searchsorted(offsets, np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)), "right") - 1).tolist())
        for i in range(b - a):
            if i in special:
                yield np.array(known.tokenizer.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            else:
                yield flat[cut[i] : cut[i + 1]]


# ---------------------------------------------------------------- packing

#: doc_id, first token in the document, tokens of the document, ids.
Piece = tuple[int | None, int, int, np.ndarray]


def fill(held: list[Piece], last: bool, window: int = WINDOW) -> tuple[list[tuple], list[Piece], int]:
    """Placed pieces (doc_id, start, total, ids, sequence, offset), the pieces that are left, and the number of sequences."""
    by_length: dict[int, list[Piece]] = defaultdict(list)
    for piece in held:
        by_length[len(piece[3])].append(piece)
    found = plan({n: len(x) for n, x in by_length.items()}, window, last)
    out = []
    for origin, first, count, start, keep, sequence, skip, per, offset in found.rows:
        for k, (doc, at, total, ids) in enumerate(by_length[origin][first : first + count], skip):
            out.append((doc, at + start, total, ids[start : start + keep], sequence + k // per, offset + k % per * keep))
    rest = [(doc, at + x.start, total, ids[x.start :]) for x in found.rest for doc, at, total, ids in by_length[x.origin][x.first : x.first + x.count]]
    return out, rest, found.sequences


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, buffer: int = BUFFER) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                for doc, ids in zip(some.column(0).to_pylist(), token_ids(some.column(1), path), strict=True):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for start in range(0, len(ids), window):
                        yield doc, start, len(ids), ids[start : start + window]

    def rows(placed: list[tuple], number: int) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(placed), 4096):
            doc, start, total, ids, sequence, offset = zip(*placed[k : k + 4096], strict=True)
            size = np.array([len(x) for x in ids])
            cut = pa.py_buffer(np.concatenate(([0], np.cumsum(size * 4))).astype(np.int32))
            flat = pa.Array.from_buffers(pa.binary(), len(ids), [None, cut, pa.py_buffer(np.concatenate(ids))])
            longs = [pa.array(x, pa.int64()) for x in (doc, start, size, total, np.array(sequence) + number, offset)]
            yield pa.RecordBatch.from_arrays([*longs[:3], flat, *longs[3:]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[Piece] = []
        tokens = 0
        for piece in pieces(batches):
            held.append(piece)
            tokens += len(piece[3])
            if tokens >= buffer:
                placed, held, n = fill(held, False, window)
                yield from rows(placed, number)
                number, tokens = number + n, sum(len(x[3]) for x in held)
        placed, _, _ = fill(held, True, window)
        yield from rows(placed, number)

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tn.tidy(run), schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(packed: DataFrame) -> DataFrame:
    """Without the ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents"), path or default_tokenizer()))
