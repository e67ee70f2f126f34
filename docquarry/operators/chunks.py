"""Blocks to chunks: fixed windows as a plan, section and table packing document by document."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import count_tokens, first_tokens, header, word_tokens

#: Budgets in tokens: a chunk's body, its overlap, its header, all of it, and what a chunk has before a topic may end it.
BODY, OVERLAP, HEADER, WHOLE, SOFT = 450, 75, 60, 512, 200
# Fixed value: where sentences end.
SENTENCE_END = re.compile(r'(?<=[.!?;])\s+(?=["“(]?[A-Z0-9])')

PACKED = "doc_id long, n int, part int, body string, first_block int, last_block int"
#: What a chunk needs of each block it touches, carried along by blocks that have all of it.
TOUCHED = ("block_seq", "page", "page_seq", "section", "item")
AT = "at array<struct<block_seq int, page string, page_seq int, section string, item string>>"


class WordTokenizer:
    """The default tokenizer: a token is a run of characters that are not white space. Any object with these two methods can take its place."""

    _token = re.compile(r"\S+")

    def count(self, text: str) -> int:
        return len(self._token.findall(text))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Start and end of each token that starts a word, so cuts never split a word."""
        return [m.span() for m in self._token.finditer(text)]


def window_starts(n: Column, size: int = BODY, overlap: int = OVERLAP) -> Column:
    """First tokens of the windows over n tokens; the last window is the first that reaches the end."""
    step = size - overlap
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def windows(docs: DataFrame, size: int = BODY, overlap: int = OVERLAP) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n, start, n_tokens, text): slices of the original text; overlap 0 gives pieces side by side."""
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\s*\S+"), F.lit(0))
    cut = docs.select("doc_id", pieces.alias("pieces")).withColumn("size", F.size("pieces"))
    spread = cut.select("doc_id", "pieces", "size", F.posexplode(window_starts(F.col("size"), size, overlap)).alias("n", "start"))
    body = F.slice("pieces", F.col("start") + 1, F.lit(size))
    return spread.select("doc_id", "n", "start", F.least(F.lit(size), F.col("size") - F.col("start")).alias("n_tokens"), F.regexp_replace(F.array_join(body, ""), r"^\s+", "").alias("text"))


def fixed_chunks(blocks: DataFrame, size: int = BODY, overlap: int = OVERLAP) -> DataFrame:
    """Windows over the narrative of each document, its blocks joined by line ends; with the first and last block each touches."""
    carried = TOUCHED if set(TOUCHED) <= set(blocks.columns) else ("block_seq",)
    told = blocks.where(F.col("kind") != "table").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*carried, "text"))).alias("blocks"))
    lead = lambda k: F.when(k == 0, F.lit("\n")).otherwise(F.lit(" "))
    tokens = F.flatten(F.transform("blocks", lambda b: F.transform(word_tokens(b["text"]), lambda t, k: F.struct(F.concat(lead(k), t).alias("t"), b["block_seq"].alias("b")))))
    seen = F.transform("blocks", lambda b: F.struct(*(b[c].alias(c) for c in carried)))
    cut = told.select("doc_id", seen.alias("seen"), tokens.alias("tokens")).withColumn("size", F.size("tokens"))
    spread = cut.select("doc_id", "seen", "tokens", F.posexplode(window_starts(F.col("size"), size, overlap)).alias("n", "start"))
    part = spread.select("doc_id", "n", "seen", F.slice("tokens", F.col("start") + 1, F.lit(size)).alias("taken"))
    text, first, last = F.array_join(F.transform("taken", lambda p: p["t"]), ""), F.col("taken")[0]["b"], F.element_at("taken", -1)["b"]
    out = [F.lit(0).alias("part"), F.substring(text, F.lit(2), F.length(text)).alias("body"), first.alias("first_block"), last.alias("last_block")]
    at = [F.filter("seen", lambda b: b["block_seq"].between(first, last)).alias("at")] if carried == TOUCHED else []
    return part.select("doc_id", "n", *out, *at)


def side_by_side(text: str, tokens: WordTokenizer, size: int) -> list[str]:
    spans = tokens.spans(text)
    return [text[spans[i][0] : spans[min(i + size, len(spans)) - 1][1]] for i in range(0, len(spans), size)]


def fill(sizes: list[int], budget: int) -> list[list[int]]:
    """Greedy runs of positions whose sizes stay within the budget; one that is larger stands alone."""
    runs: list[list[int]] = []
    room = 0
    for i, n in enumerate(sizes):
        if runs and n <= room:
            runs[-1].append(i)
            room -= n
        else:
            runs.append([i])
            room = budget - n
    return runs


def split_block(text: str, tokens: WordTokenizer, size: int = BODY) -> list[str]:
    """A text over the budget by sentences, packed; a sentence over the budget by token windows."""
    if tokens.count(text) <= size:
        return [text]
    sentences = SENTENCE_END.split(text)
    counts = [tokens.count(s) for s in sentences]
    out: list[str] = []
    for run in fill(counts, size):
        if counts[run[0]] > size:
            out += side_by_side(sentences[run[0]], tokens, size)
        else:
            out.append(" ".join(sentences[i] for i in run))
    return out


def pack_sections(blocks: list[dict], tokens: WordTokenizer, size: int = BODY, soft: int = SOFT) -> list[list[tuple[int, str]]]:
    """Chunks as lists of (block, piece) that never cross an item or sub-item.

    A chunk ends when the next piece does not fit, or at a topic once it has `soft` tokens.
    Headings at the end of a chunk that is full move on to the text they introduce, unless
    that would then not fit.
    """
    chunks: list[list[tuple[int, str]]] = []
    at: tuple | None = None
    open_: list[tuple[dict, str, int]] = []

    def used(parts: list[tuple[dict, str, int]]) -> int:
        return sum(n for _, _, n in parts)

    def close(parts: list[tuple[dict, str, int]]) -> None:
        if parts:
            chunks.append([(b["block_seq"], piece) for b, piece, _ in parts])

    for b in blocks:
        if (b["item"], b["subitem"]) != at:
            close(open_)
            at, open_ = (b["item"], b["subitem"]), []
        for piece in split_block(b["text"], tokens, size):
            n, full = tokens.count(piece), False
            full = used(open_) + n > size
            if open_ and (full or (b["level"] == 3 and used(open_) >= soft)):
                keep = len(open_)
                while full and keep and open_[keep - 1][0]["kind"] == "heading":
                    keep -= 1
                if used(open_[keep:]) + n > size:
                    keep = len(open_)
                close(open_[:keep])
                open_ = open_[keep:]
            open_.append((b, piece, n))
    close(open_)
    return chunks


def cut_tokens(text: str, tokens: WordTokenizer, limit: int) -> str:
    spans = tokens.spans(text)
    return text if len(spans) <= limit else text[: spans[limit - 1][1]]


def split_table(caption: str, head: list[str], rows: list[str], tokens: WordTokenizer, size: int = BODY) -> list[str]:
    """Bodies of at most `size` tokens with caption (a quarter of it at most) and header repeated; rows stay whole if they can."""
    top = [*([cut_tokens(caption, tokens, size // 4)] if caption else []), *head]
    room = size - tokens.count("\n".join(top))
    runs = fill([tokens.count(r) for r in rows], room) or [[]]
    return [cut_tokens("\n".join([*top, *(rows[i] for i in run)]), tokens, size) for run in runs]


def _by_document(blocks: DataFrame, make: Callable[[list[dict]], Iterator[tuple]], carry: bool = False) -> DataFrame:
    """make() over each document's sorted blocks; a task holds one document at a time. To `carry` adds the TOUCHED of each chunk's blocks."""
    from itertools import groupby

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PACKED.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
        if carry:
            names.append("at")
            kinds.append(pa.list_(pa.struct([(c, pa.string() if c in ("page", "section", "item") else pa.int32()) for c in TOUCHED])))
        rows = (r for batch in batches for r in batch.to_pylist())
        out: list[tuple] = []
        for doc, group in groupby(rows, key=lambda r: r["doc_id"]):
            found = list(group)
            seqs = [r["block_seq"] for r in found]
            touched = lambda x: ([{c: r[c] for c in TOUCHED} for r in found[bisect_left(seqs, x[-2]) : bisect_right(seqs, x[-1])]],) if carry else ()  # noqa: B023, E731
            out += [(doc, *x, *touched(x)) for x in make(found)]
            if len(out) > 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return blocks.repartition("doc_id").sortWithinPartitions("doc_id", "block_seq").mapInArrow(run, f"{PACKED}, {AT}" if carry else PACKED)


def section_chunks(blocks: DataFrame, tokens: WordTokenizer | None = None) -> DataFrame:
    tokens = tokens or WordTokenizer()

    def make(rows: list[dict]) -> Iterator[tuple]:
        for n, chunk in enumerate(pack_sections(rows, tokens)):
            yield n, 0, "\n".join(piece for _, piece in chunk), chunk[0][0], chunk[-1][0]

    carry = set(TOUCHED) <= set(blocks.columns)
    told = blocks.where(F.col("kind") != "table").select("doc_id", "block_seq", "kind", "level", "item", "subitem", "text", *(("page", "page_seq", "section") if carry else ()))
    return _by_document(told, make, carry)


def table_chunks(blocks: DataFrame, tokens: WordTokenizer | None = None) -> DataFrame:
    tokens = tokens or WordTokenizer()

    def make(rows: list[dict]) -> Iterator[tuple]:
        for n, b in enumerate(rows):
            for part, body in enumerate(split_table(b["caption"] or "", b["header"], b["rows"], tokens)):
                yield n, part, body, b["block_seq"], b["block_seq"]

    return _by_document(blocks.where(F.col("kind") == "table").select("doc_id", "block_seq", "caption", "header", "rows"), make)


def finish(packed: DataFrame, blocks: DataFrame, filings: DataFrame, strategy: str) -> DataFrame:
    """Chunk rows: id, header and body, the pages touched in order, and metadata from the first block.

    filings (doc_id, filing, company, full_name, year) is a dimension. Packed rows that carry
    what their blocks say (`at`) need no second pass over the blocks.
    """
    if "at" in packed.columns:
        rows = packed
    else:
        kind = F.col("kind") == "table" if strategy == "table" else F.col("kind") != "table"
        b = blocks.where(kind).select(F.col("doc_id").alias("b_doc"), "block_seq", "page", "page_seq", "section", "item")
        touched = packed.join(b, (F.col("doc_id") == F.col("b_doc")) & F.col("block_seq").between(F.col("first_block"), F.col("last_block")))
        at = F.array_sort(F.collect_list(F.struct("block_seq", "page", "page_seq", "section", "item")))
        rows = touched.groupBy("doc_id", "n", "part").agg(F.first("body").alias("body"), at.alias("at"))
    rows = rows.join(filings, "doc_id")
    form = "%s:table:%04d:%d" if strategy == "table" else f"%s:{strategy}:%05d"
    chunk_id = F.format_string(form, "filing", "n", *(["part"] if strategy == "table" else []))
    first = F.col("at")[0]
    text = F.concat(header(F.col("full_name"), F.col("year"), first["section"], HEADER), F.lit("\n"), F.col("body"))
    rows = rows.select(
        chunk_id.alias("chunk_id"), text.alias("text"), "filing", "company", "year", first["page"].alias("page"),
        F.array_distinct(F.transform("at", lambda x: x["page"])).alias("pages"), first["page_seq"].alias("page_seq"),
        first["section"].alias("section"), first["item"].alias("item"), F.lit(strategy == "table").alias("is_table"), F.lit(strategy).alias("strategy"),
    )
    return rows.withColumn("n_tokens", count_tokens(F.col("text"), special=True))


def all_chunks(blocks: DataFrame, filings: DataFrame) -> DataFrame:
    made = {"fixed": fixed_chunks, "section": section_chunks, "table": table_chunks}
    parts = [finish(f(blocks), blocks, filings, name) for name, f in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def embed(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """chunks with a vector; each distinct text is embedded once, in batches, and joined back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(0).to_pylist()
            vectors = [v for i in range(0, len(texts), batch) for v in embedder(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(vectors, pa.list_(pa.float32()))], ["text", "vector"])

    vectors = chunks.select("text").distinct().mapInArrow(run, "text string, vector array<float>")
    return chunks.join(vectors, "text")


__all__ = ["all_chunks", "embed", "finish", "first_tokens", "fixed_chunks", "section_chunks", "table_chunks", "windows"]
