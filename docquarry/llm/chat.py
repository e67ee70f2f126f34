"""Chat formatting: prefix-target expansion.

Every assistant turn becomes an example of its own: the start mark, all preceding turns of
its conversation as context, and the turn itself, whose text alone lies in the loss span.
Turns after the last reply, and conversations without one, end in one example without a
loss span, so that the output holds every turn.

Template (fixed strings): an example starts with `<s>`; turns are `[SYS]text[/SYS]`,
`[INST]text[/INST]`, `[ANS]text</s>`, and `[ROLE]role[/ROLE]text[/TURN]` for other roles.
Inside texts and roles a backslash is doubled, and a backslash goes after the first
character of each of these marks, so no mark can occur there and unescape() restores them.

Turns are dealt out by conversation and sorted, then formatted in one pass that holds one
conversation's prefix and an output buffer of fixed size. Examples repeat their context, so
the output is as long as the method makes it (quadratic in a conversation's turns), but no
task ever holds it.

Edge cases: null text counts as empty, null role as the role named by the empty string, null
conv_id as one conversation; turns of equal number come by role, then text, null turns
first; repeated rows are turns of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import table

START = "<s>"
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>")}
ROLE, ROLE_END, TURN_END = "[ROLE]", "[/ROLE]", "[/TURN]"
CONTROLS = (START, *(m for pair in MARKS.values() for m in pair), ROLE, ROLE_END, TURN_END)
BUFFER = 4 << 20

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(
    "|".join(f"{re.escape(a)}(?P<{role}>.*?){re.escape(b)}" for role, (a, b) in MARKS.items())
    + f"|{re.escape(ROLE)}(?P<role>.*?){re.escape(ROLE_END)}(?P<text>.*?){re.escape(TURN_END)}",
    re.DOTALL,
)
EXAMPLE = "conv_id long, example long, n_turns long, text string, loss_start long, loss_end long, complete boolean"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the escaped text, and what stands after it."""
    if role in MARKS:
        return MARKS[role][0], escape(text), MARKS[role][1]
    return f"{ROLE}{escape(role)}{ROLE_END}", escape(text), TURN_END


def parse(example: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted example."""
    out = []
    for m in _TURN.finditer(example, len(START)):
        role = m.lastgroup
        out.append((unescape(m["role"]), unescape(m["text"])) if role == "text" else (role, unescape(m[role])))
    return out


def expand(turns: Iterator[tuple[str, str]]) -> Iterator[tuple[int, str, int | None, int | None, bool]]:
    """(turns, text, loss start, loss end, whether it holds all turns) for each example of one conversation."""
    text, n, held = START, 0, None
    for role, said in turns:
        if held:
            yield (*held, False)
            held = None
        before, body, after = format_turn(role, said)
        start = len(text) + len(before)
        text, n = text + before + body + after, n + 1
        if role == "assistant":
            held = (n, text, start, start + len(body))
    yield (*held, True) if held else (n, text, None, None, True)


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple[int | None, Iterator[tuple[str, str]]]]:
    """Sorted rows (conv_id, role, text) by conversation, without holding one."""
    from itertools import groupby

    for conv, group in groupby(rows, key=lambda r: r[0]):
        yield conv, ((role or "", text or "") for _, role, text in group)


def examples(conversations: DataFrame) -> DataFrame:
    """An example for each assistant turn (and one without loss for turns that none follows); loss spans are in characters of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out, held = [], 0

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            names = [f.split()[0] for f in EXAMPLE.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for conv, turns in _conversations(rows):
            for k, (n, text, start, end, whole) in enumerate(expand(turns)):
                out.append((conv, k, n, text, start, end, whole))
                held += len(text)
                if held > BUFFER or len(out) > 2000:
                    yield flush()
                    out, held = [], 0
        if out:
            yield flush()

    rows = conversations.select(F.col("conv_id").cast("long"), "turn", "role", F.col("text").cast("string"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, EXAMPLE)


def read_back(formatted: DataFrame) -> DataFrame:
    """For each conversation the digests of what its examples hold; rows must come as examples() gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        loss, chars, formatted_ = hashlib.sha256(), 0, 0
        for batch in batches:
            out = []
            for conv, _, _, text, start, end, complete in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                formatted_ += len(text)
                if start is not None:
                    said = unescape(text[start:end])
                    loss.update(said.encode())
                    chars += len(said)
                if complete:
                    turns, digest = parse(text), hashlib.sha256()
                    for role, said in turns:
                        digest.update(f"{role}\n{said}\n".encode())
                    out.append((conv, len(turns), digest.hexdigest(), chars, loss.hexdigest(), formatted_))
                    loss, chars, formatted_ = hashlib.sha256(), 0, 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_back(examples(rows.unionByName(more)))
