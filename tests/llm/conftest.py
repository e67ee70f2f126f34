import random

import pytest

from docquarry.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["size", "slice", "score", "label", "key", "words", "n", "node", "taken", "part", "mix_id", "its", "digest", "fold"]
BAD = ["idiot", "moron", "clown", "loser"]


def prose(rng, n, bad=0.0):
    made = ["".join(rng.choice(["an", "be", "co", "da", "el", "fi"]) for _ in range(rng.randint(1, 5))) for _ in range(n)]
    return " ".join(rng.choice(BAD) if rng.random() < bad else w + rng.choice(["", "", "", ".", ",", ".\n"]) for w in made)


def edited(rng, text, share):
    return " ".join("x" + w if rng.random() < share else w for w in text.split(" "))


def corpus(seed=1, n=120):
    """Documents with copies, near copies, shared passages, secrets, junk, toxic words; and their labels."""
    rng = random.Random(seed)
    texts, labels = [], []
    base = [prose(rng, rng.randint(5, 260)) for _ in range(n)]
    passage = " ".join(prose(rng, 70).split())
    for i, t in enumerate(base):
        quality, toxic = 1, 0
        if i % 10 == 1:
            t = base[i - 1]
        elif i % 10 == 2:
            t = edited(rng, base[i - 2], 0.01)
        elif i % 10 == 3:
            t = f"{t} {passage} {prose(rng, 20)}"
        elif i % 10 == 4:
            t, toxic = " ".join(w if rng.random() > 0.15 else rng.choice(BAD) for w in t.split(" ")), 1
        elif i % 10 == 5:
            t, quality = " ".join(w + "***" for w in t.split()), 0
        elif i % 10 == 6:
            t = f'{t} token = "{rng.randbytes(20).hex()}" AKIA{"".join(rng.choice("ABCDEFGH234567") for _ in range(16))} PassWord: {"x" * rng.randint(8, 16)}'
        elif i % 10 == 7:
            t, quality = "same words again and again here " * rng.randint(3, 30), 0
        texts.append(t)
        labels.append((i, quality, toxic))
    rows = [(i, t, "en", f"s{i % 4}" if i % 3 else "s0", len(t)) for i, t in enumerate(texts)]
    return rows, labels


ODD = [
    (None, "no id at all here", None, None, None),
    (1000, None, "en", None, None),
    (1001, "", "en", "", 0),
    (1002, " \n\t ", "en", "s0", 4),
    (1003, "one", None, "s1", 3),
    (1004, "éà 🙂 naïve ß Ωmega İx <|endoftext|> a\u00a0b \x1c c", "fr", "é", 40),
    (1005, "one two three", "en", "s1", 13),
    (1006, "one two three", "en", "s1", 13),
    (1006, "one two three", "en", "s1", 13),
    (1007, "long " * 9000 + "\nend", "en", "s2", 45004),
]


@pytest.fixture(scope="session")
def write(spark, tmp_path_factory):
    def make(docs=None, labels=None, talks=None, clash=False):
        d = str(tmp_path_factory.mktemp("tables"))
        frame = spark.createDataFrame(docs or [], DOCS)
        if clash:
            for c in CLASHING:
                frame = frame.selectExpr("*", f"'clash' as `{c}`")
        frame.repartition(3).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(labels or [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame(talks or [], "conv_id long, turn long, role string, text string").repartition(2).write.parquet(f"{d}/conversations.parquet")
        return d

    return make


@pytest.fixture(scope="session")
def usual(write):
    rows, labels = corpus()
    return write(rows, labels), rows, labels


@pytest.fixture(scope="session")
def odd(write):
    rows, labels = corpus(2, 60)
    rows = rows + ODD
    return write(rows, labels + [(1001, None, None), (None, 1, 1), (5, 0, 1)], clash=True), rows


@pytest.fixture(scope="session")
def empty(write):
    return write()


@pytest.fixture(scope="session")
def run(spark):
    """The rows of a query."""
    cache = {}

    def go(name, d):
        if (name, d) not in cache:
            cache[name, d] = [r.asDict() for r in queries.queries()[name](spark, d).collect()]
        return cache[name, d]

    return go
