"""Shared passages against what was planted: families in large groups, inserted and deleted words."""

import random
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from docquarry.llm import passages


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]


def rows_of(texts):
    return [(i, " ".join(t), "en", "s0", None) for i, t in enumerate(texts)]


def linked(found):
    """The least document that each one hangs together with."""
    root = {}

    def at(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for r in found:
        a, b = at(r["doc_id"]), at(r["other_id"])
        root[max(a, b)] = min(a, b)
    return {i: at(i) for i in root}


def test_families_inside_a_group(run, write):
    """All passages have 40 words in common, too few for a passage, so that one group has them; a family's copies have words inserted on both sides of these."""
    rng = random.Random(5)
    core, texts, families = words(rng, 40), [], 40
    for _ in range(families):
        before, after = words(rng, 26), words(rng, 26)
        for more in (0, 1):
            texts.append([*words(rng, 30), *before, *words(rng, more), *core, *words(rng, more), *after, *words(rng, 30)])
    root = linked(run("op4_passages", write(docs=rows_of(texts))))
    assert all(root[i] in (i, i - 1) and (root[i] == i or i % 2) for i in root)
    assert sum(root.get(2 * f + 1) == 2 * f for f in range(families)) >= 0.95 * families


def test_every_pair_of_a_small_group(run, write):
    rng = random.Random(3)
    passage = words(rng, 60)
    found = run("op4_passages", write(docs=rows_of([*words(rng, 20), *passage, *words(rng, 20)] for _ in range(3))))
    assert {(r["other_id"], r["doc_id"]) for r in found} == {(0, 1), (0, 2), (1, 2)}


def test_pairs_against_all_pairs(run, write):
    """Passages of 50 to 90 words, exact or with words changed, in two to nine documents each: every pair of documents hangs together, and none else does."""
    rng = random.Random(21)
    texts, members, copies = [], [], []
    for _ in range(60):
        passage, n = words(rng, rng.randint(50, 90)), rng.randint(2, 9)
        members.append(range(len(texts), len(texts) + n))
        exact = rng.random() < 0.5
        for _ in range(n):
            copy = list(passage)
            if not exact:
                copy[rng.randrange(len(copy))] = words(rng, 1)[0]
            copies.append({tuple(copy[k : k + 5]) for k in range(len(copy) - 4)})
            texts.append([*words(rng, rng.randint(0, 60)), *copy, *words(rng, rng.randint(0, 60))])
    texts += [words(rng, 120) for _ in range(100)]
    found = run("op4_passages", write(docs=rows_of(texts)))
    group = {r[k]: r["group_id"] for r in found for k in ("doc_id", "other_id")}
    grams = [{tuple(t[k : k + 50]) for k in range(len(t) - 49)} for t in texts]
    pairs = [(a, b) for m in members for a in m for b in m if a < b]
    exact = [(a, b) for a, b in pairs if grams[a] & grams[b]]
    assert len(exact) > 200 and all(group.get(a) == group.get(b) == min(a, group.get(a, -1)) for a, b in exact)
    near = [(a, b) for a, b in pairs if len(copies[a] & copies[b]) >= 0.8 * len(copies[a] | copies[b])]
    assert len(near) > 300 and sum(a in group and group[a] == group.get(b) for a, b in near) >= 0.98 * len(near)
    home = {i: m[0] for m in members for i in m}
    assert all(home.get(r["doc_id"], -1) == home.get(r["other_id"], -2) for r in found) and all(g == home[g] or g in home for g in group.values())


@pytest.mark.parametrize("change", ["insert", "delete"])
def test_shifted_words(run, write, change):
    """One word inserted or deleted anywhere in 55 words leaves a similarity of 0.82 or more."""
    rng = random.Random(7)
    texts, n = [], 300
    for _ in range(n):
        passage = words(rng, 55)
        k = rng.randint(5, 50)
        other = [*passage[:k], *(words(rng, 1) if change == "insert" else []), *passage[k + (change == "delete") :]]
        texts += [[*words(rng, 20), *passage, *words(rng, 20)], [*words(rng, 20), *other, *words(rng, 20)]]
    pairs = defaultdict(int)
    for r in run("op4_passages", write(docs=rows_of(texts))):
        pairs[r["other_id"], r["doc_id"]] += 1
    assert all(b == a + 1 and a % 2 == 0 for a, b in pairs) and len(pairs) >= 0.98 * n


def test_whole_extent_beside_an_insertion():
    """A word changed about every 46 and a long insertion on the other side: both parts are reported, not the densest stretch alone."""
    rng = np.random.default_rng(1)
    a = rng.integers(1, 1 << 62, 200).astype(np.uint64)
    b = a.copy()
    for k in (25, 71, 117, 163):
        b[k : k + 5] = rng.integers(1, 1 << 62, 5)
    b = np.concatenate((b[:100], rng.integers(1, 1 << 62, 120).astype(np.uint64), b[100:]))
    spans = passages.shared_spans(a, b)
    covered = {i for s, e, *_ in spans for i in range(s, e)}
    assert len(covered) >= 180 and all(x[4] >= 0.8 for x in spans)


def test_changed_words_in_the_middle():
    """Three words changed in the middle of 72 leave 61 of 68 shingles, a similarity of 0.81, but no 46 that are as similar."""
    rng = np.random.default_rng(4)
    word = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    p = word(68)
    q = p.copy()
    q[30:37] = word(7)
    (*span, likeness), = passages.shared_spans(np.concatenate((word(40), p, word(40))), np.concatenate((word(35), q, word(50))))
    assert span == [40, 108, 35, 103] and likeness == 61 / 75


@pytest.mark.parametrize("copies", [2, 40])
def test_changed_words_in_the_middle_are_found(run, write, copies):
    """So they are found where the min-hash lies at the passage's edge, and in groups of any size."""
    rng = random.Random(9)
    texts, pairs, passage = [], [], words(rng, 72)
    for k in range(60 if copies == 2 else 1):
        passage = words(rng, 72)
        for i in range(copies):
            other = [*passage[:34], *(words(rng, 3) if i else passage[34:37]), *passage[37:]]
            texts.append([*words(rng, 30), *other, *words(rng, 30)])
            pairs += [(len(texts) - 1 - i, len(texts) - 1)] * bool(i)
    root = linked(run("op4_passages", write(docs=rows_of(texts))))
    assert sum(root.get(b, b) == a for a, b in pairs) >= 0.95 * len(pairs)


def test_large_groups_have_the_components_of_all_pairs(spark):
    """Groups shared by tasks, in blocks of 8, and those of one task connect the documents that all pairs connect."""
    rng = random.Random(13)
    core, texts = words(rng, 40), []
    for _ in range(12):  # each family has its words around the same 40, too few for a passage
        before, after = words(rng, 26), words(rng, 26)
        for more in (0, 1, 0, 2):
            texts.append([*words(rng, 30), *before, *words(rng, more), *core, *words(rng, more), *after, *words(rng, 30)])
    texts += [[*words(rng, 30), *core, *words(rng, 30)] for _ in range(40)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = [{i: r for i, r in linked(r.asDict() for r in passages.passages(docs, block=block).collect()).items()} for block in (8, 512)]
    assert found[0] == found[1] and {i: r for i, r in found[0].items()} == {i: i - i % 4 for i in range(48)}


def test_few_searches_where_no_passage_is_shared(monkeypatch):
    """Patterns that have many shingles in common, but spread too thinly for a passage, are told apart without a search for each pair."""
    rng = np.random.default_rng(8)
    base, asked = rng.integers(1, 1 << 32, 146).astype(np.uint32), []
    patterns = []
    for _ in range(60):
        x = base.copy()
        for k in range(0, 146, 10):  # a word changed about every tenth leaves 0.5 of the shingles
            k += int(rng.integers(5))
            x[k : k + 5] = rng.integers(1, 1 << 32, len(x[k : k + 5]))
        patterns.append((73, x))
    alike = passages._alike
    monkeypatch.setattr(passages, "_alike", lambda *x: asked.append(1) or alike(*x))
    _, edges = passages._joined(patterns, np.full(60, 46), np.zeros(60), 46, 0.8)
    assert not edges and len(asked) <= 60 + 60 * 59 // 2 // 4


def test_no_passage_is_given_up_unsearched():
    """Whatever a search finds, the bound that saves searches lets through: changed, moved, repeated and short patterns."""
    rng = np.random.default_rng(3)
    base, patterns = rng.integers(1, 1 << 32, 160).astype(np.uint32), []
    for i in range(120):
        a = int(rng.integers(0, 60))
        x = base[a : a + int(rng.integers(30, 100))].copy()
        if i % 4 == 0:  # few different ones
            x = np.resize(x[: int(rng.integers(3, 12))], len(x)).astype(np.uint32)
        for _ in range(int(rng.integers(0, 4))):
            k, n = int(rng.integers(0, len(x))), int(rng.integers(1, 8))
            x = np.concatenate((x[:k], np.zeros(n, np.uint32), x[k + (n if i % 3 else 0) :]))
        patterns.append((int(rng.integers(0, len(x))), x))
    fill = lambda x: np.concatenate((np.where(x == 0, 1 << 33 | np.arange(len(x)), x), 1 << 34 | np.arange(max(0, 46 - len(x)))))
    fewest = np.array([passages._fewest(fill(x), 46) for _, x in patterns])
    may = passages._hopeful(patterns, fewest, 46, 0.8)
    found = 0
    for i in range(len(patterns)):
        others = np.flatnonzero(np.arange(len(patterns)) != i)
        for j, good in zip(others.tolist(), may(i, others).tolist(), strict=True):
            if passages._alike(patterns[i][1], patterns[j][1], patterns[i][0], patterns[j][0], 46, 0.8):
                found += 1
                assert good
    assert found > 300


def test_plain_pairs_at_once():
    """Pairs verified all at once have the passages that a search of each alone finds, and most that share one are plain."""
    rng = np.random.default_rng(5)
    word = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    left, right = [word(0), word(60), word(50)], [word(60), word(0), word(10)]
    for i in range(1500):
        p = word(int(rng.integers(30, 110)))
        q = p.copy()
        for _ in range(int(rng.integers(0, 3))):
            k, n = int(rng.integers(0, len(q))), int(rng.integers(0, 8))
            q = np.concatenate((q[:k], word(n), q[k + (n if i % 3 else 0) :]))
        q = np.concatenate((q, q[:20])) if i % 17 == 0 else q
        left.append(np.concatenate((word(int(rng.integers(0, 30))), p, word(int(rng.integers(0, 30))))))
        right.append(np.concatenate((word(int(rng.integers(0, 30))), q, word(int(rng.integers(0, 30))))))
    alone = [passages.common_spans(a, b) for a, b in zip(left, right, strict=True)]
    many = passages._plain_spans(left, right, passages.LEAST, passages.SIMILARITY)
    assert all(x is None or x == y for x, y in zip(many, alone, strict=True))
    assert sum(x is not None for x in many) > 0.6 * sum(map(bool, alone)) > 300


def test_windows_have_few_rows_in_parts():
    """A window has a row in every part of its group, so parts are as large as one task sorts with ease."""
    n = np.array([513, 4096, 4097, 20_660])
    parts = passages._parts(n, 512).astype(int)
    assert parts.tolist() == [1, 1, 2, 6] and (n / parts <= 8 * 512).all()


def test_shuffles_leave_the_disk(spark):
    """The shuffles of a settled table are gone when it is there, not at some later collection of garbage."""
    made = lambda: {str(f) for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs() for f in Path(d.getPath()).rglob("shuffle_*.data")}
    before = made()
    out = passages._settled(spark.range(100_000).repartition(3, "id"))
    end = time.time() + 3
    while made() - before and time.time() < end:
        time.sleep(0.1)
    assert not made() - before
    assert out.count() == 100_000


def test_candidates_of_one_stretch_are_dealt(spark):
    """Many candidates of the least document's passage, verified by one task or by many, give the same rows."""
    rng = random.Random(17)
    passage = words(rng, 60)
    texts = [[*words(rng, 5), *passage, *words(rng, 5)] for _ in range(40)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    one, many = (sorted(map(tuple, passages.passages(docs, together=n).collect())) for n in (1000, 3))
    assert one == many and {r[0] for r in one} == set(range(1, 40))
