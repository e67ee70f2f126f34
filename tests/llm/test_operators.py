"""Parts of the operators, against plain versions and for properties."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm import chat, mixing, near_join, packing, passages, quality_model, quality_rules, secret_scan, toxicity
from docquarry.llm import textnum as tn
from docquarry.llm.graph import components
from docquarry.llm.windows import compact_windows, sliding_min


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té🙂", max_size=12)), max_size=12))
@settings(max_examples=150, deadline=None)
def test_words_of_batches(texts):
    got = []
    for a, _, data, offsets in tn.pieces(pa.array(texts, pa.string()), 5):
        starts, ends, docs = tn.words(data, offsets)
        h = tn.word_hashes(data, starts, ends)
        got += [(a + d, data[s:e].tobytes().decode(), x) for d, s, e, x in zip(docs, starts, ends, h.tolist(), strict=True)]
    assert [(d, w) for d, w, _ in got] == [(i, w) for i, t in enumerate(texts) for w in (t or "").split()]
    assert len({w for _, w, _ in got}) == len({x for *_, x in got}) == len({(w, x) for _, w, x in got})


def test_compact_windows():
    rng = np.random.default_rng(1)

    def plain(x, lo, hi, t):
        if hi - lo >= t:
            c = lo + int(np.argmin(x[lo:hi]))
            yield c, lo, hi - 1
            yield from plain(x, lo, c, t)
            yield from plain(x, c + 1, hi, t)

    for k in range(150):
        edges = np.concatenate(([0], np.cumsum(rng.integers(0, 40, rng.integers(1, 5)))))
        t = int(rng.integers(2, 9))
        x = rng.permutation(1000)[: edges[-1]].astype(np.uint64)
        got = set(zip(*(v.tolist() for v in compact_windows(x, edges, t)), strict=True))
        assert got == {w for a, b in zip(edges[:-1], edges[1:]) for w in plain(x, int(a), int(b), t)}
        tied = rng.integers(0, 9, edges[-1]).astype(np.uint64)
        c, lo, hi = compact_windows(tied, edges, t)
        for a, b in zip(edges[:-1], edges[1:]):
            for i in range(a, b - t + 1):
                least = tied[i : i + t].min()
                assert any(tied[p] == least and q <= i and i + t - 1 <= r for p, q, r in zip(c, lo, hi, strict=True))
    assert sliding_min(np.array([3, 1, 2, 5, 4]), 3).tolist() == [1, 1, 2]


def test_shared_spans():
    rng = np.random.default_rng(2)
    word = lambda n: rng.integers(1, 1 << 60, n).astype(np.uint64)
    p = word(80)
    assert passages.shared_spans(np.concatenate((word(30), p, word(30))), np.concatenate((word(31), p, word(9))))[0][:4] == (30, 110, 31, 111)
    assert passages.shared_spans(word(100), word(100)) == [] and passages.shared_spans(p[:40], p[:40]) == []
    q = p.copy()
    q[40] = 5
    (s, e, s2, e2, likeness), = passages.shared_spans(p, q)
    assert (s, e, s2, e2) == (0, 80, 0, 80) and likeness == 79 / 81


def test_shortest_prefix():
    assert near_join.shortest_prefix() == 3 and near_join.shortest_prefix(0.99, 10, 6) == 6 and near_join.shortest_prefix(0.1, 2) == 1


def test_shortening_ends_when_the_recall_is_reached():
    near, copies = np.full(50, 0.8), np.full(400, 0.97)
    assert near_join.enough(copies, 6) and not near_join.enough(copies[:20], 6)
    assert not near_join.enough(np.concatenate((near, copies)), 6) and not near_join.enough(np.zeros(0), 3)
    missed = [(1 - near_join.matched(0.8, n)) * 1e6 for n in (6, 5, 4, 3)]
    assert missed == sorted(missed, reverse=True) and near_join.enough(np.full(10**6, 0.8), 3) and not near_join.enough(np.full(10**6, 0.8), 4)


def test_a_crowd_of_near_copies_is_done_after_long_prefixes():
    """Every link of a branch is found, each once over all trees, and before prefixes are shortened to the end."""
    rng = random.Random(17)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(120):
        w = base.copy()
        w[rng.randrange(300)] = f"x{rng.random()}"
        texts.append(" ".join(w))
    keys, _ = near_join.paths(pa.array(texts), 10, 6, 3)
    (_, _, s, rows), = near_join.shingle_sets(pa.array(texts))
    sets = [np.unique(s[rows == i]) for i in range(120)]
    seen, ended = Counter(), []
    for t in range(10):
        for root in np.unique(keys[:, t, 0]):
            a = np.flatnonzero(keys[:, t, 0] == root)
            i, j, length = near_join.branch_links(sets, keys, t, a, a, 3)
            seen.update(zip(i.tolist(), j.tolist(), strict=True))
            ended += [length] * (len(a) > 60)
    assert max(ended) == 6 and max(seen.values()) == 1 and len(seen) >= 0.999 * 120 * 119 / 2


def test_recall_of_the_forest_against_all_pairs(spark):
    """Pairs a little over the threshold, among them a crowd that shares a long beginning."""
    rng = random.Random(16)
    word = lambda: f"w{rng.randint(0, 10**7)}"
    crowd = [word() for _ in range(90)]
    rows = []
    for i in range(400):
        base = [*(crowd if i % 4 == 0 else [word() for _ in range(90)]), *(word() for _ in range(110))]
        other = list(base)
        for k in rng.sample(range(200), rng.randint(3, 4)):
            other[k] = word()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = [2 * i for i in range(400) if like(2 * i, 2 * i + 1) >= 0.8]
    assert len(want) > 350 and not any(like(a, b) >= 0.8 for a in range(0, 800, 8) for b in range(0, 800, 8) if a < b)
    got = {r["doc_id"]: r["class_id"] for r in near_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i + 1] == i for i in want) >= 0.995 * len(want)
    assert all(got[2 * i] == 2 * i and got[2 * i + 1] in (2 * i, 2 * i + 1) for i in range(400))


def test_linker():
    rng = random.Random(4)
    sets = [np.array(sorted(rng.sample(range(40), rng.randint(0, 30))), np.uint64) for _ in range(60)]
    like = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / max(1, len(np.union1d(sets[i], sets[j])))
    right = np.arange(30, 60)
    linker = near_join.Linker(sets, right, 0.5)
    for i in range(30):
        may = np.array([rng.random() < 0.7 for _ in right])
        j, found = linker.linked(i, may)
        assert right[j].tolist() == [y for y, m in zip(right, may, strict=True) if m and like(i, y) >= 0.5]
        assert found.tolist() == [like(i, y) for y in right[j]]


def test_first_matches():
    """A pair belongs to the tree where it matches longest, the first of several, at that length."""
    rng = np.random.default_rng(18)
    symbols = rng.integers(0, 2, (20, 4, 3))
    keys = np.stack([(symbols[:, :, : k + 1] * 2 ** np.arange(k + 1)).sum(2) for k in range(3)], 2)
    a = np.arange(20)
    levels = [near_join.first_matches(keys, a, a, t) for t in range(4)]
    for i in range(20):
        for j in range(20):
            length = [next((n for n in (3, 2, 1) if (symbols[i, t, :n] == symbols[j, t, :n]).all()), 0) for t in range(4)]
            want = length.index(max(length))
            assert [x[i, j] for x in levels] == [max(length) - 1 if t == want else -1 for t in range(4)]


def test_blocks_of_a_large_group_lose_no_link(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(70):
        w = base.copy()
        for k in rng.sample(range(150), rng.randint(0, 6)):
            w[k] = f"x{rng.randint(0, 999)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    *_, found = near_join.links(docs, block=8)
    got = Counter()
    for r in found.collect():
        got[r["node"]] += r["n"]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(146)} for i, t in rows}
    node = {}
    for i, t in rows:
        node.setdefault(t, i)
    ids = list(node.values())
    want = Counter(x for i in ids for j in ids if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 for x in (i, j))
    assert sum((want - got).values()) <= 0.01 * sum(want.values()) and not got - want


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 5)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(40)] + [(999, k) for k in range(1000, 1100)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
@settings(max_examples=150, deadline=None)
def test_plan_fills_and_loses_nothing(histogram):
    for last in (True, False):
        held = [(n, 0, n, np.arange(n)) for n, count in histogram.items() for _ in range(count)]
        held = [(k, *p[1:]) for k, p in enumerate(held)]
        placed, rest, sequences = packing.fill(held, last, 64)
        pieces, fill = defaultdict(list), defaultdict(list)
        for doc, start, total, ids, sequence, offset in placed:
            assert ids.tolist() == list(range(start, start + len(ids))) and total == len(held[doc][3])
            pieces[doc] += ids.tolist()
            fill[sequence].append((offset, len(ids)))
        for doc, _, _, ids in rest:
            pieces[doc] += ids.tolist()
        assert all(sorted(pieces[k]) == p[3].tolist() for k, p in enumerate(held)) and sum(len(p[3]) for p in rest) < (1 if last else 64)
        for parts in fill.values():
            parts.sort()
            total = sum(k for _, k in parts)
            assert parts[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:])) and (total == 64 or last and total & (total - 1) == 0)
        assert sorted(fill) == list(range(sequences))


def test_packing_goes_on_with_what_is_left_and_reruns_agree(spark):
    rng = random.Random(19)
    docs = spark.createDataFrame([(i, "some words here " * rng.randint(0, 40)) for i in range(300)], "doc_id long, text string").repartition(3, "doc_id")
    one, two = (sorted(tuple(r) for r in packing.pack(docs, packing.default_tokenizer(), 128, 2, 500).collect()) for _ in range(2))
    assert one == two
    full = Counter()
    for r in one:
        full[r[5]] += r[2]
    short = [n for n in full.values() if n != 128]
    assert len(short) <= 3 * 7 and all(n & (n - 1) == 0 for n in short)


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_best_filling(counts, window):
    reach = {0}
    for n, c in counts.items():
        reach = {r + n * k for r in reach for k in range(c + 1)}
    got = packing.best_filling(counts, window)
    assert sum(n * k for n, k in got.items()) == max(r for r in reach if r <= window) and all(k <= counts[n] for n, k in got.items())


def test_token_ids_are_the_tokenizers(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE", 20)
    monkeypatch.setattr(packing, "PIECE", 60)
    path = packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    texts = ["The the THE, the. the.,. don't I'M", "Ĳ İstanbul ÅNGSTRÖM. ΣΑΣ œuvre ŒUVRE,", "", " \t\u00a0x\u2003y\x1c", "a<|endoftext|>b <|endoftext|>", "e\u0301 \u0301a 12,5 ½ ﬁ \U0001f642", "x " * 50 + "\r\n\x0bz", "À×É. ß÷, Ça,.. ÿ. <|ENDOFTEXT|> A\u030a"] * 3
    packing._tokenizers.pop(path, None)
    for t, ids in zip(texts, packing.token_ids(pa.array(texts), path), strict=True):
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    packing._tokenizers.pop(path, None)


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 3)), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_water_filling(sources):
    sizes, weights = [s for s, _ in sources], [w for _, w in sources]
    budget = Fraction(3 * sum(sizes), 2)
    got = mixing.water_fill(sizes, weights, budget)
    assert sum(got) == budget and all(t <= 2 * s for t, s in zip(got, sizes, strict=True))
    level = [t / w for t, s, w in zip(got, sizes, weights, strict=True) if t < 2 * s]
    assert len(set(level)) <= 1 and all(Fraction(t, w) <= level[0] for t, w in zip(got, weights, strict=True)) if level else True


def test_mixing_takes_each_of_equal_rows_its_own_words(spark):
    """Rows with equal ids and sizes at the end of the fraction: the target is met to the word, and texts are not shuffled but for the ends' slices."""
    docs = spark.createDataFrame([(1, " ".join(f"w{i}x{k}" for k in range(10)), "a", "clash") for i in range(9)], "doc_id long, text string, source string, size string")
    got = mixing.repeated(docs)
    assert got.columns == docs.columns
    rows = [r["text"].split() for r in got.collect()]
    assert sum(map(len, rows)) == 135 and {len(r) for r in rows} == {5, 10}
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_mixing_reruns_agree_and_repeats_texts(spark):
    rows = [(i, "a" if i % 3 else "b", f"w{i} \n" * (i % 7)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized = docs.select("doc_id", "source", mixing.word_count(docs["text"]).alias("size"))
    one, two = (sorted(map(tuple, mixing.mix(sized, mixing.plan(sized)).collect())) for _ in range(2))
    assert one == two
    out = Counter()
    for r in mixing.repeat(docs, mixing.mix(sized, mixing.plan(sized))).collect():
        out[r["doc_id"]] += len(r["text"].split())
        assert rows[r["doc_id"]][2].startswith(r["text"]) or r["text"] == rows[r["doc_id"]][2]
    assert dict(out) == {r[0]: r[-1] for r in one if r[-1]}


def test_many_sources_are_planned_alike(spark):
    rng = random.Random(23)
    rows = [(i, None if i % 41 == 0 else f"s{i % 40}é", rng.randint(0, 30) * (i % 40 % 7)) for i in range(3000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    few, is_few = mixing.plan(sized)
    totals = sized.groupBy("source").sum("size").withColumnRenamed("sum(size)", "source_size")
    many = {r["source"]: r for r in mixing.plan_many(totals).collect()}
    assert is_few and len(many) == 41
    for r in few.collect():
        m = many[r["source"]]
        assert (r["source_size"], r["whole"]) == (m["source_size"], m["whole"]) and m["target"] == pytest.approx(r["target"]) and abs(m["part"] - r["part"]) <= 1
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(sized, (mixing.plan_many(totals), False)).collect()}
    assert all(0 <= taken[i] <= 2 * n for i, _, n in rows) and abs(sum(taken.values()) - 1.5 * sum(n for *_, n in rows)) <= 41


@given(st.text(alphabet="\\<>/s[]INSTR OLEAYUx", max_size=30))
@settings(max_examples=300, deadline=None)
def test_escapes(text):
    assert chat.unescape(chat.escape(text)) == text and not chat._CONTROL.search(chat.escape(text))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "[ROLE]", ""]), st.text(alphabet="\\<>/s[]INSTx", max_size=12)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_examples_hold_their_prefix(turns):
    found = list(chat.expand(iter(turns)))
    assert chat.parse(found[-1][1]) == turns and found[-1][4] and not any(f[4] for f in found[:-1])
    replies = [k for k, (role, _) in enumerate(turns) if role == "assistant"]
    with_loss = [f for f in found if f[2] is not None]
    assert [f[0] - 1 for f in with_loss] == replies
    assert [chat.unescape(f[1][f[2] : f[3]]) for f in with_loss] == [turns[k][1] for k in replies]
    assert all(chat.parse(f[1]) == turns[: f[0]] for f in found)


def test_randomness_tells_text_from_random():
    rng = random.Random(7)
    made = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(40)) for _ in range(200)]
    told = ["thequickbrownfoxjumpsoverthelazydogs2024abc"[:40]] * 2 + ["aaaaaaaaaabbbbbbbbbb1111111111cccccccccc", "abcdefghijklmnopqrst01234567890123456789"]
    score = lambda xs: np.concatenate([x for *_, x in secret_scan._runs(pa.array(xs))])
    assert np.median(score(made)) > 120 and (score(made) < 4).mean() < 0.1 and score(told)[2:].max() < 4


def test_false_discovery_control():
    written, found = np.zeros(10), np.zeros(10)
    written[0], written[9] = 990, 9
    assert secret_scan.lowest_bin(found, written, 0.05) == 10
    found[8] = 100
    assert secret_scan.lowest_bin(found, written, 0.05) <= 8
    found[8], found[0] = 1, 1000
    assert secret_scan.lowest_bin(found, written, 0.05) == 10


def test_redaction(spark):
    from docquarry.llm.secret_scan import redact

    key = "AKIA" + "ABCD2345" * 2
    docs = spark.createDataFrame([(1, f'é token = "{"ab1" * 8}" and {key}', 9), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in redact(docs, [secret_scan.BINS] * 6).collect()}
    assert got == {1: ('é [secret]" and [secret]', 24), 2: ("clean", 5), 3: (None, None)}


def test_covering_finds_planted_rules():
    rng = random.Random(8)
    cells = [((a := rng.randint(0, 9), b := rng.randint(0, 9), rng.randint(0, 9)), (a > 6 and b <= 4) or a == 0, 1) for _ in range(3000)]
    rules = quality_rules.cover(cells[:2000], cells[2000:], [9, 9, 9], quality_rules.Params())
    keeps = [next((keep for tests, keep in rules if quality_rules._holds(c, tests)), True) for c in cells]
    assert {keep for _, keep in rules} == {True, False} and rules[-1][1] is False and sum(k == c[1] for k, c in zip(keeps, cells, strict=True)) <= 0.02 * len(cells)
    assert quality_rules.cover([], [], [9], quality_rules.Params()) == []
    assert quality_rules.cover([((1,), True, 50)], [((1,), True, 50)], [9], quality_rules.Params()) == []


def test_the_first_rule_that_covers_a_text_gives_its_verdict(spark):
    at = lambda above, cut: (quality_rules.Condition("n_words", above, cut),)
    rules = [quality_rules.Rule(at(True, 100.0), True), quality_rules.Rule(at(True, 50.0), False), quality_rules.Rule(at(True, 20.0) + at(False, 30.0), False)]
    rows = spark.createDataFrame([(n,) for n in (10, 25, 40, 60, 200)], "n_words long")
    assert [r[0] for r in rows.select(quality_rules.verdict(rules)).collect()] == [True, False, True, False, True]


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.train(x[:2000], y[:2000], quality_model.Params())
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95

    def walk(row):
        total = model.base
        for f, c, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + (row[f[k]] > c[k])
            total += leaf[k - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x[:50]), [walk(r) for r in x[:50]])
    assert quality_model.train(x[:0], y[:0], quality_model.Params()).score(x[:3]).tolist() == [0.5] * 3


def test_statistics_by_text_do_not_depend_on_the_batch():
    texts = ["", None, "a", "A b! b b\nA b! b b\nx", "é ** 12", "w " * 500]
    whole = quality_model.statistics(pa.array(texts))
    assert np.allclose(whole, np.concatenate([quality_model.statistics(pa.array([t], pa.string())) for t in texts]))
    row = dict(zip(quality_model.NAMES, whole[3], strict=True))
    assert (row["words"], row["lines"], row["repeated_lines"], row["same_as_before"]) == (9, 3, 1 / 3, 2 / 9)


def test_regression_is_sparse_and_finds_the_words():
    rng = random.Random(10)
    made = [(" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(30)), 0) for _ in range(300)]
    made = [(t + " awful", 1) if rng.random() < 0.3 else (t, y) for t, y in made]
    p = toxicity.Params(bits=16)
    at, w, bias = toxicity.train(toxicity.examples(pa.array([t for t, _ in made]), p.bits), np.array([y for _, y in made]), p)
    dense = np.zeros(1 << 16)
    dense[at] = w
    got = toxicity.score_texts(pa.array(["a b Awful", "a b", "", None]), dense, bias, 16)
    assert got[0] > 0.5 > got[1] and got[2] == got[3] < 0.5 and 0 < len(at) < 500


def test_best_cut():
    raw, labels = np.array([3.0, 2.0, 1.0, 0.5, 0.5, -1.0]), np.array([1, 1, 1, 1, 0, 0])
    assert toxicity.best_cut(raw, labels, 0.9) == 0.75 and toxicity.best_cut(raw, labels, 0.5) == -0.25
    assert toxicity.best_cut(raw, 0 * labels, 0.5) == 0 and toxicity.best_cut(raw[:0], labels[:0], 0.5) == 0


def test_scores_are_those_of_a_plain_scorer():
    """Sum of the weights of a text's distinct words, pairs and skip-pairs, each hashed on its own."""
    rng = random.Random(14)
    words = ["ab", "cd", "Ef", "gh1", "é", "ij"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    p = toxicity.Params(bits=12, l1=0.5)
    at, w, bias = toxicity.train(toxicity.examples(pa.array(made), p.bits), np.array([int("ab cd" in t) for t in made]), p)
    dense = np.zeros(1 << p.bits)
    dense[at] = w
    weight = dict(zip(at.tolist(), w.tolist(), strict=True))
    one = {x: int(tn.word_hashes(np.frombuffer(x.lower().encode(), np.uint8), np.array([0]), np.array([len(x.encode())]))[0]) for x in words}
    mixed = lambda x: int(tn.mix(np.array([x % (1 << 64)], np.uint64))[0])
    for t in made[:50]:
        h = [one[x] for x in t.split()]
        found = {x % (1 << p.bits) for x in h} | {mixed(a * (3 + 2 * g) + b) % (1 << p.bits) for g in (1, 2) for a, b in zip(h, h[g:])}
        want = 1 / (1 + np.exp(-bias - sum(weight.get(x, 0.0) for x in found)))
        assert toxicity.score_texts(pa.array([t]), dense, bias, p.bits)[0] == pytest.approx(want)
    assert len(at) > 20


def test_learning_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, ("bad " if i % 2 else "good ") * 20) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels, toxicity.Params(volume=10))[2] == toxicity.PRIOR
    assert len(toxicity.fit(docs, labels, toxicity.Params(l1=0.1))[0]) > 0


def test_without_labels(spark, write):
    d = write([(1, "some text", "en", "s", 9)])
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    assert toxicity.fit(docs, labels)[2] == toxicity.PRIOR
    assert quality_model.fit(docs, labels).score(np.zeros((1, len(quality_model.NAMES)))).tolist() == [0.5]
    assert quality_rules.fit(docs, labels) == []


@pytest.mark.parametrize("cuts", [[], [5], [1, 3, 5, 7, 9, 11, 13]])
def test_slices(spark, cuts):
    from pyspark.sql import functions as F

    from docquarry.llm.fingerprint import _below

    rows = spark.range(-2, 16).select("id", _below(cuts, F.col("id")).alias("n")).collect()
    assert [r["n"] for r in rows] == [sum(c < r["id"] for c in cuts) for r in rows]
