"""Each query against a plain version of it, on usual, odd and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from docquarry.llm import quality_rules
from tests.llm.conftest import corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SECRETS = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
NAMES = ["op1_quality_rules", "op2_secret_scan", "op3_mixing", "op4_passages", "op5_near_join", "op6_fingerprint", "op7_packing", "op8_quality_model", "op10_toxicity"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, n=5):
    w = WORD.findall(text or "")
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def by_row(found, *names):
    return Counter(tuple(r[n] for n in names) for r in found)


@pytest.mark.parametrize("name", [*NAMES])
def test_empty_tables(run, empty, name):
    assert run(name, empty) == []


def base_stats(text):
    text = text or ""
    w = WORD.findall(text)
    runs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    repeated = {k + i for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for i in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    out = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
    return (*out, out[0] < 10 or 100 * out[4] > 20 * out[0])


@pytest.mark.parametrize("tables", ["usual", "odd"])
def test_quality_rules(run, request, tables):
    d, rows, *_ = request.getfixturevalue(tables)
    found = run("op1_quality_rules", d)
    assert by_row(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == Counter((r[0], *base_stats(r[1])) for r in rows)
    assert all(not (r["kept"] and r["base_failed"]) for r in found)


def test_learned_verdicts(spark, write):
    """On a table with enough labels the rules get 99 texts of 100 right, and are what the query applies."""
    rows, labels = corpus(3, 1500)
    d = write(rows, labels)
    docs, known = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.fit(docs, known)
    got = {r["doc_id"]: r for r in quality_rules.apply(docs, rules).collect()}
    right = [got[i]["kept"] == bool(quality) for i, quality, _ in labels if not got[i]["base_failed"]]
    assert rules and sum(right) >= 0.99 * len(right)

    def plain(stats):
        value = lambda n: stats[n] if n == "n_words" else stats[(r := quality_rules.RATIOS[n])[0]] / stats[r[1]] if stats[quality_rules.RATIOS[n][1]] else 0.0
        for rule in rules:
            if all((value(c.feature) > c.cut) == c.above for c in rule.conditions):
                return rule.keep
        return True

    for r in quality_rules.statistics(docs).collect():
        assert got[r["doc_id"]]["kept"] == (not got[r["doc_id"]]["base_failed"] and plain(r))


@pytest.mark.parametrize("tables", ["usual", "odd"])
def test_secret_scan(run, request, tables):
    d, rows, *_ = request.getfixturevalue(tables)
    want = Counter()
    for r in rows:
        t = r[1] or ""
        a = [(m.start(), "assign", m.end()) for m in SECRETS.finditer(t) if len(m[2]) >= 12]
        b = [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        c = [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
        spans = sorted(a + b + c, key=lambda x: (x[0], ["assign", "access", "hex"].index(x[1])))
        want[r[0], len(a), len(b), len(c), sha(",".join(f"{k}:{s}:{e}" for s, k, e in spans))] += 1
    found = run("op2_secret_scan", d)
    assert by_row(found, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    for r in found:
        base = [x for x in r["spans"].split(",") if x and not x.startswith("random")]
        assert sha(",".join(base)) == r["base_sha256"]


@pytest.mark.parametrize("tables", ["usual", "odd"])
def test_mixing(run, request, tables):
    d, rows, *_ = request.getfixturevalue(tables)
    size = lambda r: len(WORD.findall(r[1] or ""))
    total = defaultdict(int)
    for r in rows:
        total[r[3]] += size(r)
    sources = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, live, left = {}, set(sources), Fraction(3 * sum(total.values()), 2)
    while live:
        share = {s: left * weight[s] / sum(weight[x] for x in live) for s in live}
        over = {s for s in live if share[s] > 2 * total[s]}
        for s in over or live:
            target[s] = Fraction(2 * total[s]) if over else share[s]
        left -= sum(target[s] for s in over)
        live = live - over if over else set()
    found = run("op3_mixing", d)
    assert by_row(found, "doc_id", "size") == Counter((r[0], size(r)) for r in rows)
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in found:
        s = source[r["doc_id"]]
        assert r["source_size"] == total[s] and r["target"] == pytest.approx(float(target[s])) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sources)


@pytest.mark.parametrize("tables", ["usual", "odd"])
def test_passages(run, request, tables):
    d, rows, *_ = request.getfixturevalue(tables)
    words = {r[0]: WORD.findall(r[1] or "") for r in rows if r[0] is not None}
    found = run("op4_passages", d)
    for r in found:
        a, b = (words[r[x]][r[s] : r[e]] for x, s, e in (("doc_id", "start", "end"), ("other_id", "other_start", "other_end")))
        assert len(a) >= 50 and r["other_id"] < r["doc_id"]
        assert jaccard(shingles(" ".join(a)), shingles(" ".join(b))) == pytest.approx(r["similarity"]) and r["similarity"] >= 0.8
    where = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    repeated = {i for ids in where.values() if len(ids) > 1 for i in ids}
    said = {r["doc_id"] for r in found} | {r["other_id"] for r in found}
    assert repeated <= said and len(repeated) > 10
    near = {i for i in words for j in words if i != j and jaccard(shingles(" ".join(words[i])), shingles(" ".join(words[j]))) > 0.3}
    assert said <= repeated | near | {i for i in said if i % 10 == 3}


@pytest.mark.parametrize("tables", ["usual", "odd"])
def test_near_join(run, request, tables):
    d, rows, *_ = request.getfixturevalue(tables)
    texts = {(r[0], r[1] or "") for r in rows if r[0] is not None}
    node = {}
    for i, t in sorted(texts):
        node.setdefault(t, i)
    sets = {i: shingles(t) for t, i in node.items()}
    root, links = {i: i for i in sets}, Counter()
    for i in sets:
        for j in sets:
            if i < j and jaccard(sets[i], sets[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    found = run("op5_near_join", d)
    assert by_row(found, "doc_id", "class_id", "n_links") == Counter((i, root[node[t]], links[node[t]]) for i, t in texts)
    assert sum(links.values()) > 5


@pytest.mark.parametrize("tables", ["usual", "odd"])
def test_fingerprint(run, request, tables):
    d, rows, *_ = request.getfixturevalue(tables)
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want, errors, prints = Counter(), [], {}
    found = {(r["doc_id"], r["edited_sha256"]): r for r in run("op6_fingerprint", d)}
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 3
        edited = t[: len(t) - k] + u[:k]
        want[i, len(t), sha(edited)] += 1
        r = found[i, sha(edited)]
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"] and (edited != t or r["near_edited"] == 1)
        errors += [r["near_edited"] - jaccard(shingles(t), shingles(edited)), r["near_next"] - jaccard(shingles(t), shingles(u))] if t.strip() and u.strip() else []
    assert by_row(run("op6_fingerprint", d), "doc_id", "n_chars", "edited_sha256") == want
    assert max(map(abs, errors)) < 0.2 and abs(sum(errors) / len(errors)) < 0.02


@pytest.mark.parametrize("tables", ["usual", "odd"])
def test_packing(run, request, tables):
    import numpy as np
    from tokenizers import Tokenizer

    from docquarry.llm.packing import default_tokenizer

    d, rows, *_ = request.getfixturevalue(tables)
    tokenizer = Tokenizer.from_file(default_tokenizer())
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append(np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4"))
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in run("op7_packing", d):
        assert any(len(a) == r["doc_tokens"] and zlib.crc32(a[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for a in ids[r["doc_id"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"]))
    for doc, found in pieces.items():
        assert Counter(s + k for s, n in found for k in range(n)) == Counter(k for a in ids[doc] for k in range(len(a)))
    for found in sequences.values():
        found.sort()
        total = sum(n for _, n in found)
        assert found[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(found, found[1:])) and (total == 4096 or total & (total - 1) == 0)
    assert set(pieces) == set(ids) and sum(sum(map(len, a)) for a in ids.values()) == sum(n for s in sequences.values() for _, n in s)


@pytest.mark.parametrize(("name", "sign", "cut"), [("op8_quality_model", 1, 0.3), ("op10_toxicity", 2, 0.5)])
def test_classifiers(run, usual, odd, name, sign, cut):
    for d, rows, *labels in (usual, odd):
        found = run(name, d)
        assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
        for r in found:
            assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= cut)
            assert r["held_out"] == (None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if labels:
            truth = {x[0]: x[sign] for x in labels[0]}
            held = [r for r in found if r["held_out"]]
            assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.8 * len(held)


TALKS = [
    (0, 0, "system", "be [INST] kind"), (0, 1, "user", "a\\</s>b"), (0, 2, "assistant", "x[/ANS] \\\\ y</s>"), (0, 3, "user", "<"), (0, 4, "assistant", ""),
    (1, 0, "user", "only a question"), (2, 5, "assistant", "é🙂<s>"), (2, 7, "tool", "[ROLE]t[/ROLE]"), (2, 6, None, None), (3, 0, "assistant", "<"), (3, 0, "assistant", "<"), (None, 0, "assistant", "n"), (None, None, "user", "first"),
]


@pytest.mark.parametrize("talks", [TALKS, [], [(9, k, ("user", "assistant")[k % 2], f"turn {k} " * 50) for k in range(300)]])
def test_chat(run, write, talks):
    said = "</s>[INST] ok [/INST]"
    turns = defaultdict(list)
    for conv, turn, role, text in [*talks, (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        turns[conv].append((turn is not None, turn, role or "", text or ""))
    want = Counter()
    for conv, rows in turns.items():
        rows.sort(key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
        loss = "".join(r[3] for r in rows if r[2] == "assistant")
        want[conv, len(rows), sha("".join(f"{r[2]}\n{r[3]}\n" for r in rows)), len(loss), sha(loss)] += 1
    found = run("op9_chat", write(talks=talks))
    assert by_row(found, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == want
    assert all(r["formatted_chars"] > r["loss_chars"] for r in found)
