from pyspark.sql import functions as F

from docquarry.operators import chunks
from docquarry.operators.chunks import WordTokenizer, cut_tokens, fill, pack_sections, split_block, split_table

T = WordTokenizer()


def block(seq, n, kind="text", level=0, item="Item 1", subitem="", word="w"):
    return {"block_seq": seq, "kind": kind, "level": level, "item": item, "subitem": subitem, "text": " ".join(f"{word}{seq}" for _ in range(n))}


def seqs(blocks):
    return [[b for b, _ in c] for c in pack_sections(blocks, T)]


def test_windows_match_a_plain_loop(spark):
    docs = spark.createDataFrame([(i, " \n".join(f"t{k}" for k in range(n)) + " ") for i, n in enumerate((0, 1, 450, 451, 825, 826, 2000))] + [(9, None)], "doc_id long, text string")
    got = {}
    for r in chunks.windows(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n"], r["start"], r["n_tokens"], r["text"]))
    for r in docs.collect():
        spans, want, start = T.spans(r["text"] or ""), [], 0
        while spans:
            end = min(start + 450, len(spans))
            want.append((len(want), start, end - start, r["text"][spans[start][0] : spans[end - 1][1]]))
            if end == len(spans):
                break
            start += 375
        assert sorted(got.get(r["doc_id"], [])) == want


def test_items_are_never_crossed():
    assert seqs([block(0, 10), block(1, 10, subitem="A. x"), block(2, 10, subitem="A. x"), block(3, 10, item="Item 2")]) == [[0], [1, 2], [3]]


def test_topics_end_chunks_of_substance():
    assert seqs([block(0, 199), block(1, 2, "heading", 3), block(2, 5)]) == [[0, 1, 2]]
    assert seqs([block(0, 200), block(1, 2, "heading", 3), block(2, 5)]) == [[0], [1, 2]]


def test_headings_move_on_with_their_text():
    assert seqs([block(0, 300), block(1, 5, "heading", 2), block(2, 5, "heading", 2), block(3, 200)]) == [[0], [1, 2, 3]]
    assert seqs([block(0, 300), block(1, 5, "heading", 2), block(2, 450)]) == [[0, 1], [2]]
    assert seqs([block(0, 5, "heading", 1), block(1, 450)]) == [[0], [1]]


def test_long_blocks():
    text = " ".join(f"Sentence {i} has five." for i in range(300))
    parts = split_block(text, T)
    assert " ".join(parts) == text and max(map(T.count, parts)) <= 450 and all(p.endswith(".") for p in parts)
    assert list(map(T.count, split_block("w " * 1000, T))) == [450, 450, 100]
    assert fill([3, 9, 2, 2], 5) == [[0], [1], [2, 2 + 1]]


def test_tables_are_split_by_rows():
    rows = [f"| r{i} | {i} |" for i in range(200)]
    parts = split_table("A caption", ["| h | v |", "|---|---|"], rows, T, 100)
    assert all(p.startswith("A caption\n| h | v |\n|---|---|\n") and T.count(p) <= 100 for p in parts)
    assert [x for p in parts for x in p.split("\n")[3:]] == rows
    assert T.count(split_table("c " * 500, ["h"], ["w " * 500], T, 100)[0]) == 100
    assert split_table("", ["h"], [], T) == ["h"]
    assert cut_tokens("a  b c", T, 2) == "a  b"


def test_all_chunks(spark):
    b = "doc_id long, block_seq int, page_seq int, page string, kind string, level int, is_bold boolean, item string, subitem string, section string, text string, caption string, header array<string>, rows array<string>"
    long_ = " ".join(f"w{i}" for i in range(300))
    rows = [(7, i, i + 1, str(i + 10), "text", 0, False, "Item 1", "", "Item 1", long_, None, None, None) for i in range(3)]
    rows.append((7, 3, 4, "13", "table", 0, False, "Item 1", "", "Item 1", "x", "Cap", ["| a |", "|---|"], ["| 1 |"]))
    blocks = spark.createDataFrame(rows, b)
    filings = spark.createDataFrame([(7, "sea-2025", "Sea", "Sea Limited", 2025)], "doc_id long, filing string, company string, full_name string, year int")
    got = {r["chunk_id"]: r for r in chunks.all_chunks(blocks, filings).collect()}
    assert sorted(got) == ["sea-2025:fixed:00000", "sea-2025:fixed:00001", "sea-2025:fixed:00002", "sea-2025:section:00000", "sea-2025:section:00001", "sea-2025:section:00002", "sea-2025:table:0000:0"]
    assert got["sea-2025:fixed:00000"]["pages"] == ["10", "11"] and got["sea-2025:fixed:00001"]["pages"] == ["11", "12"]
    assert got["sea-2025:table:0000:0"]["text"] == "Sea Limited | FY2025 annual report (20-F) | Item 1\nCap\n| a |\n|---|\n| 1 |"
    assert all(r["n_tokens"] == T.count(r["text"]) + 2 <= 512 for r in got.values())


def test_embedding_happens_once_per_text(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "yy")], "chunk_id string, text string")
    got = chunks.embed(rows, lambda texts: [[float(len(t)), float(len(texts))] for t in texts]).orderBy("chunk_id").collect()
    assert [r["vector"][0] for r in got] == [1.0, 1.0, 2.0]
    assert rows.select(F.col("text")).distinct().count() == 2
