"""Decontamination against window by window comparison; offsets in the text as it was, blocks of items, odd rows."""

import hashlib
import re

import pytest

from quartz_panel.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, size=10):
    w, hit, found = words(text), set(), set()
    for item, texts in items:
        for t in texts:
            b = words(t)
            n = min(size, len(b))
            windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(item)
    return len(w), hit, sorted(str(x) for x in found if x is not None)


ITEMS = [
    (1, "Was the mill on the River Ouse built of stone or of brick, and when?"),
    (2, "Yes: in 1847"),
    (3, None),
    (4, "..."),
    (5, "Año Ñandú ÉTÉ"),
    (6, "a a a a a a a a a a a a"),
    (None, "nobody owns this item at all yet its words do count here"),
    (7, "Yes: in 1847"),
    (7, "on the river ouse built of stone or of brick and"),
    (10, "a"),
]
DOCS = [
    (0, "intro THE MILL on the river-ouse built, of stone or of brick! and when? outro yes IN 1847 end"),
    (1, "the mill on the river ouse built of stone or of"),
    (2, None),
    (3, ""),
    (4, " \n\t.;"),
    (5, "¿Año Ñandú ÉTÉ? año Ñandú ÉTÉ. año ñandú été"),
    (6, "b " + "a " * 40 + "b"),
    (7, "x" * 50000 + " nobody owns this item at all yet its words do count here " + "y " * 5000),
    (0, "intro THE MILL on the river-ouse built, of stone or of brick! and when? outro yes IN 1847 end"),
    (None, "yes in 1847"),
    (8, "yes in 18470 and oyes in 1847 but in 1847 yes in"),
    (9, "emoji \U0001f600 yes, in 1847 \U0001f600"),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, "n", 1, "u") for i, t in DOCS], "doc_id long, text string, n_words string, items int, `a.b` string").repartition(3)
    return docs, spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("block_bytes", [2 << 20, 200])
def test_equals_brute_force_in_one_block_and_in_many(tables, block_bytes):
    docs, items = tables
    got = decontaminate(docs, items, block_bytes=block_bytes).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(((i, *brute(t, [(a, [b]) for a, b in ITEMS])) for i, t in DOCS), key=key)
    texts = sorted(DOCS, key=key)
    assert len(got) == len(want)
    for r, (i, n, hit, found), (_, text) in zip(sorted(got, key=lambda r: key((r.doc_id,))), want, texts, strict=True):
        assert (r.doc_id, r.n_words, r.n_hit, r["items"]) == (i, n, len(hit), found)
        assert {k for s in r.spans for k in range(s.first_word, s.last_word + 1)} == hit
        assert all(b.first_word > a.last_word + 1 for a, b in zip(r.spans, r.spans[1:], strict=False))
        for s in r.spans:
            assert words(text[s.start : s.end]) == words(text)[s.first_word : s.last_word + 1]
            assert WORD.match(text[s.start].translate(LOWER)) and WORD.match(text[s.end - 1].translate(LOWER))


def test_questions_and_answers_are_searched_by_themselves(spark):
    items = spark.createDataFrame([("q1", "which river", "the ouse")], "id string, question string, answer string")
    docs = spark.createDataFrame([(1, "the ouse"), (2, "which river the"), (3, "river the")], "doc_id int, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate(docs, items, item_id="id", texts=("question", "answer")).collect()}
    assert got == {1: (2, ["q1"]), 2: (2, ["q1"]), 3: (0, [])}


def test_empty_tables(spark, tables):
    docs, items = tables
    assert decontaminate(docs.limit(0), items).collect() == []
    got = decontaminate(docs, items.limit(0)).collect()
    assert len(got) == len(DOCS) and not any(r.n_hit or r["items"] or r.spans for r in got)


def test_query_columns_equal_brute_force(spark):
    from quartz_panel.llm import queries as Q

    d = "/root/testdata/sf0.001"
    items = [(r.item_id, [r.text]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in Q.op13_decontaminate(spark, d).collect()}
    assert set(got) == set(texts) and any(r.contaminated for r in got.values())
    for i, t in texts.items():
        n, hit, found = brute(t, items)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit))
