"""Rows that share a doc_id but not the text: each text is a document of its own, in whatever order the rows come."""

import hashlib

import pytest

from quartz_panel.llm.substring_dedup import substring_dedup
from quartz_panel.llm.suffix_dedup import suffix_dedup

LONG = " ".join(f"w{k}" for k in range(120))
OTHER = " ".join(f"other{k}" for k in range(70))
CASES = [
    [(1, LONG), (2, "short text"), (2, LONG)],
    [(1, LONG), (1, "short text"), (2, LONG)],
    [(1, LONG), (2, OTHER), (2, LONG)],
    [(5, LONG), (5, OTHER), (5, LONG + " tail"), (5, None), (5, ""), (None, LONG), (7, LONG), (5, OTHER)],
]


def distinct(rows):
    """The texts as documents (rows that repeat both are one), without rows that have no doc_id."""
    return sorted({(d, t or "") for d, t in rows if d is not None})


@pytest.mark.parametrize("rows", CASES)
@pytest.mark.parametrize(("turned", "broadcast"), [(False, 8 << 20), (True, 0)])
def test_bytes_are_those_of_texts_as_documents(spark, rows, turned, broadcast):
    data = rows[::-1] if turned else rows
    got = suffix_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(2), most_broadcast_bytes=broadcast).collect()
    texts = [t.encode() for _, t in distinct(rows)]
    windows = [t[i : i + 200] for t in texts for i in range(len(t) - 199)]
    twice = {w for w in windows if windows.count(w) > 1}
    assert len(got) == len(rows)
    kept = {}
    for d, t in distinct(rows):
        b = t.encode()
        gone = {p for i in range(len(b) - 199) if b[i : i + 200] in twice for p in range(i, i + 200)}
        kept[d, b] = bytes(x for p, x in enumerate(b) if p not in gone)
    want = sorted(hashlib.sha256(kept[d, (t or "").encode()]).hexdigest() for d, t in rows if d is not None)
    assert sorted(hashlib.sha256(bytes(r.kept)).hexdigest() for r in got if r.doc_id is not None) == want


@pytest.mark.parametrize("rows", CASES)
@pytest.mark.parametrize(("turned", "broadcast"), [(False, 8 << 20), (True, 0)])
def test_one_document_keeps_a_shared_passage_and_no_other_word_goes(spark, rows, turned, broadcast):
    data = rows[::-1] if turned else rows
    got = substring_dedup(spark.createDataFrame([(d, t, "x") for d, t in data], "doc_id long, text string, own string").repartition(2), most_broadcast_bytes=broadcast).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in got) == sorted((str(d), len((t or "").split())) for d, t in rows)
    owned = [r for r in got if r.doc_id is not None]
    whole = {(r.doc_id, r.kept_text) for r in owned if r.n_words >= 120 and "w0" in r.kept_text.split()}
    assert len(whole) == 1
    holders = {d for d, t in rows if d is not None and t and t.startswith("w0")}
    assert next(iter(whole))[0] in (holders if len({t for d, t in rows if d == min(holders)}) > 1 else {min(holders)})
    for r in owned:
        if r.n_words in (2, 70):
            assert r.n_removed == 0 and r.kept_text in (OTHER, "short text")
    assert all(r.carried.own == "x" for r in got)
