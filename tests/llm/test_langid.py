import zlib

import numpy as np
from pyspark.sql import functions as F

from quartz_panel.llm import langid as G
from quartz_panel.llm import queries as L


def brute_path(scores, penalty):
    best, k = [(0.0, ())] * scores.shape[1], scores.shape[1]
    for row in scores:
        best = [max(((v - (penalty if path and path[-1] != j else 0) + row[j], (*path, j)) for v, path in best), key=lambda x: x[0]) for j in range(k)]
    return max(v for v, _ in best)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    for _ in range(40):
        sizes = rng.integers(0, 7, 4)
        text_of = np.repeat(np.arange(4), sizes)
        scores = rng.normal(size=(len(text_of), 3))
        got = G.viterbi(scores, text_of, 4, 0.7)
        for i in range(4):
            s, path = scores[text_of == i], got[text_of == i]
            if len(s):
                value = s[np.arange(len(s)), path].sum() - 0.7 * (np.diff(path) != 0).sum()
                assert abs(value - brute_path(s, 0.7)) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.op9_langid(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) > 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_spans_and_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang in ('en', 'fr')")
    model = G.train(docs)
    en, fr = (" ".join(docs.filter(F.col("lang") == x).first().text.split()[:60]) for x in ("en", "fr"))
    rows = [(1, en + " " + fr, 0), (2, None, 0), (3, "", 0), (4, "12 !? \n", 0), (5, "привет мир", 0), (6, en.upper(), 0), (6, en.upper(), 0), (7, "xİ\n퟿ a", 0)]
    got = {r.doc_id: r for r in G.identify(spark.createDataFrame(rows, "doc_id long, text string, lang_pred int"), model).collect()}
    assert [s.lang for s in got[1].spans][:1] == ["en"] and got[1].spans[-1].lang == "fr" and len(got[1].spans) <= 4
    assert [(got[i].lang_pred, got[i].score) for i in (2, 3, 4)] == [("und", 0.0)] * 3
    assert got[6].lang_pred == "en"
    none = G.train(docs.limit(0))
    assert none.languages == [] and G.identify(docs.limit(3), none).first().lang_pred == "und"
