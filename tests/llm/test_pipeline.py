import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from quartz_panel.llm import packing as K  # noqa: E402

from .test_ngram_join import brute as near_brute  # noqa: E402
from .test_repeats import brute_first  # noqa: E402

WORD = r"[^\x20\x09-\x0D]+"
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(docs):
    """docs: (doc_id, text, source).  The pieces as (doc_id, piece, n_tokens, bucket_len)."""
    carriers = {}
    for _, t, host in docs:
        for line in t.split("\n"):
            carriers.setdefault((host, re.sub(r"[\x20\x09-\x0D]+", " ", lower(line)).strip(" ")), set()).add(t)
    assert max(map(len, carriers.values())) <= 100  # no line is over the limit on so small a table
    kept = {}
    for d, t, _ in docs:
        w = re.findall(WORD, t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = {g for g in grams if grams.count(g) > 1} if len(w) < 5000 else {g for g, c in __import__("collections").Counter(grams).items() if c > 1}
        covered = {j for i, g in enumerate(grams) if g in many for j in range(i, i + 3)}
        if len(w) >= 50 and 100 * len(covered) <= 50 * len(w):
            kept[d] = t
    last = {}
    for d, t in sorted(kept.items()):
        last[lower(t)] = d
    kept = {d: kept[d] for d in last.values()}
    kept = {d: kept[d] for d, _, c in near_brute(sorted(kept.items()), 80, 5) if c == d}
    left = brute_first([(d, re.findall(WORD, t)) for d, t in kept.items()], 20)
    sizes = {d: n - m for d, (n, m, _) in left.items() if m < n or not m}
    pieces = [(d, k, min(2048, n - 2048 * k)) for d, n in sizes.items() for k in range(max(1, -(-n // 2048)))]
    hist = {}
    for _, _, n in pieces:
        hist[n] = hist.get(n, 0) + 1
    bounds = K.best_boundaries(list(hist), list(hist.values()), 16)
    return {(d, k, n, min(b for b in bounds if b >= n)) for d, k, n in pieces}


def test_run_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source").collect()]
    out = pipeline.run(spark, d)
    assert {(r.doc_id, r.piece, r.n_tokens, r.bucket_len) for r in out.collect()} == brute(docs)


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.limit(3).unionByName(spark.createDataFrame([(10**6, None, None, None, None), (None, "", None, None, None)], docs.schema))
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, odd, "").columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").count() == 0
        stage(spark, odd, "").collect()


def test_stages_carry_columns_of_any_name(spark):
    """A quality column, and two rows that are one document twice, go through all stages."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(80)), "en", "h", 400, i) for i in (1, 2, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int")
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns[-1] == "quality", name
    assert sorted((r.doc_id, r.quality) for r in docs.collect()) == [(1, 1), (2, 2)]
