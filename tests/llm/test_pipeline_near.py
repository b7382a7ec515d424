"""The pipeline's near-duplicate stage against brute force of its own setting: 5-word shingles, similarity 0.8."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from quartz_panel.llm import ngram_join as J  # noqa: E402

from .test_ngram_join import corpus, shingles  # noqa: E402


def similarity(a, b, n=5):
    x, y = shingles(a, n), shingles(b, n)
    return len(x & y) / len(x | y)


def components(data):
    least = {d: d for d, _ in data}
    links = [(a, b) for i, (a, x) in enumerate(data) for b, y in data[:i] if x and y and similarity(x, y) >= 0.8]
    for _ in data:
        new = dict(least)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == least:
            return least
        least = new


def planted():
    """Pairs of (cut to 85 % of the words, two scattered changes in 100 words); the last is below 0.8."""
    rng = random.Random(3)
    out = []
    for k in range(4):
        w = [f"v{rng.randrange(10**6)}" for _ in range(100)]
        cut, changed, far = w[:85], list(w), list(w)
        changed[30] = changed[70] = "other"
        for i in (20, 45, 70):
            far[i] = "other"
        for j, v in enumerate((w, cut, far)):
            out.append((100 * k + j, " ".join(v)))
        u = [f"u{rng.randrange(10**6)}" for _ in range(100)]
        changed = list(u)
        changed[30] = changed[70] = "other"
        out += [(100 * k + 10, " ".join(u)), (100 * k + 11, " ".join(changed))]
    return out


def test_planted_pairs_between_080_and_090_are_linked(spark):
    data = planted()
    text = dict(data)
    assert all(0.8 <= similarity(text[a], text[b]) < 0.9 for k in range(4) for a, b in ((100 * k, 100 * k + 1), (100 * k + 10, 100 * k + 11)))
    assert all(similarity(text[100 * k], text[100 * k + 2]) < 0.8 for k in range(4))
    docs = spark.createDataFrame([(d, t, "en", "h", len(t)) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in pipeline.near(spark, docs, "").collect()}
    assert kept == {d for d in text if d % 100 in (0, 2, 10)}


@pytest.mark.parametrize("seed,frequent,zone", [(1, 50, 102), (2, 2, 102), (3, 0, 256)])
def test_join_of_the_setting_equals_brute_force(spark, seed, frequent, zone):
    data = corpus(seed)
    s = J.Setting(shingle=pipeline.NEAR.shingle, percent=pipeline.NEAR.percent, frequent=frequent, zone=zone)
    got = {r.doc_id: r.component_id for r in J.ngram_jaccard_join(spark.createDataFrame(data, "doc_id long, text string"), s).collect()}
    assert got == components(data)


def test_stage_equals_brute_force_on_given_documents(spark):
    docs = pipeline.exact(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "").filter("text is not null and text <> ''")
    data = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    least = components(data)
    assert {r.doc_id for r in pipeline.near(spark, docs, "").collect()} == {d for d, _ in data if least[d] == d}
