"""Columns of clashing names in exact and near dedup; more languages than a table of full size holds."""

import numpy as np
import pytest

import corpus_pipeline as C
from quartz_panel.llm import langid as G
from quartz_panel.llm.exact_dedup import deduplicated

NAMES = ["doc_id", "text", "__norm", "norm", "row", "id", "digest", "__gone", "a.b", "keep_id", "kept", "component_id", "source"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "Same text"), (2, "same TEXT"), (2, "same TEXT"), (3, "other"), (4, None), (5, ""), (None, "same text"), (None, "own")]
    return spark.createDataFrame([(i, t, *[k] * (len(NAMES) - 3), str(k)) for k, (i, t) in enumerate(rows)], ", ".join(f"`{n}` {'long' if n not in ("text", "source") else 'string'}" for n in NAMES))


@pytest.mark.parametrize("most", [8 << 20, 0])
def test_exact_dedup_carries_clashing_names(odd, most):
    out = deduplicated(odd, most_broadcast_bytes=most)
    assert out.columns == NAMES
    got = [tuple(r) for r in out.collect()]
    assert sorted(str(r[0]) + str(r[1]) for r in got) == ["2same TEXT", "3other", "5", "Noneown"]
    assert all(len(set(map(str, r[2:]))) == 1 for r in got)
    single = [tuple(r) for r in deduplicated(odd.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()]
    assert sorted(r[0] for r in single) == [2, 3, 5] and all(len(set(map(str, r[2:]))) == 1 for r in single)


def test_stages_carry_clashing_names(spark, odd):
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, odd, "").columns == NAMES, name
        stage(spark, odd, "").collect()


def test_more_languages_than_the_old_limit(spark, monkeypatch):
    """150 languages with an alphabet's letter pair each, counts flushed and words scored in pieces, at full and at reduced table size."""
    monkeypatch.setattr(G, "HELD_LANGUAGES", 7)
    pairs = [a + b for a in "abcdefghijklm" for b in "nopqrstuvwxy"][:150]
    docs = spark.createDataFrame([(i, f"l{i:03}", " ".join([p * 3] * 5)) for i, p in enumerate(pairs)], "doc_id long, lang string, text string").coalesce(2)
    for cells, bits in ((1 << 24, 15), (150 << 12, 12)):
        monkeypatch.setattr(G, "MOST_CELLS", cells)
        model = G.train(docs)
        assert model.bits == bits and len(model.languages) == 150
        got = {r.doc_id: r.lang_pred for r in G.identify(docs, model).collect()}
        assert np.mean([got[i] == f"l{i:03}" for i in range(150)]) > 0.98
    assert G.table_bits(10**6, 15) == G.LEAST_BITS


def test_word_scores_are_the_same_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    model = G.Model(["a", "b", "c"], 6, rng.normal(size=(64, 3)).astype(np.float32), np.ones((len(G.SCRIPTS), 3), bool))
    size = rng.integers(1, 9, 50)
    grams = rng.integers(0, 64, size.sum())
    whole = G._word_scores(model, grams, size)
    assert np.allclose(whole, [model.scores[g].sum(0) for g in np.split(grams, np.cumsum(size)[:-1])], atol=1e-5)
    monkeypatch.setattr(G, "WORD_CELLS", 7)
    assert np.allclose(G._word_scores(model, grams, size), whole, atol=1e-6)
