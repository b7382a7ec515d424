"""Bucketed history, added names by insertion, the trained scorer."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quartz_panel.operators import crosssection as X
from quartz_panel.operators import insertion as I
from quartz_panel.operators import text_scorer as C
from quartz_panel.operators.asof import asof_join, resolved, timeline
from quartz_panel.plans import intake_queries as Q
from quartz_panel.sources import history as H


def test_history_is_built_once_and_read_without_a_shuffle(spark, tmp_path):
    built, symbols = [], [uuid.uuid4().hex]

    def store(name, n, **more):
        def build():
            built.append(name)
            return spark.range(n).select((F.col("id") % 17).alias("ticker_id"), F.expr("date_add(DATE '2020-01-01', cast(id as int))").alias("at"), F.col("id").alias(f"v_{name}"))

        return H.bucketed_history(spark, str(tmp_path), name, symbols, build, "ticker_id", "at", 4, **more)

    a, b = store("a", 400), store("b", 90)
    assert built == ["a", "b"] and store("a", 5).count() == 400 and built == ["a", "b"]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = H.bucketed_history(spark, str(tmp_path), "both", symbols, lambda: timeline(a, b, ["ticker_id"], "at", "at", ["v_b"]), "ticker_id", "__ts", 4)
        known = resolved(both, ["ticker_id"], ["v_b"])
        assert sorted(known.collect()) == sorted(asof_join(a, b, ["ticker_id"], "at", "at", ["v_b"]).collect())
        for df in (a.join(b, "ticker_id"), a.groupBy("ticker_id").count(), known):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # a session that doesn't know the table reads it by its buckets, too
    name = [t.name for t in spark.catalog.listTables() if t.name.startswith("a_")][0]
    spark.sql(f"DROP TABLE {name}")
    again = store("a", 5)
    assert built == ["a", "b"] and again.count() == 400
    assert "Exchange" not in again.groupBy("ticker_id").count()._jdf.queryExecution().executedPlan().toString()
    assert store("a", 7, refresh=True).count() == 7 and built == ["a", "b", "a"]


def score(rows):
    return rows.withColumn("score", F.round(F.col("f") - F.coalesce("g", F.lit(0.0)) / 2, 9))


@pytest.mark.parametrize("most", [100_000, 0])
def test_insertion_equals_ranking_all_anew(spark, monkeypatch, most):
    """Ties, nulls, an old row of the added name, two dates, a date without members."""
    monkeypatch.setattr(I, "MOST_BROADCAST_ROWS", most)
    rng = random.Random(5)
    value = lambda: rng.choice([None, *[float(i) for i in range(6)]])
    schema = "date int, ticker_id int, f double, g double"
    members = [(d, t, value(), value()) for d in (1, 2) for t in range(12)]
    fresh = [(1, 3, 2.0, None), (2, 3, None, 4.0), (1, 50, 5.0, 5.0), (2, 51, 0.0, 1.0), (3, 52, 1.0, 1.0)]
    stored = I.stored_ranks(spark.createDataFrame(members, schema), ["f", "g"])
    got = {(r.date, r.added_id, r.ticker_id): (r.f, r.g) for r in I.inserted(stored, spark.createDataFrame(fresh, schema), ["f", "g"]).collect()}
    asked = spark.createDataFrame([(t,) for t in (3, 50, 51, 52, 99, 99)], "ticker_id int")
    ranks = {(r.date, r.ticker_id): (r.relative_rank, r.status) for r in I.score_added(stored, asked, spark.createDataFrame(fresh, schema), ["f", "g"], score).collect()}
    seen = 0
    for row in fresh:
        together = spark.createDataFrame([m for m in members if m[0] == row[0] and m[1] != row[1]] + [row], schema)
        anew = score(X.rank_normalize(together, ["f", "g"]))
        for r in anew.collect():
            assert got[row[0], row[1], r.ticker_id] == (r.f, r.g)
            seen += 1
        mine = X.rank01(anew, ["date"], "score", "rank").filter(F.col("ticker_id") == row[1]).first()
        at, status = ranks[row[0], row[1]]
        assert status == "scored" and (at is None) == (mine["rank"] is None) and (at is None or abs(at - mine["rank"]) < 1e-12)
    assert seen == len(got) and ranks[None, 99] == (None, "insufficient_history") and len(ranks) == 6


def test_only_members_that_a_name_could_pass_are_scored_again(spark):
    """With ``reach``: equal results for ties, nulls, old rows, several dates and few members; rows that are scored don't grow as names x members."""
    rng = random.Random(7)
    schema = "date int, ticker_id int, f double, g double"
    few = lambda: rng.choice([None, *[float(i) for i in range(4)]])
    sizes = {1: 300, 2: 40, 3: 3, 4: 1}
    members = [(d, t, few(), few()) if d % 2 == 0 or t % 3 == 0 else (d, t, rng.random(), rng.random()) for d, n in sizes.items() for t in range(n)]
    fresh = [(d, t, few() if t % 2 else rng.random(), few() if t % 4 else rng.random()) for d in (1, 2, 3, 4, 5) for t in (*range(10), *range(300, 340))]
    stored, asked, new = I.stored_ranks(spark.createDataFrame(members, schema), ["f", "g"]), spark.createDataFrame([(t,) for t in range(400)], "ticker_id int"), spark.createDataFrame(fresh, schema)
    tried = spark.sparkContext.accumulator(0)

    def counting(rows):
        seen = F.udf(lambda x: tried.add(1) or x, "double")
        return score(rows).withColumn("score", seen("score"))

    want = {(r.ticker_id, r.date): (r.relative_rank, r.n_ranked, r.status) for r in I.score_added(stored, asked, new, ["f", "g"], score).collect()}
    got = {(r.ticker_id, r.date): (r.relative_rank, r.n_ranked, r.status) for r in I.score_added(stored, asked, new, ["f", "g"], score, {"f": 1.0, "g": 0.5}).collect()}
    assert got == want and len(want) == 250 + 350
    big = spark.createDataFrame([(1, t, rng.random(), rng.random()) for t in range(2000)], schema)
    many = spark.createDataFrame([(1, t, rng.random(), rng.random()) for t in range(2000, 2200)], schema)
    I.score_added(I.stored_ranks(big, ["f", "g"]), many.select("ticker_id"), many, ["f", "g"], counting, {"f": 1.0, "g": 0.5}).collect()
    assert 0 < tried.value < 2000 * 200 / 10


def test_no_fresh_rows(spark):
    schema = "date int, ticker_id int, f double, g double"
    stored = I.stored_ranks(spark.createDataFrame([(1, 1, 1.0, 1.0)], schema), ["f", "g"])
    none = I.score_added(stored, spark.createDataFrame([(7,)], "ticker_id int"), spark.createDataFrame([], schema), ["f", "g"], score).collect()
    assert [(r.ticker_id, r.status) for r in none] == [(7, "insufficient_history")]


def test_scorer_beats_the_base_rate_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    held = Q.labelled_texts(spark, d).filter("held_out").select("doc_id", "class").join(entry.queries()["u01_trained_scorer"](spark, d), "doc_id").toPandas()
    best = held[["p_pos", "p_neg", "p_neu"]].to_numpy().argmax(1)
    right = np.mean(np.array(C.CLASSES)[best] == held["class"])
    assert right > held["class"].value_counts(normalize=True).max() + 0.03
    assert np.allclose(held[["p_pos", "p_neg", "p_neu"]].sum(1), 1)


def test_buckets_agree_and_edge_cases(spark):
    texts = ["The CAT sat, the cat SAT.", "Über straße 日本", "", None, "12 !?", "x" * 100_000]
    rows = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(zip(texts, ["pos", "neg", "pos", None, "neg", "pos"], strict=True))], "id int, text string, k string")
    weights = C.fit_text_scorer(rows, "text", "k", buckets=64)
    mine = C.HashedLogistic(spark.sparkContext.broadcast((np.eye(1, 64), np.zeros(1))))
    for r in rows.select("text", C.hashed_words(F.col("text"), 64).alias("w")).collect():
        hit = {j for j in range(64) if _one(mine, j, r.text)}
        assert hit == {int(w) for w in r.w}
    got = C.HashedLogistic(spark.sparkContext.broadcast(weights))(texts)
    assert len(got) == 6 and all(abs(sum(p) - 1) < 1e-9 and p[2] < 1e-6 for p in got) and mine([]) == []


def _one(scorer, bucket, text):
    """Whether a text has a word in a bucket, by a model of two classes one of which has a weight there alone."""
    scorer.weights = type("W", (), {"value": (np.stack([np.eye(1, 64, bucket)[0], np.zeros(64)]), np.zeros(2))})
    return scorer([text])[0][0] > 0.5
