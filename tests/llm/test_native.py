import duckdb
import pytest
from pyspark.sql import functions as F

from quartz_panel.llm import exact_dedup as X
from quartz_panel.llm import packing as K
from quartz_panel.llm import quality as Q
from quartz_panel.llm import queries as L

ROWS = [
    (1, "Same text", "a", "h"), (2, "same TEXT", "a", "h"), (3, "same text ", "a", None), (4, None, "a", "h"), (5, "", None, "h"), (6, "Éa", "a", "h"), (7, "éa", "a", "h"),
    (8, "x " * 30_000, "a", "h"), (8, "x " * 30_000, "a", "h"), (None, "lone", "a", "h"),
]


def rows(spark, data=ROWS):
    return spark.createDataFrame(data, "doc_id long, text string, keep_id string, source string")


@pytest.mark.parametrize("digest", [X.sha256_digest, lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 1)), lambda t: F.lit(b"x")])
def test_exact_groups_whatever_the_digest(spark, digest):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in X.exact_dedup(rows(spark), digest=digest).collect()}
    assert got == {(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 1, True), (7, 7, 1, True), (8, 8, 2, True), (None, None, 1, True)}
    assert X.exact_dedup(rows(spark), digest=digest).count() == len(ROWS)


def test_smallest_and_deduplicated(spark):
    assert {r.doc_id for r in X.exact_dedup(rows(spark), "smallest").filter("kept").collect()} == {1, 3, 4, 6, 7, 8, None}
    kept = X.deduplicated(rows(spark))
    assert kept.columns == ["doc_id", "text", "keep_id", "source"] and {r.doc_id for r in kept.collect()} == {2, 3, 5, 6, 7, 8, None}
    for n in (0, 8 << 20):
        assert X.deduplicated(rows(spark), most_broadcast_bytes=n).count() == kept.count()
    assert X.exact_dedup(rows(spark, [])).count() == 0
    assert [r.doc_id for r in X.deduplicated(rows(spark)).collect()].count(8) == 1
    again = X.deduplicated(rows(spark, [(1, "t", "a", "h"), (1, "T", "b", "h"), (None, "u", "a", "h"), (None, "u", "a", "h"), (2, "v", "a", "h")]))
    assert sorted((r.doc_id, r.text.lower()) for r in again.filter("doc_id is not null").collect()) == [(1, "t"), (2, "v")] and again.count() == 3


def test_index_runs_merge_and_answer(spark, tmp_path):
    path = str(tmp_path / "index")
    X.flush(rows(spark, ROWS[:2]), path)
    X.flush(rows(spark, ROWS[2:]), path)
    index = X.compact(spark, path)
    assert index.agg(F.sum("n")).first()[0] == len(ROWS)
    assert [r.doc_id for r in X.probe(rows(spark, [(99, "SAME text", "", ""), (98, "new", "", "")]), index).collect()] == [99]


def brute_repeat(text):
    w = text.split()
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)})


def test_quality_counts(spark):
    texts = ["a b c a b c d", "a a a a", "a b", "", None, "x y z q x y z x y", "\n".join(["one line here"] * 3 + ["  ", "", "other"]), "#$ %& <|> * é", "p q r s t u v w"]
    got = {r.doc_id: r.quality for r in Q.quality_rules(rows(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        assert got[i].n_words == len(t.split()) and got[i].word_chars == len("".join(t.split()))
        assert got[i].n_repeat_words == brute_repeat(t), t
        lines = [x for x in t.split("\n") if x.strip()]
        assert got[i].n_dup_lines == len(lines) - len(set(lines)) and got[i].base_failed and not got[i].kept
    assert got[7].n_symbols == 8
    assert got[4].clean_text is None


@pytest.mark.parametrize("broadcast", [0, 8 << 20])
def test_boilerplate_goes_but_for_one_carrier(spark, broadcast):
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    data = [(i, f"{body(i)}\nShare  THIS page", None, "h") for i in range(6)] + [(9, f"{body(9)}\nshare this page", None, "other"), (10, f"{body(0)}\nShare  THIS page", None, "h")]
    data += [(20 + i, "\n".join(f"nav item {k}" for k in range(30)) + f"\ntail {i}", None, "h") for i in range(5)]
    got = {r.doc_id: r.quality for r in Q.quality_rules(rows(spark, data), limit=4, most_broadcast_bytes=broadcast).collect()}
    gone = [i for i in (*range(6), 10) if got[i].n_removed_lines]
    assert len(gone) in (5, 6) and got[0].n_removed_lines == got[10].n_removed_lines and got[9].n_removed_lines == 0
    assert all(got[i].clean_text == body(i if i < 10 else 0) and got[i].kept for i in gone)
    assert sum(got[20 + i].kept for i in range(5)) == 1  # one carrier keeps the lines, the others are depleted


@pytest.mark.parametrize("broadcast", [0, 8 << 20])
def test_quality_carries_clashing_columns(spark, broadcast):
    names = ["doc_id", "text", "source", "quality", "row", "kept", "__text", "__w", "__id", "__losing"]
    body = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(6))
    df = spark.createDataFrame([(1, f"{body}\nmenu", "h", *range(7)), (2, f"{body} y\nmenu", "h", *range(7)), (3, None, None, *range(7))], names)
    got = {r.doc_id: r for r in Q.quality_rules(df, limit=1, most_broadcast_bytes=broadcast).collect()}
    assert all(r.row.quality == 0 and r.row.kept == 2 and r.row["__losing"] == 6 for r in got.values())
    assert sorted(got[i].quality.n_removed_lines for i in (1, 2)) == [0, 6] and got[3].quality.clean_text is None


def test_quality_of_one_very_long_text(spark):
    text = " ".join(f"w{i % 70_000}" for i in range(210_000))
    got = Q.quality_rules(rows(spark, [(1, text, None, None)])).first().quality
    assert got.n_words == 210_000 and got.n_repeat_words == 210_000 and got.clean_text == text


def brute_boundaries(hist, k):
    import itertools

    lengths = sorted(hist)
    best = None
    for n in range(1, min(k, len(lengths)) + 1):
        for chosen in itertools.combinations(lengths[:-1], n - 1):
            bounds = [*chosen, lengths[-1]]
            cost = sum(c * (min(b for b in bounds if b >= size) - size) for size, c in hist.items())
            best = cost if best is None else min(best, cost)
    return best


def test_packing_is_optimal_and_whole(spark):
    import random

    rng = random.Random(2)
    for _ in range(30):
        hist = {rng.randint(1, 40): rng.randint(1, 9) for _ in range(rng.randint(1, 9))}
        for k in (1, 2, 3):
            bounds = K.best_boundaries(list(hist), list(hist.values()), k)
            assert len(bounds) <= k and sum(c * (min(b for b in bounds if b >= n) - n) for n, c in hist.items()) == brute_boundaries(hist, k)
    data = [(i, " ".join(["w"] * rng.randint(0, 70)), None, None) for i in range(200)] + [(500, None, None, None)]
    out = K.packed(rows(spark, data), buckets=3, longest=32, token_budget=100, shard_rows=40).collect()
    total = {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        assert r.n_tokens == 0 and r.batch is None or r.padding == r.bucket_len - r.n_tokens >= 0
    assert total == {d[0]: len((d[1] or "").split()) for d in data}
    batches = {}
    for r in out:
        if r.batch:
            batches.setdefault(r.batch, []).append(r)
    for rs in batches.values():
        assert sum(r.bucket_len for r in rs) <= 100 and sorted(r.slot for r in rs) == list(range(len(rs)))
    assert K.packed(rows(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(L.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(L.oracle_sql()[name])
    got = L.queries()[name](spark, "/root/testdata/sf0.001")
    assert sorted(want.columns) == sorted(got.columns)
    columns = sorted(want.columns)
    assert sorted(want.select(*columns).fetchall(), key=str) == sorted(map(tuple, got.select(*columns).collect()), key=str)
