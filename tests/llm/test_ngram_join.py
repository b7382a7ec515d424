import random
import re

import pytest
from pyspark.sql import functions as F

from quartz_panel.llm import components as C
from quartz_panel.llm import ngram_join as J
from quartz_panel.llm import queries as L


def shingles(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(data, percent=90, n=3):
    sets = [shingles(t, n) for _, t in data]
    parent = list(range(len(data)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        least[find(i)] = min(least.get(find(i), d), d)
    return {(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(data)}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["The", "of"]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.55:
            w = list(rng.choice(texts))
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind < 0.7:
            w = passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 20))]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 20, 60, 150]))]
        texts.append(w)
        out.append((1000 - 7 * i, " ".join(w)))
    return out


@pytest.mark.parametrize("seed,frequent", [(1, 50), (2, 2), (3, 0), (4, 5)])
def test_equals_brute_force(spark, seed, frequent):
    data = [*corpus(seed), (5000, ""), (5001, None), (5002, "A  b\tc"), (5003, "a b C"), (5004, "x"), (5005, "X")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in data], "doc_id long, text string, n long, component long")
    s = J.Setting(frequent=frequent, zone=256 if frequent < 50 else 51)
    got = {tuple(r) for r in J.ngram_jaccard_join(df, s, most_broadcast_bytes=seed % 2 * 1000).collect()}
    assert got == brute(data)


def test_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (0, "a b c d")], "doc_id long, text string")
    assert sorted((tuple(r) for r in J.ngram_jaccard_join(df).collect()), key=str) == [(0, 2, 0), (1, 2, 0), (1, 2, 0), (None, 2, None)]
    assert J.ngram_jaccard_join(df.limit(0)).count() == 0


def test_words_are_told_apart(spark):
    from .test_repeats import adversarial

    x, y = adversarial()
    df = spark.createDataFrame([(1, f"{x} x y"), (2, f"{y} x y"), (3, f"{x} X  y")], "doc_id long, text string")
    assert {tuple(r) for r in J.ngram_jaccard_join(df).collect()} == {(1, 1, 1), (2, 1, 2), (3, 1, 1)}
    tail = " ".join(f"w{i}" for i in range(40)).encode()
    assert not J.linked(b"a b " + tail[:60], b"c d " + tail[60:], J.Setting()) and J.linked(b"A " + tail, b"b " + tail, J.Setting())


def test_rows_that_share_an_id_count_as_one_document(spark):
    long = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, long), (1, "x y z"), (2, long), (3, "x  Y z")], "doc_id long, text string")
    got = {tuple(r) for r in J.ngram_jaccard_join(df).collect()}
    assert got in ({(1, 38, 1), (2, 38, 1), (3, 1, 3)}, {(1, 1, 1), (3, 1, 1), (2, 38, 2)})


def test_production_setting_indexes_combinations(spark):
    """Near copies of one text in more documents than a token may have: all their tokens are frequent."""
    rng = random.Random(5)
    data = []
    for base in range(2):
        w = [f"b{base}w{i}" for i in range((400, 20)[base])]
        for i in range(80):
            v = list(w)
            for _ in range((8, 1)[base] if i else 0):
                v[rng.randrange(len(v))] = f"e{rng.randrange(10**6)}"
            data.append((1000 * base + i, " ".join(v)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    held, index = [], J.indexed
    J.indexed = lambda *a: held.append(index(*a).groupBy("short").agg(F.sum((F.col("combined") > 0).cast("int"))).collect()) or index(*a)
    try:
        got = {tuple(r) for r in J.ngram_jaccard_join(df).collect()}
    finally:
        J.indexed = index
    assert held[0][0][1] > 80 and got == brute(data)


def test_one_very_long_text(spark):
    words = [f"w{i % 7919}" for i in range(60_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-50], *["end"] * 50])), (3, "w1 w2 w3")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in J.ngram_jaccard_join(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_components(spark):
    rng = random.Random(9)
    chain = [(i, i + 1) for i in range(100)] + [(1000, rng.randint(1001, 1400)) for _ in range(60)] + [(500, 500)]
    rng.shuffle(chain)
    got = {r.node: r.component for r in C.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(101)) and all(v == 1000 for k, v in got.items() if k >= 1000) and 500 not in got


def test_later_links_give_the_components_of_all_links(spark):
    rng = random.Random(4)
    old, new = ([(rng.randrange(300), rng.randrange(300)) for _ in range(90)] for _ in range(2))
    new += [new[0], (7, 7), (900, 901)]
    table = lambda links: spark.createDataFrame(links, "a long, b long")
    keep = C.Scratch(spark)
    parts = C.connected_components(table(old), keep)
    got = {r.node: r.component for r in C.with_links(parts, table(new), keep).collect()}
    least = {v: v for link in old + new for v in link}
    for _ in least:
        for a, b in old + new:
            least[a] = least[b] = min(least[a], least[b])
    linked = {v for a, b in old + new for v in (a, b) if a != b}
    assert all(got[v] == least[v] for v in linked) and all(got[v] == v for v in got.keys() - linked)


def test_query_on_given_documents(spark):
    d = "/root/testdata/sf0.001"
    data = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in L.op1_ngram_join(spark, d).collect()} == brute(data)
