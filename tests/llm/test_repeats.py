import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartz_panel.llm import queries as L
from quartz_panel.llm import substring_dedup as R
from quartz_panel.llm import suffix_dedup as S


def corpus(seed, unit, n=60):
    rng = random.Random(seed)
    passages = [[unit(rng) for _ in range(rng.randint(8, 60))] for _ in range(5)]
    out = []
    for i in range(n):
        w = [unit(rng) for _ in range(rng.choice([0, 3, 30, 100]))]
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = unit(rng)
            k = rng.randint(0, len(w))
            w[k:k] = p[rng.randint(0, 4) :]
        if out and rng.random() < 0.2:
            w = list(rng.choice(out)[1])
            if w and rng.random() < 0.5:
                w[rng.randrange(len(w))] = unit(rng)
        if rng.random() < 0.15:
            w += [unit(rng)] * rng.choice([7, 30]) + [unit(rng), unit(rng)] * rng.choice([5, 20])
        out.append((900 - 3 * i, w))
    return out


def brute_first(data, window):
    """Words kept, for sequences by doc_id."""
    seen, out = set(), {}
    for d, w in sorted(data):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[d] = (len(w), sum(gone), [x for x, g in zip(w, gone) if not g])
    return out


def brute_all(data, window):
    count, out = {}, {}
    for _, t in data:
        for i in range(len(t) - window + 1):
            count[t[i : i + window]] = count.get(t[i : i + window], 0) + 1
    for d, t in data:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        out[d] = (len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), bytes(x for x, g in zip(t, gone) if not g))
    return out


@pytest.mark.parametrize("seed,window", [(1, 20), (2, 6), (3, 20), (4, 3)])
def test_words_equal_brute_force(spark, seed, window):
    data = corpus(seed, lambda r: r.choice(["a", "b", "é", "The", *(f"w{i}" for i in range(seed * 12))]))
    df = spark.createDataFrame([(d, " \n".join(w), 0) for d, w in data] + [(9000, None, 0), (9001, "", 0)], "doc_id long, text string, first int")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text.split()) for r in R.substring_dedup(df, window, most_broadcast_bytes=seed % 2 << 20).collect()}
    want = brute_first(data, window) | {9000: (0, 0, []), 9001: (0, 0, [])}
    assert got == want


@pytest.mark.parametrize("seed,window,gram", [(1, 40, 12), (2, 200, 50), (3, 12, 5)])
def test_bytes_equal_brute_force(spark, seed, window, gram):
    data = [(d, "".join(w)) for d, w in corpus(seed, lambda r: r.choice("abcdeé") * r.choice([1, 1, 1, 9 if seed > 1 else 2]))]
    data += [(5000, "z" * 500), (5001, "y" * window), (5002, "x" * (window + 1))]
    df = spark.createDataFrame([(d, t, 0) for d, t in data] + [(9000, None, 0)], "doc_id long, text string, removed int")
    got = {r.doc_id: (r.n_bytes, sum(x["last"] - x["first"] + 1 for x in r.removed), len(r.removed), bytes(r.kept)) for r in S.suffix_dedup(df, window, gram, most_broadcast_bytes=seed % 2 << 20).collect()}
    assert got == brute_all([(d, t.encode()) for d, t in data], window) | {9000: (0, 0, 0, b"")}


def test_long_texts_in_pieces(monkeypatch):
    import pyarrow as pa

    rng = random.Random(8)
    text = " ".join(rng.choice(["a", "b", "c", "d"]) for _ in range(900))
    batch = pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([text])], names=["doc_id", "text"])
    windows = lambda rows: sorted(w for b in rows for r in b.to_pylist() for w in range(r["place"] >> 20, (r["place"] >> 20) + r["place"] % (1 << 20) + 1))
    assert windows(R._anchors([batch], 20, 6, most=100)) == windows(R._anchors([batch], 20, 6)) == list(range(881))
    monkeypatch.setattr(S, "MOST", 300)
    assert windows(S._anchors([batch], 200, 50)) == list(range(len(text) - 199))


def test_symbols_are_settled_by_their_stretch():
    """Any text that holds a symbol's stretch gives the same symbol there."""
    rng = np.random.default_rng(6)
    h = rng.integers(1, 6, 400).astype(np.uint64)
    levels = list(R.symbols(h, np.array([0]), 6))
    for level, (low, high) in enumerate(levels):
        for a, b in list(zip(low, high))[::7]:
            if a >= 0 and b <= len(h) and b - a < 40:
                other = np.concatenate([rng.integers(1, 6, 13).astype(np.uint64), h[a:b], rng.integers(1, 6, 11).astype(np.uint64)])
                assert (13, 13 + b - a) in set(zip(*map(np.ndarray.tolist, list(R.symbols(other, np.array([0]), 6))[level]))), level


def test_repeated_rows_and_empty(spark):
    t = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in R.substring_dedup(df).collect()) == [("1", 0), ("1", 0), ("2", 40), ("None", 0)]
    assert R.substring_dedup(df.limit(0)).count() == 0 and S.suffix_dedup(df.limit(0)).count() == 0


def adversarial():
    """Words of 1024 letters that a polynomial modulo 2**64 can't tell apart, whatever its base."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_are_told_apart(spark):
    x, y = adversarial()
    tail = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{x} {tail}"), (2, f"{y} {tail}"), (3, f"{y} {tail}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in R.substring_dedup(df).collect()} == {1: 0, 2: 0, 3: 20}


@pytest.mark.parametrize("n", [60, 300])
def test_hot_passages_of_many_surroundings(spark, n):
    """One passage in every document between words of its own: more contents under a key than are dealt together."""
    rng = random.Random(n)
    passage = [f"p{i}" for i in range(30)]
    data = [(i, [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 9))] + passage + [f"v{rng.randrange(10**6)}" for _ in range(rng.randint(0, 9))]) for i in range(n)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in data], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text.split()) for r in R.substring_dedup(df, 20).collect()}
    assert got == brute_first(data, 20)
    got = {r.doc_id: (r.n_bytes, sum(x["last"] - x["first"] + 1 for x in r.removed), len(r.removed), bytes(r.kept)) for r in S.suffix_dedup(df, 60, 15).collect()}
    assert got == brute_all([(d, " ".join(w).encode()) for d, w in data], 60)


def test_columns_of_any_name_are_carried(spark):
    df = spark.createDataFrame([(1, "a b", 7, 8, 9)], ["doc_id", "text", "__none", "carried", "ranges"])
    got = R.substring_dedup(df).first().carried
    assert (got["__none"], got["carried"], got["ranges"]) == (7, 8, 9)
    assert "carried" not in R.substring_dedup(df.select("doc_id", "text")).columns


def test_queries_on_given_documents(spark):
    d = "/root/testdata/sf0.001"
    data = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {(k, n, m, sha(" ".join(w).encode())) for k, (n, m, w) in brute_first([(k, re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in data], 20).items()}
    assert {tuple(r) for r in L.op10_substring_dedup(spark, d).collect()} == want
    assert any(m for _, _, m, _ in want)
    want = {(k, n, m, s, sha(b)) for k, (n, m, s, b) in brute_all([(k, t.encode()) for k, t in data], 200).items()}
    assert {tuple(r) for r in L.op2_suffix_dedup(spark, d).collect()} == want


def test_ranges_of_many_texts_are_not_sent_to_all_tasks(spark):
    """14,000 texts with a range each, 1.1 MB: shuffled to, as in larger inputs, so that what is shuffled grows as the input."""
    name = F.sha2(F.shiftright("id", 1).cast("string"), 512)
    docs = spark.range(14_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 13_998, F.concat(name, name)).otherwise(F.concat(F.sha2(F.col("id").cast("string"), 512), name)).alias("text"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many, few = S.suffix_dedup(docs), S.suffix_dedup(docs.filter("doc_id < 100"))
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (many, few)]
        got = {r.doc_id: len(r.kept) for r in many.select("doc_id", "kept").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert got == {k: 0 if k < 13_998 else 256 for k in range(14_000)}
    assert "LeftOuter" not in plans[0] and "SortMergeJoin" in plans[0]
    assert "LeftOuter" in plans[1] and "SortMergeJoin" not in plans[1]  # few ranges are sent, and no text is shuffled
