"""Alignment against whole-text calls of both libraries with decoded bytes only."""

import hashlib
from collections import Counter

import pytest

from quartz_panel.llm import token_alignment as T


def paths():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths()[0])
    a.encode_special_tokens = True
    alphabet = T.byte_alphabet()
    entry = {k: v for v, k in a.get_vocab().items()}
    b = sentencepiece.SentencePieceProcessor(model_file=paths()[1])

    def piece(k):
        p = b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()

    return (lambda t: a.encode(t, add_special_tokens=False).ids), (lambda k: bytes(alphabet[c] for c in entry[k])), b.encode, piece


def brute(texts, libraries):
    ids_a, bytes_a, ids_b, bytes_b = libraries
    rows, total = [], Counter()
    for t in texts:
        groups, links = [], []
        a, b = (ids_a(" " + t), ids_b(t)) if t else ([], [])
        whole = (" " + t).encode() if t else b""
        if t and b"".join(map(bytes_a, a)) == whole == b"".join(map(bytes_b, b)):
            i = j = at_a = at_b = 0
            group = ([], [])
            while i < len(a) or j < len(b):
                if at_a <= at_b and i < len(a):
                    at_a += len(bytes_a(a[i]))
                    group[0].append(a[i])
                    i += 1
                else:
                    at_b += len(bytes_b(b[j]))
                    group[1].append(b[j])
                    j += 1
                if at_a == at_b:
                    groups.append(group)
                    links.append((group[0][-1], group[1][-1]))
                    group = ([], [])
        else:
            a, b = [], []
        total.update(links)
        rows.append((len(a), len(b), groups, links))
    best = {}
    for (_, b), n in total.items():
        best[b] = max(n, best.get(b, 0))
    out = []
    for n_a, n_b, groups, links in rows:
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(total[x] == best[x[1]] for x in links), sum(total[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    return out


TEXTS = [
    "The mill on the river was built in 1847.",
    None,
    "",
    " ",
    "  two  spaces   three\t tab \n newline\n\n  more\r\n end  ",
    "a b 　c  d\u0085 e\x1c f\x1f  g",
    "café 你好 \U0001f600\U0001f680 ② \U0001f469‍\U0001f467 กำ x́",
    "②",
    "literal ▁ mark x▁y",
    "special <|endoftext|> and <s> </s> <0x41> <unk> strings",
    "nul \x00 byte",
    "x" * 5000 + "\U0001f600" * 300 + " tail",
    "你好" * 3000,
    "The mill on the river was built in 1847.",
    "isn't we'll DON'T 'quoted' 12,345.67 (a) [b] {c} a_b-c/d\\e",
    "퟿\U0010ffff",
    "word " * 3000,
]


@pytest.mark.parametrize(("hot", "most", "weight"), [(T.HOT, 400_000, 6 << 20), (4, 16, 64), (40, 7, 1 << 20)])
def test_equals_whole_text_calls(spark, libraries, monkeypatch, hot, most, weight):
    docs = spark.createDataFrame([(k % 11, t, "n", 3, "p") for k, t in enumerate(TEXTS)] + [(None, TEXTS[0], "n", 3, "p")], "doc_id int, text string, row string, n_a int, pairs string").repartition(3)
    init = T.Stretches.__init__
    monkeypatch.setattr(T.Stretches, "__init__", lambda self, a, b: init(self, a, b, weight))
    T._held.clear()
    got = T.token_alignment(docs, *paths(), hot=hot, most=most).collect()
    texts = [*TEXTS, TEXTS[0]]
    want = [(None if k == len(TEXTS) else k % 11, *r) for k, r in enumerate(brute(texts, libraries))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_stretches_equal_whole_texts(libraries):
    of = T.Stretches(*paths())
    assert not of.whole
    for t in TEXTS:
        if t:
            parts = list(of.split(t))
            assert "".join(parts) == " " + t
            of.learn(set(parts).difference(of.known))
            got = "".join(of.text[of.known[p]] for p in parts)[:-1] if all(of.counts[of.known[p], 3] for p in parts) else ""
            assert (hashlib.sha256(got.encode()).hexdigest() if got else "") == brute([t], libraries)[0][-1]


def test_groups_cover_texts(spark, libraries):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in T.aligned_groups(docs, *paths()).collect():
        t = TEXTS[r.doc_id]
        want = brute([t], libraries)[0]
        assert len(r.groups) == want[2] and sum(len(g.a) for g in r.groups) == want[0] and sum(len(g.b) for g in r.groups) == want[1]
        if r.groups:
            assert [g.start for g in r.groups] == [0, *(g.end for g in r.groups[:-1])] and r.groups[-1].end == len(t.encode()) + 1
            for g in r.groups:
                piece = (" " + t).encode()[g.start : g.end]
                assert b"".join(map(libraries[1], g.a)) == b"".join(map(libraries[3], g.b)) == piece


def test_empty_table_and_texts_without_tokens(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert T.token_alignment(docs.limit(0), *paths()).collect() == []
    assert sorted(map(tuple, T.token_alignment(docs, *paths()).collect())) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2, 3)]


def test_query_equals_brute_force(spark, libraries):
    from quartz_panel.llm import queries as Q

    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: x for r, x in zip(rows, brute([r.text for r in rows], libraries), strict=True)}
    got = {r.doc_id: tuple(r)[1:] for r in Q.op11_token_alignment(spark, d).collect()}
    assert got == want
