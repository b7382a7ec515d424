import base64
import random

import pytest

P = pytest.importorskip("public_tokenizers")

from quartz_panel.llm import byte_bpe, token_counts  # noqa: E402

TEXTS = ["", None, "Hello world's  end\n\n x", "a" * 3000, "<|endoftext|> and <|endoft", "été naïve ²³ 日本語 テスト 🙂  x", "'s't 're  \t\n ", "xy " * 2000 + "日本" * 900, "$$$###  !!", "   ", "\x00\x85\xa0 a"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def reference_counts(texts, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    t.no_truncation(), t.no_padding()
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_equal_the_library(spark, name):
    got = {r.doc_id: r for r in token_counts.token_counts(docs(spark, TEXTS), P.path(name), limit=100, chunk=64, overlap=4).collect()}
    want = reference_counts(TEXTS, name)
    assert [got[i].n_tokens for i in range(len(TEXTS))] == want
    assert [got[i].n_bytes for i in range(len(TEXTS))] == [len((t or "").encode()) for t in TEXTS]
    assert [got[i].over_limit for i in range(len(TEXTS))] == [n > 100 for n in want]


def test_splices_equal_one_scan():
    rng, pattern_of = random.Random(3), token_counts.splitter()
    for _ in range(300):
        text = "".join(rng.choice(["a", " ", "\n", "'s", "12", "é", "!", "longword" * 3, "   ", "日"]) for _ in range(rng.randint(1, 120)))
        pattern = pattern_of(text)
        for chunk, overlap in ((5, 1), (16, 3), (40, 8)):
            assert [p for part in token_counts.spliced_pieces(text, pattern, chunk, overlap) for p in part] == pattern.findall(text)


def test_quick_pattern_agrees():
    import regex

    full = regex.compile(P.PATTERN)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randint(0, 0x2C1), rng.randint(0x20, 0x7E), 0x20, 0x0A, 0x27, 0x73])) for _ in range(80))
        assert token_counts.splitter()(text) is not full
        assert token_counts.splitter()(text).findall(text) == full.findall(text)


def test_bpe_equals_tiktoken_and_round_trips(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = [*TEXTS, "ab" * 700, "x" * 257, *("".join(rng.choice("aeinrstéß ñ.") for _ in range(rng.randint(1, 600))) for _ in range(60))]
    out = byte_bpe.decode(byte_bpe.encode(docs(spark, texts), path), path).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r.ids == own.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()


def test_empty_table(spark):
    assert token_counts.token_counts(docs(spark, []), P.path("byte_bpe_50k.json")).count() == 0
    path = P.path("byte_bpe_multi_50k.tiktoken")
    assert byte_bpe.decode(byte_bpe.encode(docs(spark, []), path), path).count() == 0
