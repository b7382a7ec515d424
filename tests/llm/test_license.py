import re

import pytest

from quartz_panel.llm import license_scan as S

ROWS = [
    "Licensed under the Apache License, Version 2.0.",
    "x MIT license, mit LICENSE\nGeneral\tpublic license",
    "This work is licensed under the GNU General Public License, version 3.",
    "This work is licensed under the GNU Lesser General Public License",
    "Released under the terms of the MIT License",
    "under the altered MIT license",
    "Licensed under CC BY-NC 4.0.",
    "licensed under CC BY 4.0",
    "Copyright 2020 Some Body. All rights reserved",
    "copyright a b c d e f g all rights reserved",
    "", None, "émit license", "mit_license mit license9", "word " * 50_000 + "apache license",
]


def test_automata():
    a = S.compiled("a [[b [[c]]]] {{2}} d")
    for words, end in (("a d", 2), ("a b d", 3), ("a b c d", 4), ("a c d", 3), ("a x y d", 4), ("a b c x y d", 6), ("a x y z d", -1), ("b d", -1), ("a b c", -1)):
        assert a.longest_from(words.encode().split(), 0) == end, words
    for bad in ("[[a", "[[a]]"):
        with pytest.raises(ValueError):
            S.compiled(bad)


def brute(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for i in range(len(words)) for p, label in S.BASE_PHRASES.items() if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(hits)


def test_base_and_templates(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ROWS)], "doc_id long, text string, matches int")
    got = {r.doc_id: r for r in S.license_scan(df).collect()}
    for i, t in enumerate(ROWS):
        assert (got[i].n_words, sorted((b.first_word, b.label) for b in got[i].base)) == brute(t), t
    labels = {i: {m.label for m in got[i].matches} for i in got}
    assert labels[0] == {"apache-2.0", "apache-other"} and labels[2] == labels[3] == {"gpl-notice"} and labels[4] == {"mit-notice"}
    assert labels[5] == set() and "cc-by-nc" in labels[6] and "cc-by" in labels[7] and labels[8] == {"rights-reserved"} and labels[9] == set()
    assert [(m.first_word, m.end_word) for m in got[2].matches] == [(0, 12)]
    assert S.license_scan(df.limit(0)).count() == 0


WHOLE = ("mit-text", "isc-text", "bsd-2-text", "bsd-3-text", "apache-2.0-header", "mpl-2.0-header", "gpl-header", "zlib-text", "unlicense-text")


def filled(template, optional, names):
    """A text of the template: optional wording in or out, ``names`` words in each replaceable region."""
    text = re.sub(r"\[\[(.*?)\]\]", r"\1" if optional else "", template)
    return re.sub(r"\{\{(\d+)\}\}", lambda m: " ".join(["Name"] * min(names, int(m[1]))), text)


@pytest.mark.parametrize("label", WHOLE)
def test_whole_texts(label):
    scan = S.Scanner(S.TEMPLATES, S.BASE_PHRASES).scan
    labels = lambda text: {x for x, _, _ in scan(text.lower().encode())[1]}
    template, n = S.TEMPLATES[label], len(S.compiled(S.TEMPLATES[label]).mandatory)
    for optional in (True, False):
        for names in (0, 1, 8):
            text = filled(template, optional, names)
            assert label in labels(f"Copyright (c) 2001\n\n {text.upper()} \n end"), (optional, names)
    words = S._WORD.findall(filled(template, False, 0).encode())
    assert len(words) == n and n > 20
    for i in range(n):  # each mandatory word counts: none may be changed or missing, and none added
        for other in ([b"zz"], [], [words[i], b"zz"] if 0 < i < n - 1 and b"{{" not in template.encode() else [b"zz"]):
            assert label not in labels(b" ".join(words[:i] + other + words[i + 1 :]).decode()), (i, other)


def test_bsd_clauses_differ():
    scan = S.Scanner(S.TEMPLATES, S.BASE_PHRASES).scan
    for one, two in (("bsd-2-text", "bsd-3-text"), ("bsd-3-text", "bsd-2-text")):
        labels = {x for x, _, _ in scan(filled(S.TEMPLATES[one], True, 2).lower().encode())[1]}
        assert one in labels and two not in labels and "bsd-grant" in labels


def found(text):
    return {x for x, _, _ in S.Scanner(S.TEMPLATES, S.BASE_PHRASES).scan(text.lower().encode())[1]}


@pytest.mark.parametrize("text", ["It is not in the public domain.", "the public domain of the city", "this work is not in the public domain", "a drug licensed under by law", "licensed under by", "This is not licensed under the MIT License", "never released under the MIT license", "nor licensed under CC BY 4.0"])
def test_texts_that_name_no_licence(text):
    assert found(text) == set()


def test_variants_are_told_apart():
    assert found("This work is in the public domain") == {"public-domain"}
    for k in ("", "-sa", "-nd", "-nc", "-nc-sa", "-nc-nd"):
        assert found(f"Licensed under a Creative Commons CC BY{k.upper()} 4.0 license") == {f"cc-by{k}"}
    assert found("licensed under CC BY") == set()  # no version, so no variant is known
    assert found("licensed under the Creative Commons Attribution 3.0 Unported License") == {"cc-attribution"}


def test_alternatives():
    a = S.compiled("x {{b|c}} [[{{d|e}}]] y")
    for words, end in (("x b y", 3), ("x c e y", 4), ("x y", -1), ("x b f y", -1)):
        assert a.longest_from(words.encode().split(), 0) == end, words
    assert S.compiled("{{b|c}} y").first_words() == {b"b", b"c"}
    with pytest.raises(ValueError):
        S.compiled("{{b|c}}")


def test_sister_headers_and_strength():
    for short in ("lgpl", "agpl"):
        text = S.TEMPLATES[f"{short}-header"].replace("{{program|library|software}}", "library").replace("{{2}}", "2.1").replace("[[(at your option)]]", "(at your option)")
        assert f"{short}-header" in found(text) and "gpl-header" not in found(text)
    assert [S.strength(x) for x in ("mit-text", "lgpl-header", "mit-notice", "mit-grant", "rights-reserved")] == [1.0, 1.0, 0.8, 0.6, 0.2]


def test_query_columns(spark, tmp_path):
    from quartz_panel.llm.queries import op4_license_scan

    rows = [*ROWS, filled(S.TEMPLATES["mit-text"], True, 3), "MIT License\n" + filled(S.TEMPLATES["mit-text"], False, 0)]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op4_license_scan(spark, str(tmp_path)).collect()}
    scan = S.Scanner(S.TEMPLATES, S.BASE_PHRASES).scan
    for i, text in enumerate(rows):
        n_words, hits = brute(text)
        starts, base = [h[0] for h in hits], sorted({h[1] for h in hits})
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (n_words, len(hits), ",".join(base)), text
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None)), text
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
        assert r.labels == ",".join(sorted({*base, *(x for x, _, _ in scan(low)[1])})), text
        assert 0 <= r.score <= 1
    assert len(got) == len(rows)
