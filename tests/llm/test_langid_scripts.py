"""Letters of every script are trained and labelled."""

import unicodedata

from quartz_panel.llm import langid as G

AM = "ሰላም ለዓለም ሁሉ ሰዎች ቤት ውሃ"
LO = "ສະບາຍດີ ຊາວໂລກ ພາສາລາວ ນ້ຳ"
EN = "the quick brown fox jumps over the lazy dog and then the river"
WIDE = "".join(chr(ord(c) + 0xFEE0) if c != " " else c for c in EN)
COLUMNS = "doc_id long, lang string, text string"


def test_every_letter_has_a_script():
    bare = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L" and G._SCRIPT[c] == G._OTHER]
    assert bare == [] and G._SCRIPT[ord("7")] == G._SCRIPT[0x0E51] == G._OTHER


def test_ethiopic_lao_and_full_width_latin_are_labelled(spark):
    model = G.train(spark.createDataFrame([(1, "am", AM), (2, "lo", LO), (3, "en", EN), (4, "wide", WIDE)], COLUMNS))
    rows = [(1, "", AM), (2, "", LO), (3, "", WIDE.upper()), (4, "", "𐐨𐐩𐐪"), (5, "", "๑๒ ؟ ́"), (6, "", "ั"), (7, "", EN + "\nั"), (8, "", "ሰላም")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in G.identify(spark.createDataFrame(rows, COLUMNS), model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 7, 8)] == ["am", "lo", "wide", "en", "am"]
    assert got[4][0] != "und" and got[4][1] > 0
    assert got[5] == got[6] == ("und", 0.0)
