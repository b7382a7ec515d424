"""Tables in markup: spans, headers, members and removals by hand-made pages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quartz_panel.sources import markup as K

MEMBERS = """<script>var t = "<table class='wikitable'><tr><td>no</td></tr></table>";</script><!-- <table class="wikitable"><tr><td>no</td></tr></table> -->
<table class="wikitable"><tr><td>X</td><td>x</td><td>s</td><td>i</td></tr></table>
<TABLE class="sortable wikitable" ID="constituents"><tbody><tr><th>Symbol</th><th>Name</th><th>Sector</th><th>Industry</th></tr>
<tr><td>
 <a href="/brk">brk.b</a></td><td>A &amp; B &lt;Co&gt;</td><td></td><td>Banks</td></tr><tr><td>ABC</td><td>Abc</td><td>Tech</td></tr>
<tr><td> BRK-B <td>again<td>Other<td>Other</tr><tr><td></td><td>no symbol</td><td>s</td><td>i</td></tr></tbody></TABLE>"""
CHANGES = """<table class="wikitable"><tr><td>AAA</td><td>Aaa</td><td>S</td><td>I</td><td>more</td></tr></table>
<table class="wikitable"><tr><th rowspan="2">Date</th><th colspan="2">Added</th><th colspan="2">Removed</th><th rowspan="2">Reason</th></tr><tr><th>Ticker</th><th>Security</th><th>Ticker</th><th>Security</th></tr>
<tr><td rowspan="3">March 4, 2021</td><td>N1</td><td>New 1</td><td>o.1</td><td>Old 1</td><td>r1</td></tr><tr><td>N2</td><td>New 2</td><td>—</td><td></td><td rowspan="2">r23</td></tr><tr><td>N3</td><td>New 3</td><td>O3</td><td></td></tr>
<tr><td>2019-12-31</td><td>N4</td><td>New 4</td><td>O4</td><td>Old 4</td><td>r4</td></tr><tr><td>Jun 7, 2022</td><td colspan="2">-</td><td>O5</td><td>Old 5</td></tr>
<tr><td>once</td><td>N6</td><td>New 6</td><td>O6</td><td>Old 6</td><td>r6</td></tr><tr><td>2022-06-08</td><td>N7</td><td>short</td></tr></table>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, MEMBERS), (2, CHANGES), (3, "<p>none</p>"), (4, ""), (5, None), (6, '<table class="wikitable">')], "page_id int, html string")


def test_members(pages):
    got = sorted(tuple(r) for r in K.index_members(pages).collect())
    assert got == [(1, "BRK-B", "A & B <Co>", None, "Banks"), (2, "AAA", "Aaa", "S", "I")]


def test_removals_follow_dates_over_spanned_rows(pages):
    got = sorted(tuple(r) for r in K.index_removals(pages, "2021-01-01").collect())
    day, later = dt.date(2021, 3, 4), dt.date(2022, 6, 7)
    assert got == [(2, 2, "O-1", "Old 1", day), (2, 4, "O3", None, day), (2, 6, "O5", "Old 5", later)]


def test_headers_above_each_other_name_a_column(spark, pages):
    t = pages.select("page_id", F.get(K.with_class(K.tables(), "wikitable"), F.lit(1)).alias("markup"))
    got = {r.row_no: tuple(r)[2:] for r in K.columns_by_header(K.cell_grid(t, ["page_id"]), ["page_id"], {"gone": "removed ticker", "why": "reason", "none": "size"}).filter("page_id = 2").collect()}
    assert got == {2: ("o.1", "r1", None), 3: ("—", "r23", None), 4: ("O3", "r23", None), 5: ("O4", "r4", None), 6: ("O5", None, None), 7: ("O6", "r6", None), 8: (None, None, None)}


def test_spans_are_placed_as_by_hand(spark):
    html = "<table><tr><td rowspan=2 colspan=2>a<td>b</tr><tr><td rowspan=9>c<td colspan=0>d</tr><tr><td>e<td>f<td>g</tr></table>"
    grid = K.cell_grid(spark.createDataFrame([(1, html)], "k int, markup string"), ["k"])
    assert sorted((r.row_no, r.col_no, r.text) for r in grid.collect()) == [(0, 0, "a"), (0, 1, "a"), (0, 2, "b"), (1, 0, "a"), (1, 1, "a"), (1, 2, "c"), (1, 3, "d"), (2, 0, "e"), (2, 1, "f"), (2, 2, "c"), (2, 3, "g")]
