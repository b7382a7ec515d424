"""Queries and SQL of bucketed history, markup tables, added names and the trained text scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartz_panel.operators import insertion as I
from quartz_panel.operators import sentiment as N
from quartz_panel.operators import text_scorer as C
from quartz_panel.operators.asof import resolved, timeline
from quartz_panel.operators.cut import cut
from quartz_panel.sources import history as H
from quartz_panel.sources import markup as K
from quartz_panel.sources import views as V

from . import panel as L
from .factor_queries import oracle, rounded
from .registry import query
from .service_queries import stream_folder

BUCKETS = 8


@query("s02_bucketed_asof", oracle("SELECT b.ticker_id, b.trade_date, f.accession_number, round(f.revenue, 4) AS revenue FROM bars b ASOF LEFT JOIN (SELECT * FROM filings WHERE filing_type = '10-Q') f ON b.ticker_id = f.ticker_id AND b.trade_date >= f.filed_at"))
def _(spark, d):
    """Each bar with the filing known at its date, from one timeline of both in buckets by name: missed and built, then hit and read."""
    folder = stream_folder(spark, "bucketed")

    def build():
        filings = V.filings(spark, d).filter("filing_type = '10-Q'")
        return timeline(V.bars(spark, d).select("ticker_id", "trade_date"), filings, ["ticker_id"], "trade_date", "filed_at", ["accession_number", "revenue"], tie=["accession_number"])

    for _ in range(2):
        rows = H.bucketed_history(spark, folder, "timeline", [d, folder], build, "ticker_id", "__ts", BUCKETS)
    return rounded(resolved(rows, ["ticker_id"], ["accession_number", "revenue"]), digits=4)


def _item_tables(spark, d):
    """The pages with two tables before their markup, made of their list items: members (one a row), and changes whose dates span two rows."""
    labels = F.regexp_extract_all("html", F.lit(r'<li><a href="[^"]*">([^<]*)</a></li>'), F.lit(1))
    p = V.table(spark, d, "pages").select("page_id", "html", labels.alias("x"))
    tag = lambda *parts: F.concat(*(F.lit(s) if isinstance(s, str) else s for s in parts))
    number = lambda i: i.cast("string")
    member = F.transform("x", lambda x, i: tag("<tr>\n<td><a href='/", number(i), "'> ", x, ".b</a></td><td>", x, " &amp; Co\n</td><td>", F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("S"), number(i))), "</td><td>I", number(i), "</td></tr>"))
    day = lambda i: F.date_add(F.lit("2020-01-01").cast("date"), ((F.col("page_id") * 7 + F.floor(i / 2) * 31) % 900).cast("int"))
    shown = lambda i: F.when(F.floor(i / 2) % 3 == 0, F.date_format(day(i), "MMMM d, yyyy")).when(F.floor(i / 2) % 3 == 1, F.date_format(day(i), "yyyy-MM-dd")).otherwise(F.date_format(day(i), "MMM d, yyyy"))
    change = F.transform("x", lambda x, i: tag("<tr>", F.when(i % 2 == 0, tag("<td rowspan='2'>", shown(i), "</td>")).otherwise(""), "<td>A", number(i), "</td><td>Added</td>", F.when(i % 4 == 3, "<td>—</td><td></td>").otherwise(tag("<td>", x, "</td><td><i>", x, "</i> Ltd</td>")), "<td colspan=\"2\">reason ", number(i), "</td></tr>"))
    members = tag('<table class="wikitable sortable" id="constituents"><tr><th>Symbol<th>Security<th>Sector<th>Industry</tr>', F.array_join(member, "\n"), "</table>")
    head = "<tr><th rowspan=2>Date</th><th colspan=2>Added</th><th colspan=2>Removed</th><th rowspan=2 colspan=2>Reason</th></tr><tr><th>Ticker</th><th>Security</th><th>Ticker</th><th>Security</th></tr>"
    changes = tag('<!-- <table class="wikitable"></table> --><TABLE border=1 class=\'plain wikitable\'>', head, F.array_join(change, "\n"), "</TABLE>")
    return p.select("page_id", tag(members, changes, F.col("html")).alias("html"))


_ITEMS = """(SELECT page_id, generate_subscripts(l, 1) - 1 AS i, replace(replace(replace(replace(replace(unnest(l), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS x FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS l FROM pages))"""
#: DuckDB has a capital sharp s, Spark writes SS
_SYMBOL = "upper(replace(trim(replace({x}, '.', '-')), 'ß', 'ss'))"
_DAY = "DATE '2020-01-01' + ((page_id * 7 + (i // 2) * 31) % 900)::INT"


@query("s13_index_members", f"SELECT page_id, {_SYMBOL.format(x='x')} || '-B' AS symbol, arg_min(trim(x || ' & Co'), i) AS name, nullif(arg_min(CASE WHEN i % 3 = 0 THEN '' ELSE 'S' || i END, i), '') AS sector, arg_min('I' || i, i) AS industry FROM {_ITEMS} GROUP BY ALL")
def _(spark, d):
    return K.index_members(_item_tables(spark, d))


@query("s13_index_removals", f"SELECT page_id, (i + 2)::INT AS row_no, {_SYMBOL.format(x='x')} AS symbol, trim(x || ' Ltd') AS name, {_DAY} AS removed_at FROM {_ITEMS} WHERE i % 4 <> 3 AND {_DAY} >= DATE '2021-01-01' AND {_SYMBOL.format(x='x')} NOT IN ('', '-', '–', '—')")
def _(spark, d):
    return K.index_removals(_item_tables(spark, d), "2021-01-01")


@query("s13_columns_by_header", f"SELECT page_id, (i + 2)::INT AS row_no, 'A' || i AS added, CASE WHEN i % 4 = 3 THEN '—' ELSE trim(x) END AS removed, 'reason ' || i AS reason, NULL::VARCHAR AS weight FROM {_ITEMS}")
def _(spark, d):
    t = _item_tables(spark, d).select("page_id", F.get(K.with_class(K.tables(), "wikitable"), F.lit(1)).alias("markup"))
    return K.columns_by_header(K.cell_grid(t, ["page_id"]), ["page_id"], {"added": "added ticker", "removed": "removed ticker", "reason": "reason", "weight": "weight"})


_ADDED = ["mom_6m", "ma_gap_200", "vol_60d"]


def added_score(rows):
    """A fixed linear score of the ranked features, rounded so that equal scores tie."""
    return rows.withColumn("score", F.round(0.5 * F.col("mom_6m") + 0.3 * F.col("ma_gap_200") - 0.2 * F.col("vol_60d"), 9))


def _placed(c: str) -> str:
    return f"2 * (rank() OVER (PARTITION BY new_id ORDER BY {c}) + (count(*) OVER (PARTITION BY new_id, {c}) - 1) / 2.0::DOUBLE - 1) / (count(*) OVER (PARTITION BY new_id) - 1)::DOUBLE - 1"


ADDED_VIEWS = (
    ("now", "SELECT date, ticker_id, " + ", ".join(f"round({c}, 8) + 0.0 AS {c}" for c in _ADDED) + " FROM panel WHERE date = (SELECT max(date) FROM panel)"),
    ("asked", "SELECT ticker_id FROM tickers WHERE user_added OR NOT active"),
    ("fresh", "SELECT * FROM now WHERE ticker_id IN (SELECT ticker_id FROM asked) AND ticker_id % 20 <> 0"),
    ("members", "SELECT * FROM now WHERE ticker_id IN (SELECT ticker_id FROM tickers WHERE active AND NOT user_added)"),
    ("together", "SELECT f.ticker_id AS new_id, m.* FROM fresh f CROSS JOIN members m UNION ALL SELECT ticker_id AS new_id, * FROM fresh"),
    ("scored", f"SELECT new_id, ticker_id, date, round(0.5::DOUBLE * a + 0.3::DOUBLE * b - 0.2::DOUBLE * c, 9) AS score FROM (SELECT new_id, ticker_id, date, {_placed('mom_6m')} AS a, {_placed('ma_gap_200')} AS b, {_placed('vol_60d')} AS c FROM together)"),
    ("ranked", "SELECT *, count(*) OVER (PARTITION BY new_id) AS n, (rank() OVER (PARTITION BY new_id ORDER BY score) - 1 + (count(*) OVER (PARTITION BY new_id, score) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY new_id) - 1)::DOUBLE AS rk FROM scored"),
)


@query("m15_added_names", oracle("SELECT a.ticker_id, r.date, round(r.rk, 9) AS relative_rank, r.n AS n_ranked, CASE WHEN r.date IS NULL THEN 'insufficient_history' ELSE 'scored' END AS status FROM asked a LEFT JOIN (SELECT * FROM ranked WHERE ticker_id = new_id) r ON r.new_id = a.ticker_id", *ADDED_VIEWS))
def _(spark, d):
    """Added and inactive names, each against the index members of the last date and itself; names of every twentieth id have no fresh rows."""
    p = rounded(L.price_panel(spark, d).select("date", "ticker_id", *_ADDED), digits=8)
    p = cut(p)
    now = p.join(F.broadcast(p.agg(F.max("date").alias("date"))), "date")
    t = V.tickers(spark, d)
    asked = t.filter("user_added or not active").select("ticker_id")
    members = now.join(t.filter("active and not user_added").select("ticker_id"), "ticker_id", "left_semi")
    stored = cut(I.stored_ranks(members, _ADDED))
    fresh = now.join(asked, "ticker_id", "left_semi").filter("ticker_id % 20 <> 0")
    return rounded(I.score_added(stored, asked, fresh, _ADDED, added_score, {"mom_6m": 0.5, "ma_gap_200": 0.3, "vol_60d": 0.2}), digits=9)


def labelled_texts(spark, d):
    """doc_id, text, held_out, class of the labelled documents: toxic ones are neg, others of good quality pos, the rest neu."""
    kind = F.when(F.col("toxic") == 1, "neg").when(F.col("quality") == 1, "pos").when(F.col("toxic") == 0, "neu")
    marks = V.table(spark, d, "labels").select("doc_id", kind.alias("class"))
    return V.table(spark, d, "documents").select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out")).join(marks, "doc_id")


@query("u01_trained_scorer")
def _(spark, d):
    """All documents scored by a model of the labelled ones that aren't held out, saved and loaded before use."""
    path = f"{stream_folder(spark, 'scorer')}/weights"
    C.save_weights(spark, C.fit_text_scorer(labelled_texts(spark, d).filter("not held_out"), "text", "class"), path)
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    return N.score_texts(docs, "text", C.load_scorer(spark, path)).drop("text")
