"""Tables in page markup: cells on their grid with spans expanded, header lookup, index members and removals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .ingest import date_in_formats, normalize_symbol

#: Named entities of markup and their characters, the ampersand's last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: Cells that say that no name was removed.
NO_SYMBOL = ("", "-", "–", "—")
#: Most columns that one cell may span.
MOST_COLUMNS = 1000


def tables(html: str = "html") -> Column:
    """The tables of a page in order, as markup; comments and scripts don't count, a nested table ends the outer one."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<script\b.*?</script\s*>", "")
    return F.regexp_extract_all(bare, F.lit(r"(?is)<table\b.*?</table\s*>"), F.lit(0))


def _attribute(markup: Column, name: str) -> Column:
    """The value of an attribute in the first tag, empty without one."""
    tag = F.regexp_extract(markup, r"(?s)^<[^>]*>", 0)
    value = rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*(F.regexp_extract(tag, value, i) for i in (1, 2, 3)))  # quoted in one way, in the other, or not


def with_class(found: Column, name: str) -> Column:
    """Those of an array of tables that are of a class."""
    return F.filter(found, lambda t: F.array_contains(F.split(_attribute(t, "class"), r"\s+"), name))


def _text(cell: Column) -> Column:
    out = F.regexp_replace(cell, r"(?s)<[^>]*>", "")
    for entity, character in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(out, r"^\s+|\s+$", ""))


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def _first_columns(rows: pd.Series, below: pd.Series) -> pd.Series:
    """First column of each cell, from the widths of the rows' cells and the number of rows that they reach down."""

    def placed(widths, heights):
        taken: dict[int, int] = {}  # column: rows still covered from above
        out = []
        for ws, hs in zip(widths, heights, strict=True):
            at, starts, new = 0, [], {}
            for w, h in zip(ws, hs, strict=True):
                while taken.get(at, 0) > 0:
                    at += 1
                starts.append(at)
                new.update(dict.fromkeys(range(at, at + w), h - 1))
                at += w
            taken = {c: n - 1 for c, n in taken.items() if n > 1} | {c: n for c, n in new.items() if n > 0}
            out.append(starts)
        return out

    return pd.Series([placed(w, h) for w, h in zip(rows, below, strict=True)], dtype=object)


def cell_grid(df: DataFrame, keys: list[str], markup: str = "markup") -> DataFrame:
    """keys, row_no, col_no, tag (th or td), text: one row for each place of the table's grid that a cell covers.

    A cell that spans rows or columns is given at each of its places, so that a column number means the same in all rows.
    Rows that a span would cover beyond the table's end don't exist.  Tables without cells, empty and null markup give no rows."""
    rows = F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr\b|<tr\b|</table\b|$)"), F.lit(1))
    cells = F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[hd]\b.*?(?=</t[hd]\b|<t[hd]\b|$)"), F.lit(0)))
    span = lambda c, name, most: F.least(F.greatest(F.coalesce(_attribute(c, name).try_cast("int"), F.lit(1)), F.lit(1)), most)
    t = df.select(*keys, cells.alias("__cells")).filter(F.exists("__cells", lambda r: F.size(r) > 0))
    wide = F.transform("__cells", lambda r: F.transform(r, lambda c: span(c, "colspan", F.lit(MOST_COLUMNS))))
    tall = F.transform("__cells", lambda r, i: F.transform(r, lambda c: span(c, "rowspan", F.size("__cells") - i)))
    t = t.withColumn("__wide", wide).withColumn("__tall", tall).withColumn("__at", _first_columns("__wide", "__tall"))
    t = t.select(*keys, F.posexplode(F.arrays_zip("__cells", "__wide", "__tall", "__at")).alias("__row", "r"))
    t = t.select(*keys, "__row", F.explode(F.arrays_zip("r.__cells", "r.__wide", "r.__tall", "r.__at")).alias("c"))
    t = t.select(*keys, F.explode(F.sequence("__row", F.col("__row") + F.col("c.__tall") - 1)).alias("row_no"), "c")
    t = t.select(*keys, "row_no", F.explode(F.sequence(F.col("c.__at"), F.col("c.__at") + F.col("c.__wide") - 1)).alias("col_no"), "c.__cells")
    return t.select(*keys, "row_no", "col_no", F.lower(F.substring("__cells", 2, 2)).alias("tag"), _text(F.col("__cells")).alias("text"))


def columns_by_header(grid: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    """keys, row_no and a column for each field, from the column under its header; null where a table lacks the header.

    A header is what the rows of ``th`` cells alone say above each other, in lower case, words joined by one space and
    what a spanning cell repeats said once ("removed ticker").  ``fields``: field to header."""
    rows = grid.groupBy(*keys, "row_no").agg(F.bool_and(F.col("tag") == "th").alias("__head"))
    g = grid.join(rows, [*keys, "row_no"])
    said = F.array_distinct(F.transform(F.array_sort(F.collect_set(F.when(F.col("__head"), F.struct("row_no", F.lower("text").alias("text"))))), lambda x: x["text"]))
    heads = g.groupBy(*keys, "col_no").agg(F.array_join(said, " ").alias("__name"))
    named = g.filter("not __head").join(heads, [*keys, "col_no"])
    return named.groupBy(*keys, "row_no").agg(*(F.min_by("text", "col_no").alias(f) if not h else F.min_by(F.when(F.col("__name") == h, F.col("text")), F.when(F.col("__name") == h, F.col("col_no"))).alias(f) for f, h in fields.items()))


def _by_place(grid: DataFrame, keys: list[str], fields: dict[str, int], least: int = 4) -> DataFrame:
    """keys, row_no, fields by column number, of rows with ``least`` data cells or more."""
    cell = F.col("tag") == "td"
    rows = grid.groupBy(*keys, "row_no").agg(F.count_if(cell).alias("__n"), *(F.max(F.when(cell & (F.col("col_no") == n), F.col("text"))).alias(f) for f, n in fields.items()))
    return rows.filter(F.col("__n") >= least).drop("__n")


def index_members(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, symbol, name, sector, industry from each page's table of id ``constituents``, else from its first ``wikitable``.

    Of rows that repeat a symbol the first counts; empty fields are null; a page without such a table gives no rows."""
    found = tables(html)
    own = F.filter("__t", lambda t: F.lower(_attribute(t, "id")) == "constituents")
    t = pages.select("page_id", found.alias("__t")).select("page_id", F.coalesce(F.get(own, F.lit(0)), F.get(with_class(F.col("__t"), "wikitable"), F.lit(0))).alias("markup"))
    rows = _by_place(cell_grid(t, ["page_id"]), ["page_id"], {"symbol": 0, "name": 1, "sector": 2, "industry": 3})
    rows = rows.withColumn("symbol", normalize_symbol("symbol")).filter("symbol <> ''")
    first = rows.groupBy("page_id", "symbol").agg(F.min_by(F.struct("name", "sector", "industry"), "row_no").alias("r"))
    return first.select("page_id", "symbol", *(F.nullif(F.col("r")[c], F.lit("")).alias(c) for c in ("name", "sector", "industry")))


def index_removals(pages: DataFrame, since, html: str = "html") -> DataFrame:
    """page_id, row_no, symbol, name, removed_at from each page's second ``wikitable``: rows dated at or after ``since`` that name a removal.

    Dates are in any of three formats; a row with another date, or with no removed symbol, is no removal.  A date that spans rows
    counts for each of them."""
    t = pages.select("page_id", F.get(with_class(tables(html), "wikitable"), F.lit(1)).alias("markup"))
    rows = _by_place(cell_grid(t, ["page_id"]), ["page_id"], {"day": 0, "symbol": 3, "name": 4})
    rows = rows.withColumn("removed_at", date_in_formats("day")).withColumn("symbol", normalize_symbol("symbol"))
    rows = rows.filter((F.col("removed_at") >= F.lit(since).cast("date")) & ~F.col("symbol").isin(*NO_SYMBOL))
    return rows.select("page_id", "row_no", "symbol", F.nullif("name", F.lit("")).alias("name"), "removed_at")
