"""Rows of an HTML table as DataFrame rows.

Patterns work on the text of one page at a time, inside the JVM; pages are spread over the tasks. Tables are counted by
their start tags, those inside others too; the rows of a table are its own, without those of tables in its cells. Rows
without an end tag are not supported.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TABLE = r"(?is)<table\b[^>]*>(.*?)</table\s*>"
_ROW = r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"
_CELL = r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"
_TAG = r"(?s)<[^>]*>"
_START = r"(?i)<table\b"

# Character references and their text; the ampersand comes last.
_REFERENCES = (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
               ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"))
_BLANKS = " \t\r\n\f\u00a0"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def cell_text(cell: Column) -> Column:
    """Text of a cell: tags removed, character references replaced, trimmed."""
    text = F.when(F.contains(cell, F.lit("<")), F.regexp_replace(cell, _TAG, "")).otherwise(cell)
    replaced = text
    for reference, character in _REFERENCES:
        replaced = F.replace(replaced, F.lit(reference), F.lit(character))
    return F.btrim(F.when(F.contains(text, F.lit("&")), replaced).otherwise(text), F.lit(_BLANKS))


def table_text(html: Column, table_no: int) -> Column:
    """What the ``table_no``-th table of a page holds, without the tables inside it; NULL if there is none.

    Without nested tables this is a match of the pattern. Else the page is cut at its table tags, and one pass over the
    pieces keeps the number of tables begun, the depth, and the depth of the wanted table while it is open.
    """
    flat = _all(html, _TABLE)
    nested = F.exists(flat, lambda inner: F.rlike(inner, F.lit(_START)))
    nothing = F.struct(F.lit(0).alias("begun"), F.lit(0).alias("depth"), F.lit(-1).alias("wanted"), F.lit("").alias("text"))

    def step(state: Column, piece: Column) -> Column:
        opens, closes = F.rlike(piece, F.lit(r"(?i)^<table\b")), F.rlike(piece, F.lit(r"(?i)^</table\b"))
        begun = state["begun"] + opens.cast("int")
        depth = F.when(opens, state["depth"] + 1).when(closes, F.greatest(state["depth"] - 1, F.lit(0))).otherwise(state["depth"])
        wanted = (F.when(opens & (begun == table_no), depth)
                  .when(closes & (state["depth"] == state["wanted"]) & (state["wanted"] > 0), F.lit(-1)).otherwise(state["wanted"]))
        rest = F.regexp_replace(piece, r"(?is)^</?table\b[^>]*>", "")
        text = F.when(depth == wanted, F.concat(state["text"], rest)).otherwise(state["text"])
        return F.struct(begun.alias("begun"), depth.alias("depth"), wanted.alias("wanted"), text.alias("text"))

    end = F.aggregate(F.split(html, r"(?i)(?=</?table\b)"), nothing, step)
    return F.when(nested, F.when(end["begun"] >= table_no, end["text"])).otherwise(F.get(flat, F.lit(table_no - 1)))


def extract_html_table(pages: DataFrame, table_no: int, key_cols: Sequence[str],
                       columns: Sequence[str], html: str = "html") -> DataFrame:
    """Rows of the ``table_no``-th table of each page: keys, row_no (from 1) and the first cells.

    No row is taken for a header. A cell the row does not have is NULL; pages without that table give no
    rows.
    """
    table = table_text(F.col(html), table_no)
    rows = pages.select(*key_cols, F.posexplode(_all(table, _ROW)).alias("_pos", "_row"))
    cells = rows.select(*key_cols, (F.col("_pos") + 1).alias("row_no"), _all(F.col("_row"), _CELL).alias("_cells"))
    return cells.select(
        *key_cols, "row_no",
        *[cell_text(F.get("_cells", F.lit(i))).alias(name) for i, name in enumerate(columns)],
    )


def extract_titled_table(pages: DataFrame, table_no: int, key_cols: Sequence[str], header_row: int,
                         wanted: Sequence[str], html: str = "html") -> DataFrame:
    """Columns of a table found by their titles in row ``header_row``.

    Rows with fewer than two cells are captions and drop out, and of the others the first one, which
    repeats the titles.
    """
    table = table_text(F.col(html), table_no)
    found = pages.select(*key_cols, _all(table, _ROW).alias("_rows"))
    titles = F.transform(_all(F.get("_rows", F.lit(header_row - 1)), _CELL), cell_text)
    several = F.filter("_rows", lambda row: F.regexp_count(row, F.lit(_CELL)) >= 2)
    rows = (
        found.select(*key_cols, titles.alias("_titles"), F.posexplode(several).alias("_pos", "_row"))
        .filter(F.col("_pos") > 0)
        .select(*key_cols, "_titles", _all(F.col("_row"), _CELL).alias("_cells"))
    )

    def titled(name: str) -> Column:
        place = F.array_position("_titles", F.lit(name)) - 1
        return cell_text(F.get("_cells", F.when(place >= 0, place).cast("int"))).alias(name)

    return rows.select(*key_cols, *[titled(name) for name in wanted])
