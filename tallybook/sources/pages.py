"""Typed rows from result pages: a distributed extraction over ``pages(url, html)``.

One tokenizer cuts tables and boxes into rows of cells; a layout names the columns and
their types. Separator rows (one cell) are carried down by a window, not in Python.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

#: Layouts: column name and type by cell.
LAYOUTS = {
    "ranking": ["pos int", "name string", "avg double", "opp_avg double", "rank double", "car int", "ent int", "pts int", "pts_total int"],
    "player_games": ["day date", "name1 string", "pts1 int", "car1 int", "name2 string", "pts2 int", "car2 int", "ent int"],
    "league_games": ["discipline string", "name1 string", "car1 int", "run1 int", "pts1 int", "name2 string", "car2 int", "run2 int", "pts2 int", "ent int"],
    "standings": ["pos int", "team string", "mp int", "pp int", "played int"],
    "classification": ["pos int", "player string", "club string", "n_games int", "pts int", "car int", "ent int", "avg double", "avg_part double", "best_run int"],
    "history": ["day date", "discipline int", "seq int"],
}


#: What the last one-cell row above is called in a layout.
SECTIONS = {"player_games": "competition", "league_games": "tie"}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Rows(HTMLParser):
    """Rows of cells: table rows, boxes (a ``div`` of class ``box``, whose direct children are cells) and pairs of a definition list."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None
        self.table = -1
        self.where: list[int] = []
        self.depth, self.box = 0, 0

    def _row(self):
        self._end()
        self.rows.append([])
        self.where.append(self.table)

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            if self.cell is not None:
                self.cell.append(" ")
            return
        self.depth += 1
        if tag in ("table", "dl", "section"):
            self._end()
            self.table += 1
        elif tag in ("tr", "dt"):
            self._row()
        elif tag == "div" and not self.box and "box" in (dict(attrs).get("class") or "").split():
            self._row()
            self.box = self.depth
        if tag in ("td", "th", "dt", "dd") or self.box and self.depth == self.box + 1:
            self._end()
            self.cell = []

    def handle_endtag(self, tag):
        if tag in _VOID:
            return
        if tag in ("td", "th", "tr", "table", "dt", "dd", "dl") or self.box and self.depth <= self.box + 1:
            self._end()
        if self.depth == self.box:
            self.box = 0
        self.depth = max(self.depth - 1, 0)

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def _end(self):
        if self.cell is not None and self.rows:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
        self.cell = None


def table_rows(pages: DataFrame) -> DataFrame:
    """``url, page, tab, row, cells`` of every row with cells, in page order; ``page`` tells pages of one url apart."""

    def run(batches):
        for b in batches:
            out = {"url": [], "page": [], "tab": [], "row": [], "cells": []}
            for url, page, html in zip(*(b.column(c).to_pylist() for c in ("url", "page", "html")), strict=True):
                p = _Rows()
                p.feed(html or "")
                p.close()
                for i, (t, cells) in enumerate(zip(p.where, p.rows, strict=True)):
                    if cells:
                        for k, v in zip(out, (url, page, t, i, cells), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict({"url": pa.array(out["url"], pa.string()), "page": pa.array(out["page"], pa.int64()), "tab": pa.array(out["tab"], pa.int32()), "row": pa.array(out["row"], pa.int32()), "cells": pa.array(out["cells"], pa.list_(pa.string()))})

    return pages.select("url", F.xxhash64("url", "html").alias("page"), "html").mapInArrow(run, "url string, page long, tab int, row int, cells array<string>")


def extract(pages: DataFrame, layout: str) -> DataFrame:
    """Rows of a layout, with ``section`` (or its name in the layout), the last one-cell row above in the same table."""
    spec = [s.split() for s in LAYOUTS[layout]]
    x = table_rows(pages)
    one = F.when(F.size("cells") == 1, F.col("cells")[0])
    x = x.withColumn("section", F.last(one, ignorenulls=True).over(W.partitionBy("url", "page", "tab").orderBy("row")))

    def typed(i: int, kind: str):
        c = F.col("cells")[i]
        if kind == "string":
            return F.nullif(c, F.lit(""))
        if kind == "date":
            return F.coalesce(F.try_to_timestamp(c, F.lit("dd/MM/yyyy")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))).cast("date")
        return F.regexp_replace(c, ",", ".").try_cast(kind)

    first, kind = spec[0]
    cols = [typed(i, k).alias(n) for i, (n, k) in enumerate(spec)]
    x = x.where(F.size("cells") >= len(spec)).select("url", "row", F.col("section").alias(SECTIONS.get(layout, "section")), *cols)
    return x if kind == "string" else x.where(F.col(first).isNotNull())


def key_values(pages: DataFrame) -> DataFrame:
    """``url, tab, row, key, value`` of the rows of two cells; a colon behind the key goes."""
    x = table_rows(pages).where(F.size("cells") == 2)
    return x.select("url", "tab", "row", F.rtrim(F.regexp_replace(F.col("cells")[0], r":\s*$", "")).alias("key"), F.nullif(F.col("cells")[1], F.lit("")).alias("value"))


def link_ids(urls: DataFrame, url: str, pattern: str = "") -> DataFrame:
    """``urls`` with ``ids``, the numbers that stand alone in the path behind ``pattern``, in order; null where the pattern does not fit."""
    path = F.regexp_replace(F.col(url), r"^[a-z]+://[^/]*|[?#].*$", "")
    rest = F.regexp_extract(path, f"{pattern}(.*)$", 1)
    ids = F.transform(F.regexp_extract_all(rest, F.lit(r"(?<=/)[0-9]{1,18}(?=/|$)"), F.lit(0)), lambda s: s.cast("long"))
    return urls.withColumn("ids", F.when(path.rlike(pattern), ids))
