"""Review of discovered URLs: the view and the selection are two columns, in_view and selected, beside (ord, url)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import matches
from .relational import ranked

PAGE_SIZE = 30


def start(urls: DataFrame) -> DataFrame:
    return urls.withColumns({"in_view": F.lit(True), "selected": F.lit(True)})


def filter_view(state: DataFrame, pattern: str) -> DataFrame:
    """Narrow the view, never the selection; no pattern shows all, a pattern without a match changes nothing."""
    if not pattern:
        return state.withColumn("in_view", F.lit(True))
    hit = matches(F.col("url"), pattern)
    return state if state.where(hit).isEmpty() else state.withColumn("in_view", hit)


def rows_of(spec: str) -> tuple[int, int] | None:
    """'3' or '3-8' as a range of 1-based rows; None when it is neither."""
    m = re.fullmatch(r"\s*(\d+)(?:-(\d+))?\s*", spec)
    return (int(m[1]), int(m[2] or m[1])) if m else None


def numbered(state: DataFrame) -> DataFrame:
    """state with the 1-based row of each visible URL in discovery order, null for the others; by a range sort, not in one task."""
    visible = F.coalesce(F.col("in_view"), F.lit(False))
    rows = ranked(state.where(visible), [F.col("ord")], "row").withColumn("row", F.col("row").cast("int"))
    return rows.select(*state.columns, "row").unionByName(state.where(~visible).withColumn("row", F.lit(None).cast("int")))


def toggle(state: DataFrame, spec: str, select: bool, page: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """Select or deselect rows of the current page; rows outside it are ignored. ord names a row.

    Only the rows of the page are found, ``size`` at most, and sent to all tasks; the others are not numbered.
    """
    found = rows_of(spec)
    if not found:
        return state
    a, b = max(found[0], page * size + 1), min(found[1], (page + 1) * size)
    if b < a:
        return state
    picked = state.where("in_view").orderBy("ord").offset(a - 1).limit(b - a + 1).select("ord", F.lit(True).alias("_picked"))
    return state.join(F.broadcast(picked), "ord", "left").withColumn("selected", F.when(F.col("_picked"), F.lit(select)).otherwise(F.col("selected"))).select(*state.columns)


def toggle_view(state: DataFrame, select: bool) -> DataFrame:
    """All of the view in or out: selection ∪ view or selection − view."""
    return state.withColumn("selected", F.when(F.col("in_view"), F.lit(select)).otherwise(F.col("selected")))


def visible_selected(state: DataFrame) -> DataFrame:
    """(n): how many URLs are both in view and selected."""
    return state.agg(F.count_if(F.col("in_view") & F.col("selected")).alias("n"))


def page(df: DataFrame, number: int, order: list[str | Column], size: int = PAGE_SIZE) -> DataFrame:
    return df.orderBy(*order).offset(number * size).limit(size)


def page_count(total: int, size: int = PAGE_SIZE) -> int:
    return max(1, -(-total // size))


def chosen(state: DataFrame) -> DataFrame:
    """The selection in discovery order, or everything where nothing is selected."""
    selected = state.where("selected")
    return (state if selected.isEmpty() else selected).select("ord", "url").orderBy("ord")
