"""Outlines: headings with their parents, and fences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outline(heads: DataFrame, key: str, pos: str, levels: int = 6) -> DataFrame:
    """Headings (key, pos, level, ...) with parent, the pos of the last heading of a lower level before."""
    order = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    marks = {f"_l{n}": F.last(F.when(F.col("level") < n, F.col(pos)), ignorenulls=True).over(order) for n in range(2, levels + 1)}
    rows = heads.withColumns(marks)
    parent = F.coalesce(*[F.when(F.col("level") == n, F.col(f"_l{n}")) for n in range(2, levels + 1)])
    return rows.withColumn("parent", parent).drop(*marks)


def fence_parity(rows: DataFrame, key: str, fence: Column, line: str = "line") -> DataFrame:
    """Lines with inside: after an odd number of fences, the line itself counted."""
    order = Window.partitionBy(key).orderBy(line)
    return rows.withColumn("inside", F.sum(fence.cast("int")).over(order) % 2 == 1)


def markdown(rows: DataFrame, key: str) -> DataFrame:
    """(key, line, level, title, parent, end_line) of the headings of numbered lines, not those in code fences; a section ends
    before the next heading, the last where the file does."""
    marked = fence_parity(rows, key, F.col("line_text").rlike(r"^\s*(```|~~~)"))
    last = marked.withColumn("_last", F.max("line").over(Window.partitionBy(key)))
    heads = last.where(~F.col("inside") & F.col("line_text").rlike(r"^#{1,6} "))
    heads = heads.select(key, "line", F.length(F.regexp_extract("line_text", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("line_text", "^#+", "")).alias("title"), "_last")
    ends = F.coalesce(F.lead("line").over(Window.partitionBy(key).orderBy("line")) - 1, "_last")
    return outline(heads, key, "line").withColumn("end_line", ends).drop("_last")
