"""Markup as nested intervals: elements numbered in the order of their start tags, by windows over tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import enclosing

#: A tag; values in quotes may hold its end. What a comment, a script or a style holds is no markup.
TAG = r"<(/?)([A-Za-z][\w:-]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*){0,99})>"
NO_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"


def tags(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, at, closes, name, attributes, alone) of the tags of each text in order; alone ends with a slash."""
    text = F.regexp_replace(html, NO_MARKUP, "")
    found = pages.select(key, text.alias("_t")).select(key, F.arrays_zip(*[F.regexp_extract_all("_t", F.lit(TAG), i).alias(n) for i, n in ((1, "slash"), (2, "name"), (3, "attributes"))]).alias("x"))
    rows = found.select(key, F.posexplode("x").alias("at", "x")).select(key, "at", (F.col("x.slash") == "/").alias("closes"), F.lower("x.name").alias("name"), "x.attributes")
    return rows.withColumn("alone", F.col("attributes").rlike(r"/\s*$"))


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pre, end, depth, parent, name, attributes) of the elements of each text (S16): pre is the number of an element's start tag from 0,
    and the elements with pre < number < end are those inside it.

    A name of which a text has as many start tags as end tags makes intervals; elements of other names, as those that are never
    closed, and those closed at once, hold nothing. An end tag closes the innermost open element. Depth is a running sum, an
    element's end is the next place at which its depth is left, and its parent the innermost interval that holds it.
    """
    rows = tags(pages, key, html)
    of_name = Window.partitionBy(key, "name")
    rows = rows.withColumn("paired", F.sum(F.when(F.col("alone"), 0).when(F.col("closes"), -1).otherwise(1)).over(of_name) == 0)
    rows = rows.where("NOT closes OR paired").withColumn("step", F.when(F.col("closes"), -1).when(F.col("paired") & ~F.col("alone"), 1).otherwise(0))
    order = Window.partitionBy(key).orderBy("at")
    rows = rows.withColumn("after", F.sum("step").over(order)).withColumn("pre", F.sum(F.when(F.col("closes"), 0).otherwise(1)).over(order) - 1)
    rows = rows.withColumn("depth", F.when(F.col("step") == 1, F.col("after") - 1).otherwise(F.col("after")))
    # of one depth, the end tag behind a start tag is its own
    level = Window.partitionBy(key, "depth").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    closing = F.first(F.when(F.col("step") == -1, F.col("pre") + 1), ignorenulls=True).over(level)
    last = F.max("pre").over(Window.partitionBy(key)) + 1
    rows = rows.withColumn("end", F.when(F.col("step") == 1, F.coalesce(closing, last)).otherwise(F.col("pre") + 1)).where("NOT closes")
    points = rows.select(F.col(key).alias("file_id"), F.col("pre").alias("line"), "end", "depth", "name", "attributes")
    inside = points.where("end > line + 1").select("file_id", F.col("line").alias("start"), (F.col("end") - 1).alias("end"))
    found = enclosing(points, inside)
    return found.select(F.col("file_id").alias(key), F.col("line").cast("int").alias("pre"), F.col("end").cast("int").alias("end"), F.col("depth").cast("int").alias("depth"), F.col("within.start").cast("int").alias("parent"), "name", "attributes")


def targets(found: DataFrame, focusable: Column, key: str = "page_id") -> DataFrame:
    """nodes with target: itself if it can be focused, else the nearest such element around it, else the first such one inside it, else
    null (J22)."""
    rows = found.withColumn("_f", focusable)
    points = rows.select(F.col(key).alias("file_id"), F.col("pre").alias("line"), "end", "name", "_f")
    holders = points.where("_f AND end > line + 1").select("file_id", F.col("line").alias("start"), (F.col("end") - 1).alias("end"))
    around = enclosing(points, holders)
    behind = Window.partitionBy("file_id").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    around = around.withColumn("_next", F.min(F.when(F.col("_f"), F.col("line"))).over(behind))
    target = F.when(F.col("_f"), F.col("line")).otherwise(F.coalesce("within.start", F.when(F.col("_next") < F.col("end"), F.col("_next"))))
    return around.select(F.col("file_id").alias(key), F.col("line").alias("pre"), "name", target.cast("int").alias("target"))
