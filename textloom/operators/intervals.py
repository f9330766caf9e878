"""Nested intervals, by windows over both sides instead of a join of every point with every interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enclosing(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """points (file_id, line, ...) with within: the innermost interval (file_id, start, end, ...) that starts on an earlier line and
    holds the line, as a struct, and level, how many hold it."""
    row = F.struct(*[c for c in intervals.columns if c != "file_id"])
    kind = intervals.select(row.alias("r")).schema["r"].dataType.simpleString()
    none = F.lit(None).cast(kind)
    starts = intervals.select("file_id", F.col("start").alias("at"), F.lit(2).alias("rank"), F.lit(1).alias("step"), row.alias("interval"))
    ends = intervals.select("file_id", F.col("end").alias("at"), F.lit(3).alias("rank"), F.lit(-1).alias("step"), none.alias("interval"))
    asked = points.select("file_id", F.col("line").alias("at"), F.lit(1).alias("rank"), F.lit(0).alias("step"), none.alias("interval"), F.struct(*points.columns).alias("point"))
    found = _within(asked.unionByName(starts.unionByName(ends), allowMissingColumns=True))
    return found.select("point.*", "within", "level")


def nested(rows: DataFrame, holds: Column, *what: str) -> DataFrame:
    """enclosing() of rows (file_id, line, end_line, ...) by those of them for which holds is true; within has start, end and what. A row
    becomes its point, start and end at its place, so rows that lie by file stay there."""
    event = lambda at, rank, step: F.struct(F.col(at).alias("at"), F.lit(rank).alias("rank"), F.lit(step).alias("step"))
    point = event("line", 1, 0)
    events = F.when(holds, F.array(point, event("line", 2, 1), event("end_line", 3, -1))).otherwise(F.array(point))
    both = rows.select(*rows.columns, F.explode(events).alias("e")).select(*rows.columns, "e.at", "e.rank", "e.step")
    interval = F.struct(F.col("line").alias("start"), F.col("end_line").alias("end"), *what)
    found = _within(both.withColumn("interval", F.when(F.col("rank") == 2, interval)))
    return found.select(*rows.columns, "within", "level")


def _within(events: DataFrame) -> DataFrame:
    """Points among events (file_id, at, rank, step, interval, ...) with within and level. Two windows over starts, ends and points: what
    is open is counted, and of an interval's level the last one started is the one that holds what is one level deeper."""
    # of starts on one line the longer one is outside
    order = Window.partitionBy("file_id").orderBy("at", "rank", F.desc_nulls_last("interval.end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = events.withColumn("level", F.sum("step").over(order) - (F.col("rank") == 2).cast("int"))
    deeper = both.where("rank <> 3").withColumn("key", F.when(F.col("rank") == 2, F.col("level") + 1).otherwise(F.col("level")))
    met = F.last("interval", ignorenulls=True).over(Window.partitionBy("file_id", "key").orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = deeper.withColumn("within", met).where("rank = 1")
    return found.withColumn("within", F.when((F.col("level") > 0) & (F.col("within.end") >= F.col("at")), F.col("within"))).withColumn("level", F.col("level").cast("int"))
