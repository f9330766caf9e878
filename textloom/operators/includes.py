"""Headers that source files include, over several levels, and the text they bring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import kept

#: Levels of includes, bytes of a header and of all headers of a file, folders above a file that are searched.
DEEPEST, MOST_HEADER, MOST_ALL, FOLDERS = 2, 300_000, 900_000, 8
_INCLUDE = r"(?m)^\s*#\s*include\s+\"([^\"]+)\""


def _above(path: str) -> list:
    """Columns of the folders in which a file's includes are looked for, the nearest first; the root is empty."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.transform(F.sequence(F.lit(0), F.least(n, F.lit(FOLDERS - 1))), lambda k: F.array_join(F.slice(parts, F.lit(1), n - k), "/"))


def wanted(files: DataFrame, same_name: bool) -> DataFrame:
    """(path, name) of quoted includes, and of a source's header of the same name."""
    rows = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(_INCLUDE), 1)).alias("name"))
    if same_name:
        stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
        rows = rows.unionByName(files.select("path", F.explode(F.transform(F.array(*map(F.lit, ("h", "hpp", "hh"))), lambda e: F.concat(stem, F.lit("."), e))).alias("name")))
    return rows.distinct()


def included(sources: DataFrame, files: DataFrame, deepest: int = DEEPEST, most_header: int = MOST_HEADER, most_all: int = MOST_ALL) -> DataFrame:
    """(path, header, depth, bytes) of the headers among files (path, content) that each source (path, content) includes.

    A name is looked for in the folder of the file that includes it and in those above; the nearest file of that path counts.
    Headers of headers follow up to a depth; each counts once, at its smallest depth. Headers of most_header bytes or more are left
    out, and of one source's headers, by depth and path, those before which most_all bytes are reached. Every level is one
    join on equal paths, written before the next one.
    """
    texts = files.select(F.col("path").alias("header"), F.octet_length(F.coalesce("content", F.lit(""))).alias("bytes")).where(F.col("bytes") < most_header)
    links = kept(_resolved(wanted(files.select("path", "content"), False), texts))
    step = kept(_resolved(wanted(sources.select("path", "content"), True), texts).where("path <> header").distinct().withColumn("depth", F.lit(0)))
    found = step
    for depth in range(1, deepest + 1):
        after = step.select("path", F.col("header").alias("via")).join(links.withColumnRenamed("path", "via"), "via").select("path", "header").where("path <> header").distinct()
        step = kept(after.join(found, ["path", "header"], "left_anti").withColumn("depth", F.lit(depth)))
        found = found.unionByName(step)
    rows = found.join(texts, "header")
    order = Window.partitionBy("path").orderBy("depth", "header").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("bytes").over(order), F.lit(0))).where(F.col("before") < most_all).select("path", "header", "depth", "bytes")


def _resolved(names: DataFrame, texts: DataFrame) -> DataFrame:
    places = names.select("path", "name", F.posexplode(_above("path")).alias("far", "folder"))
    full = F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name"))
    met = places.select("path", "name", "far", full.alias("header")).join(texts.select("header"), "header")
    return met.groupBy("path", "name").agg(F.min_by("header", "far").alias("header")).select("path", "header").distinct()


def expanded(sources: DataFrame, files: DataFrame, **limits: int) -> DataFrame:
    """sources with the texts of their headers before their own, by depth and path."""
    met = included(sources, files, **limits).join(files.select(F.col("path").alias("header"), F.col("content").alias("text")), "header")
    heads = met.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("depth", "header", "text"))).alias("heads"))
    rows = sources.join(heads, "path", "left")
    text = F.array_join(F.transform("heads", lambda h: F.concat(h["text"], F.lit("\n"))), "")
    return rows.withColumn("content", F.concat(F.coalesce(text, F.lit("")), F.coalesce("content", F.lit("")))).drop("heads")
