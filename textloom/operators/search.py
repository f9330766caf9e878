"""Line search: hits, counts, context, pages, filters, and exact trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import smart_pattern
from ..sources.tables import lines


def hits(df: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Lines that match (W7). Texts are tested whole before they are split, so most never are."""
    found = df.where(F.col(text).rlike(pattern))
    return lines(found, text).where(F.col("line_text").rlike(pattern))


def count_per_file(found: DataFrame, key: str, limit: int = 60) -> DataFrame:
    """Matching lines per file, most first, then by key (A3)."""
    return found.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(min(max(limit, 1), 500))


def page(found: DataFrame, key: str, offset: int = 0, per_file: int = 0, most: int = 60) -> DataFrame:
    """A page of hits (W6): skip `offset` hits in (key, line) order, then keep `per_file` of each file, then `most`.

    The place where the page starts is the last of the first offset hits, found by a top-k; what follows is
    numbered per file, so no step orders all hits in one task.
    """
    if offset:
        last = found.select(key, "line").orderBy(key, "line").limit(offset).agg(F.count("*").alias("n"), F.max(F.struct(key, "line")).alias("at")).first()
        if last["n"] < offset:
            return found.limit(0)
        k, n = last["at"]
        found = found.where((F.col(key) > k) | ((F.col(key) == k) & (F.col("line") > n)))
    if per_file:
        found = found.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("line"))).where(F.col("nth") <= per_file).drop("nth")
    return found.orderBy(key, "line").limit(most)


def with_context(df: DataFrame, pattern: str, key: str, n: int = 1, text: str = "text") -> DataFrame:
    """Hits with up to n lines before and after each (W2); overlaps are not merged."""
    order = Window.partitionBy(key).orderBy("line")
    row = F.struct("line", "line_text")
    rows = lines(df.where(F.col(text).rlike(pattern)), text)
    rows = rows.withColumn("before", F.collect_list(row).over(order.rowsBetween(-n, -1))).withColumn("after", F.collect_list(row).over(order.rowsBetween(1, n)))
    return rows.where(F.col("line_text").rlike(pattern))


def context_blocks(rows: DataFrame, hit: Column, keys: list[str], order: str, n: int = 3) -> DataFrame:
    """Blocks of rows within n rows of a hit (W3): windows that overlap or touch are one. (keys, first, last, rows, hits)."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_hit", hit.cast("int")).withColumn("_pos", F.row_number().over(w))
    near = marked.withColumn("_near", F.max("_hit").over(w.rowsBetween(-n, n))).where("_near = 1")
    island = near.withColumn("_island", F.col("_pos") - F.row_number().over(w))
    return island.groupBy(*keys, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows"), F.sum("_hit").alias("hits")).drop("_island")


def line_filter(rows: DataFrame, column: str, keep: str | None = None, drop: str | None = None) -> DataFrame:
    """Lines that match keep and do not match drop, with smart case."""
    if keep is not None:
        rows = rows.where(F.col(column).rlike(smart_pattern(keep)))
    return rows if drop is None else rows.where(~F.col(column).rlike(smart_pattern(drop)))


def head(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def tail(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


# Trigram index


def grams(chars: Column) -> Column:
    """The distinct trigrams of an array of characters, in which null stands for what no trigram may hold."""
    every = F.transform(chars, lambda c, i: F.concat(c, F.get(chars, i + 1), F.get(chars, i + 2)))
    return F.array_compact(F.array_distinct(every))


def gram_index(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(gram, key): which texts hold a trigram in lower case, exactly."""
    chars = df.select(F.col(key), F.split(F.lower(F.col(text)), "").alias("chars"))
    chars = chars.select(key, F.transform("chars", lambda c: F.when(~c.isin("\n", "\r", "\0"), c)).alias("chars"))
    return chars.select(F.explode(grams(F.col("chars"))).alias("gram"), key)


def candidates(index: DataFrame, literals: list[str], key: str) -> DataFrame:
    """Keys of texts with all trigrams of any literal (I5). The literals are a constant of the query."""
    spark = index.sparkSession
    wanted = [(n, lit[i : i + 3]) for n, lit in enumerate(literals) for i in range(len(lit) - 2)]
    need = spark.createDataFrame(sorted(set(wanted)), "literal int, gram string")
    size = need.groupBy("literal").agg(F.count("*").alias("need"))
    found = index.where(F.col("gram").isin(sorted({g for _, g in wanted}))).join(F.broadcast(need), "gram").groupBy(key, "literal").agg(F.count_distinct("gram").alias("have"))
    return found.join(F.broadcast(size), "literal").where("have = need").select(key).distinct()
