"""Exact duplicates with heavy hitters split off (DataFrame functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, cut

#: Counters of the Misra-Gries summary, and the most digests that it can name. Both are constants, so the
#: broadcast table has at most HEAVY rows of about 100 bytes whatever the input.
COUNTERS, HEAVY = 4096, 256


def stripped(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACE_CHARS, F.coalesce(text, F.lit("")))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without white space. Of equal texts the longest original stays,
    then the smallest key; a null key comes last.

    A Misra-Gries summary (Spark's approx_top_k, a frequent-items sketch of that family) names the digests
    that may be frequent. Their exact counts and winners come from a pre-aggregated pass; they are broadcast
    and their rows settle in the map, without a shuffle. The other digests are shuffled: they are counted and ranked with
    reduction in the map as well and joined back, so no task holds a group, however many rows one not named may have.

    Null and empty texts form one group; very long texts are digested whole. Repeated rows with the same key count as
    separate members, of which one is kept. No rows give no rows. Other columns of docs, whatever their names, are ignored.
    """
    prints = cut(
        docs.select(
            F.col(key).alias("key"),
            F.length(F.coalesce(F.col(text), F.lit(""))).alias("n_chars"),
            F.sha2(stripped(F.col(text)).cast("binary"), 256).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    rank = F.struct((-F.col("n_chars")).alias("n"), F.col("key").isNull().alias("no_key"), "key", "row")
    named = prints.select(F.explode(F.expr(f"approx_top_k(digest, {heavy}, {counters})")).alias("x")).select("x.item")
    winners = cut(
        prints.join(F.broadcast(named.withColumnRenamed("item", "digest")), "digest")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.min(rank).alias("best"))
        .where("group_size > 1")
    )
    marked = prints.join(F.broadcast(winners), "digest", "left")
    settled = marked.where("best IS NOT NULL").select(
        "key", F.col("best.key").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "digest"
    )
    others = marked.where("best IS NULL").select("key", "n_chars", "digest", "row")
    groups = others.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(rank).alias("best"))
    rest = others.join(groups, "digest").select("key", F.col("best.key").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "digest")
    return settled.unionByName(rest).select(
        F.col("key").alias(key), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256")
    )


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH p AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM p WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
