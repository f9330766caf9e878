"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, small, workspace

WEIGHTS, CAP, SEED = (1, 2, 3), 3, 17
#: Words in a block and in an output shard, about; and the blocks that are summed together first.
BLOCK_WORDS, SHARD_WORDS, FAN = 50_000, 2_000_000, 256


def word_count(text: Column) -> Column:
    """How many runs of characters other than white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^" + SPACE[1:-1] + "]+")).cast("long")


def draw_hash(key: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(key, text, F.lit(seed))


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = 1.0, cap: float = CAP) -> DataFrame:
    """(source, sid, source_size, target). Sources in code-point order, null last, take the weights in turn.

    Targets share `share` of all words by weight; a target above `cap` times its source stops there and the
    rest is shared again by weight. In the order of cap * size / weight, the sources that stop are a prefix,
    so one running sum finds the final level. The windows see one row per source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.withColumn("sid", F.row_number().over(order)).withColumn("weight", F.element_at(turn, (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("most", cap * F.col("source_size").cast("double"))
    total, weight = F.least(share * F.sum("source_size").over(every), F.sum("most").over(every)), F.sum("weight").over(every)
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (weight - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    sources = sources.withColumn("total", total).withColumn("stops", level >= F.col("most") / F.col("weight"))
    left = F.col("total") - F.sum(F.when(F.col("stops"), F.col("most")).otherwise(0.0)).over(every)
    free = F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(every)
    return sources.select("source", "sid", "source_size", F.when(F.col("stops"), F.col("most")).otherwise(F.col("weight") * left / F.nullif(free, F.lit(0.0))).alias("target"))


#: Draws from which the generator's own hypergeometric sampler refuses.
LARGE = 10**9


def drawn_of(rng: np.random.Generator, own: int, others: int, take: int) -> int:
    """How many of `take` draws without replacement come from `own` and not from `others`; of LARGE or more by the normal
    distribution with that mean and variance, within what is possible."""
    if own + others < LARGE:
        return int(rng.hypergeometric(own, others, take))
    n = own + others
    mean, share = take * own / n, own / n
    spread = (take * share * (1 - share) * (n - take) / (n - 1)) ** 0.5
    return int(min(max(round(rng.normal(mean, spread)), take - others, 0), own, take))


def dealt_draws(rng: np.random.Generator, quota: np.ndarray, take: int) -> np.ndarray:
    """A multivariate hypergeometric draw, one source after the other beyond LARGE."""
    left = int(quota.sum())
    if left < LARGE:
        return rng.multivariate_hypergeometric(quota, take, method="marginals")
    out = []
    for own in quota.tolist():
        left -= own
        out.append(drawn_of(rng, own, left, take) if left else take)
        take -= out[-1]
    return np.array(out, np.int64)


def split_quotas(shards: Iterator[pd.DataFrame], sids: list[int], draws: list[int], count: int, seed: int) -> Iterator[pd.DataFrame]:
    """For each shard (a leaf) its first draw and number of draws of every source.

    The root holds all draws. A node splits its exact source quotas between its halves by a multivariate
    hypergeometric draw seeded by the node, so each leaf finds its own path without the rest of the tree.
    """
    for frame in shards:
        out = []
        for shard in frame["id"]:
            quota, offset = np.array(draws, np.int64), np.zeros(len(draws), np.int64)
            lo, hi = 0, count
            while hi - lo > 1:
                mid = (lo + hi) // 2
                rng = np.random.default_rng([seed, lo, hi])
                take = int(quota.sum()) * (mid - lo) // (hi - lo)
                left = dealt_draws(rng, quota, take)
                if shard < mid:
                    quota, hi = left, mid
                else:
                    offset, quota, lo = offset + left, quota - left, mid
            out += [(int(shard), s, int(o), int(q)) for s, o, q in zip(sids, offset, quota, strict=True) if q]
        yield pd.DataFrame(out, columns=["shard", "sid", "first", "quota"])


def plan(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.0, cap: float = CAP, shards: int | None = None, seed: int = SEED, key: str = "doc_id", text: str = "text", source: str = "source", block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(sized, sources, blocks, shards): what mix() and taken() apply.

    A row's hash puts it into a block of its source; blocks have about block_words words, so their order by
    number is a random permutation of the source in pieces. A target of t words over a source of s words takes
    every block t // s times, then blocks from the first on, of the last block the rows of the smallest
    hashes that fit, and one more row if that comes nearer to the target. All draws are dealt to shards by the splitting tree. One row per
    source (sid, draws) goes through the driver; everything else stays in tables keyed by source and block.
    """
    spark = docs.sparkSession
    with workspace(spark) as keep:
        sized = keep(cut(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), draw_hash(F.col(key), F.col(text), seed).alias("h"))))
        sources = source_targets(sized, weights, share, cap).withColumn("passes", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("int"))
        sources = sources.withColumn("need", F.col("target") - F.col("passes") * F.col("source_size"))
        sources = cut(sources.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("int")).coalesce(1))
        near = small(sources.select(F.col("source").alias("s"), "sid", "n", "need"))
        placed = sized.join(near, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod("h", "n").cast("int"))
        sums = cut(placed.groupBy("sid", "block", "need").agg(F.sum("size").alias("words")))
        before = Window.partitionBy("sid").orderBy("upper").rowsBetween(Window.unboundedPreceding, -1)
        upper = sums.groupBy("sid", "need", (F.col("block") / FAN).cast("int").alias("upper")).agg(F.sum("words").alias("words"))
        upper = upper.withColumn("past", F.coalesce(F.sum("words").over(before), F.lit(0))).where("need > 0 AND past <= need AND need < past + words").select("sid", "upper", "past")
        inner = Window.partitionBy("sid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        edge = sums.withColumn("upper", (F.col("block") / FAN).cast("int")).join(upper, ["sid", "upper"])
        edge = edge.withColumn("past", F.col("past") + F.coalesce(F.sum("words").over(inner), F.lit(0))).where("past <= need AND need < past + words")
        edge = cut(edge.select("sid", F.col("block").alias("last"), (F.col("need") - F.col("past")).alias("rest")))
        rows = placed.join(small(edge.withColumnRenamed("sid", "e")), (F.col("sid") == F.col("e")) & (F.col("block") == F.col("last")))
        running = F.sum("size").over(Window.partitionBy("sid").orderBy("h").rangeBetween(Window.unboundedPreceding, 0))
        ranked = cut(rows.groupBy("sid", "rest", "h").agg(F.sum("size").alias("size")).withColumn("upto", running))
        at = ranked.groupBy("sid").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("upto", "h"))).alias("fits"))
        at = at.select("sid", F.col("fits.h").alias("h_last"), F.coalesce("fits.upto", F.lit(0)).alias("upto_last"))
        gap = F.col("rest") - F.col("upto_last")
        more = ranked.join(at, "sid").where((F.col("upto") > F.col("upto_last")) & (F.abs(gap - F.col("size")) < gap))
        at = at.join(more.groupBy("sid").agg(F.min_by("h", F.struct(F.abs(gap - F.col("size")), "h")).alias("h_more")), "sid", "left").drop("upto_last")
        sources = keep(cut(sources.join(edge.join(at, "sid", "left"), "sid", "left").withColumn("last", F.coalesce("last", F.lit(-1))).withColumn("draws", F.col("passes") * F.col("n") + F.col("last") + 1).coalesce(1)))
        per_source = sources.where("draws > 0").select("sid", "draws").orderBy("sid").collect()
        words = sources.agg(F.sum("target")).first()[0] or 0
        shards = shards or max(1, int(words // SHARD_WORDS))
        leaves = spark.range(0, shards, 1, min(shards, max(1, shards // 64) + 1))
        sids, draws = [r["sid"] for r in per_source], [r["draws"] for r in per_source]
        quotas = leaves.mapInPandas(lambda it: split_quotas(it, sids, draws, shards, seed), "shard int, sid int, first long, quota long") if sids else spark.createDataFrame([], "shard int, sid int, first long, quota long")
        dealt = quotas.select("sid", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("quota") - 1)).alias("draw"))
        dealt = dealt.join(small(sources.select("sid", "n")), "sid").select("sid", (F.col("draw") % F.col("n")).cast("int").alias("block"), (F.col("draw") / F.col("n")).cast("int").alias("pass"), "shard")
        blocks = keep(cut(dealt.groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("dealt"))))
    return sized, sources, blocks, shards


def drawn(rows: DataFrame, sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows with h and source, each with its draws: an array of (pass, shard)."""
    facts = small(sources.select(F.col("source").alias("s"), "sid", "source_size", "target", "n", "passes", "last", "h_last", "h_more"))
    rows = rows.join(facts, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod("h", "n").cast("int"))
    rows = rows.join(small(blocks), ["sid", "block"], "left")
    part = (F.col("h") <= F.col("h_last")) | (F.col("h") == F.col("h_more"))
    whole = (F.col("block") < F.col("last")) | ((F.col("block") == F.col("last")) & F.coalesce(part, F.lit(False)))
    dealt = F.coalesce("dealt", F.array().cast("array<struct<pass:int,shard:int>>"))
    return rows.withColumn("draws", F.filter(dealt, lambda d: (d["pass"] < F.col("passes")) | whole)).drop("s", "dealt", "n", "passes", "last", "h_last", "h_more", "sid", "block")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The rows of the mix, each as often as it is drawn, with the columns of docs and shard: dealt into
    shards and shuffled within them. A document is drawn at most `cap` times, if cap is whole. Reruns agree.

    Null or empty texts have no words; they go along with their block. Very long texts are taken whole or not at all.
    Rows that are repeated with key and text are drawn together. Null keys and sources are values like others. No rows
    make no mix. Columns of docs named like those used here are safe.
    """
    _, sources, blocks, shards = plan(docs, key=key, text=text, source=source, seed=seed, **options)
    packed = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), draw_hash(F.col(key), F.col(text), seed).alias("h"))
    rows = drawn(packed, sources, blocks).select("row", "h", F.explode("draws").alias("d")).select("row", "h", "d.pass", "d.shard")
    rows = rows.repartitionByRange(shards, "shard").sortWithinPartitions("shard", F.xxhash64("h", "pass"))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns], *([] if "shard" in docs.columns else ["shard"]))


def taken(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row per row of docs: key, size, source_size, target (its source's), taken (words that the mix takes), shards
    (the shards that the splitting tree deals it to, one for each time it is taken). Cases as in mix()."""
    sized, sources, blocks, _ = plan(docs, key=key, **options)
    rows = drawn(sized, sources, blocks)
    return rows.select(F.col("key").alias(key), "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("size") * F.size("draws")).cast("long").alias("taken"), F.col("draws.shard").alias("shards"))


def mix_targets(spark, sf_dir: str) -> DataFrame:
    """What op2_mix_sources aims at: doc_id, size, source_size, target."""
    sized = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sources = source_targets(sized).withColumnRenamed("source", "s")
    return sized.join(small(sources), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", F.coalesce(F.round("target", 6), F.lit(0.0)).alias("target"))


#: The targets of mix_targets, by filling sources one after the other: of those left the one that stops first, if it does.
SQL_TARGETS = r"""
WITH RECURSIVE sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3.0 * sum(size) AS most, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0 AS weight FROM sized GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS k, count(*) OVER () AS n FROM s),
fill(k, words, weights, level) AS (
  SELECT CAST(1 AS BIGINT), CAST(sum(source_size) AS DOUBLE), CAST(sum(weight) AS DOUBLE), CAST(NULL AS DOUBLE) FROM s
  UNION ALL
  SELECT f.k + 1, f.words - CASE WHEN f.words / f.weights >= most / weight THEN most ELSE 0 END, f.weights - CASE WHEN f.words / f.weights >= most / weight THEN weight ELSE 0 END,
    CASE WHEN f.words / f.weights >= most / weight THEN NULL ELSE f.words / f.weights END
  FROM fill f JOIN o ON o.k = f.k WHERE f.level IS NULL AND f.weights > 1e-9),
level AS (SELECT coalesce(max(level), 1e300) AS level FROM fill)
SELECT doc_id, size, source_size, round(least(most, weight * level), 6) AS target FROM sized JOIN o ON o.source IS NOT DISTINCT FROM sized.source CROSS JOIN level
"""


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))
