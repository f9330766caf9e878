"""What the operators of this folder share: shared storage, checked broadcasts, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import kept as cut
from ..operators.storage import release, scratch, shared_folder, workspace

__all__ = ["BROADCAST_BYTES", "SPACE", "SPACE_CHARS", "components", "cut", "release", "scratch", "shared_folder", "small", "width", "words", "workspace"]

#: The white space that separates words everywhere in this folder.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Bytes up to which a side is broadcast; beyond it, both sides are shuffled.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark df for broadcast if its rows have at most limit bytes; beyond that leave the join to Spark. df is read
    twice, so it should be cheap or cut."""
    return F.broadcast(df) if width(df) <= limit else df


def width(df: DataFrame) -> int:
    """About how many bytes the rows of df have: strings and arrays by their contents, other values 8 each."""
    sizes = [F.lit(8 * len(df.columns))]
    for field in df.schema.fields:
        kind, value = field.dataType.simpleString(), F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(value), F.lit(0)))
        elif kind.startswith(("array", "map", "struct")):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0)))
    total = sizes[0].cast("long")
    for size in sizes[1:]:
        total = total + size
    return df.agg(F.sum(total)).first()[0] or 0


def words(text: Column) -> Column:
    """The words of a text as an array: maximal runs without white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, label), label the smallest node of the component.

    Edges are contracted by turns to the smallest node around their lower end and around their upper end, until every
    component is a star, which takes a few rounds even for long chains; there are never more edges than at first and
    nodes. Hubs are safe: a round joins edges with one minimum per node, which Spark can split, and minima are pre-aggregated.
    What a round does not pass on goes at its end.
    """
    star = cut(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct())
    while True:
        with workspace(edges.sparkSession) as keep:
            around = star.select(F.col("lo").alias("u"), F.col("lo").alias("v")).unionByName(star.select(F.col("hi").alias("u"), F.col("lo").alias("v"))).groupBy("u").agg(F.min("v").alias("m"))
            large = cut(star.join(around, F.col("lo") == F.col("u")).select("hi", F.col("m").alias("lo")).distinct())
            least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
            inner = large.join(least, F.col("hi") == F.col("u")).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            star = keep(cut(inner.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct()))
        several = star.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1").select("hi")
        if several.unionByName(star.join(star.select(F.col("hi").alias("lo")), "lo", "left_semi").select("hi")).isEmpty():
            return star.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(star.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
