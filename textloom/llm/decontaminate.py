"""Benchmark decontamination by MinHash containment search (DataFrame functions only)."""

from __future__ import annotations

from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small
from .common import words as split_words

#: Words in a shingle, share of an item's shingles that a document must hold, and the chance that the
#: sketch of an item of that containment shares nothing with the document.
N, THRESHOLD, MISS = 5, 0.8, 1e-7


def words(text: Column) -> Column:
    """The words of a text in lower case, letters and digits only, so that a passage is found in capitals as well."""
    return split_words(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x20\x09-\x0D]+", ""))


def shingles(ws: Column, n: int) -> Column:
    """The shingles of n words as strings, in order; none if there are fewer words."""
    return F.when(
        F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.array_join(F.slice(ws, i, n), " "))
    ).otherwise(F.array().cast("array<string>"))


def hashes(ws: Column, n: int) -> Column:
    """As shingles(), but hashed."""
    return F.when(
        F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.xxhash64(F.slice(ws, i, n)))
    ).otherwise(F.array().cast("array<bigint>"))


def sketch_size(largest: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """How many minima an item of up to `largest` shingles needs, so that one of them is in any document
    that holds `threshold` of the item, but for a chance of `miss`."""
    absent = largest - ceil(threshold * largest)
    return next(k for k in range(1, absent + 2) if comb(absent, k) <= miss * comb(largest, k))


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (key, item_key, shared, item_shingles, containment) where the document holds at least
    `threshold` of the item's distinct word shingles.

    Items are partitioned by the size of their shingle set (powers of two). Each partition has its own sketch
    length, from its largest size, and an item's sketch is its smallest shingle hashes. A document is a
    candidate if any of its shingles is one of those minima. The minima of the whole document cannot be used:
    a 20,000-word document and a 30-word item have a Jaccard similarity near 0.001, which no banding finds.
    Candidates are read again and the exact shingles are counted.

    Items of fewer than n words are one shingle of their own length; items and documents without words
    match nothing. Rows that share a key are read as one document, rows that share an item_key as one item.
    Null keys are a key of their own, of documents and of items. Words compare in lower case, by their letters and
    digits; very long texts are searched whole. Repeated rows add nothing. No documents or no items give no pairs. Other
    columns of either table, whatever their names, are ignored.
    """
    terms = items.select(F.col(item_key).alias("item"), words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    sizes = sorted(r[0] for r in terms.select(F.least(F.size("w"), F.lit(n))).distinct().collect())  # at most n values
    by_size = lambda make: F.coalesce(*[F.when(F.least(F.size("w"), F.lit(n)) == k, make(F.col("w"), k)) for k in sizes])
    if not sizes:
        return docs.select(F.col(key), F.lit(None).cast(items.schema[item_key].dataType).alias(item_key), F.lit(0).cast("long").alias("shared"), F.lit(0).cast("long").alias("item_shingles"), F.lit(0.0).alias("containment")).where("false")
    wanted = cut(terms.select("item", F.explode(by_size(shingles)).alias("shingle")).distinct())
    hashed = terms.select("item", F.explode(by_size(hashes)).alias("h")).distinct()
    grouped = hashed.groupBy("item").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    part = F.ceil(F.log2(F.size("hs").cast("double"))).cast("int")
    length = F.element_at(F.array(*[F.lit(sketch_size(2**p, threshold)) for p in range(32)]), part + 1)
    sketch = cut(grouped.select("item", F.explode(F.slice(F.col("hs"), F.lit(1), length)).alias("h")).select("h").distinct())
    least = wanted.groupBy("item").count().agg(F.min("count")).first()[0]  # a document needs that share of it at least
    probe = docs.select(F.col(key).alias("key"), words(F.col(text)).alias("w")).where(F.size("w") >= ceil(threshold * least))
    doc_hashes = F.flatten(F.array(*[hashes(F.col("w"), k) for k in sizes])) if len(sizes) > 1 else hashes(F.col("w"), sizes[0])
    found = cut(probe.select("key", F.explode(doc_hashes).alias("h")).join(small(sketch), "h", "left_semi").groupBy("key").agg(F.count("*").alias("hits")).select("key"))
    doc = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    candidates = doc.join(small(found.withColumnRenamed("key", "k")), F.col("key").eqNullSafe(F.col("k")), "left_semi")
    candidates = candidates.select("key", words(F.col("text")).alias("w"))
    doc_shingles = F.flatten(F.array(*[shingles(F.col("w"), k) for k in sizes]))
    held = candidates.select("key", F.explode(F.array_distinct(doc_shingles)).alias("shingle")).join(small(wanted), "shingle")
    held = held.groupBy("key", "item").agg(F.count_distinct("shingle").alias("shared"))
    full = wanted.groupBy("item").agg(F.count("*").alias("item_shingles"))
    pairs = held.join(small(full.withColumnRenamed("item", "i")), F.col("item").eqNullSafe(F.col("i"))).withColumn("containment", F.col("shared") / F.col("item_shingles"))
    return pairs.where(F.col("containment") >= threshold).select(F.col("key").alias(key), F.col("item").alias(item_key), "shared", "item_shingles", "containment")


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs that hold no item, with all their columns. Every row is judged by its own text, also if
    rows share a key or have none."""
    row = lambda df: F.xxhash64(df[key], df["text"])
    leaks = small(cut(contained(docs.select(row(docs).alias("row"), docs["text"]), items, "row").select(F.col("row").alias("leak")).distinct()))
    return docs.join(leaks, row(docs) == leaks["leak"], "left_anti")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s, least(len(w), 5) AS k
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM bw WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM bs),
ds AS (SELECT DISTINCT doc_id, s FROM (
         SELECT doc_id, array_to_string(w[i : i + k - 1], ' ') AS s
         FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, k WHERE len(w) >= k))
       WHERE s IN (SELECT s FROM bs)),
n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(item_shingles) AS item_shingles,
       count(*) / any_value(item_shingles) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) / any_value(item_shingles) >= 0.8
"""
