"""A text index that lives on: what it knows of a tree of files, what is stale, and what a search has to read.

The index has one row per file that was read: path, mtime, size, grams (distinct trigrams of the text in lower case), bits (a Bloom
filter of them; null for a file that is not text). A row is valid only while the file has the mtime and size that were read
with its content, so rows are only ever added: what a search learns is one more table of a version, whose size is that of what
changed, and rows of older states match no file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import required_literals
from . import versions
from .search import hits
from .storage import kept

ROW = "path string, mtime long, size long, grams int, bits array<long>"
#: Bits of a filter per distinct trigram, rounded up to a power of two, and at least.
BITS_PER_GRAM, LEAST_BITS = 6, 256
#: Odd multipliers of the two positions of a trigram: the golden ratio and the square root of two in 64 bits.
FACTORS = (0x9E3779B97F4A7C15, 0xB504F333F9DE6485)
#: Keys up to which the files to read are a filter.
FEW = 5000
_line_ends = np.array([ord(c) for c in "\n\r\0"], np.uint32)


def trigrams(text: str) -> np.ndarray:
    """The distinct trigrams of a text as numbers, without those that span lines."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(chars) < 3:
        return np.zeros(0, np.uint64)
    plain = ~np.isin(chars, _line_ends)
    inside = plain[:-2] & plain[1:-1] & plain[2:]
    wide = chars.astype(np.uint64)
    return np.unique((wide[:-2] | wide[1:-1] << np.uint64(21) | wide[2:] << np.uint64(42))[inside])


def positions(grams: np.ndarray) -> np.ndarray:
    """Two positions of 31 bits per trigram; a filter takes as many low bits as it has."""
    return np.concatenate([(grams * np.uint64(f)) >> np.uint64(33) for f in FACTORS])


def bloom(grams: np.ndarray) -> np.ndarray:
    """The filter as words of 64 bits."""
    bits = max(LEAST_BITS, 1 << (BITS_PER_GRAM * len(grams) - 1).bit_length()) if len(grams) else LEAST_BITS
    flags = np.zeros(bits, np.uint8)
    flags[positions(grams) & np.uint64(bits - 1)] = 1
    return np.packbits(flags, bitorder="little").view("<i8")


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, filters = [], []
        for text in batch.column("text"):
            found = trigrams(text.as_py()) if text.is_valid else None
            sizes.append(None if found is None else len(found))
            filters.append(None if found is None else bloom(found))
        columns = [batch.column(c) for c in ("path", "mtime", "size")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int32()), pa.array(filters, pa.list_(pa.int64()))], names=["path", "mtime", "size", "grams", "bits"])


def is_binary(content: Column) -> Column:
    return F.contains(F.substring(content, 1, 8192), F.lit("\0"))


def learn(read: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """The index rows of files that were read (path, mtime, size, content): one pass over their texts, without a shuffle (I3, I4,
    I7). A file that changed since it was read, as tree says, is not learnt (M11). Null content counts as empty."""
    still = read if tree is None else read.join(tree.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_semi")
    content = F.coalesce("content", F.lit(""))
    rows = still.select("path", F.col("mtime").cast("long"), F.col("size").cast("long"), F.when(~is_binary(content), F.lower(content)).alias("text"))
    return rows.mapInArrow(_filters, ROW)


def allows(bits: Column, literals: list[str]) -> Column:
    """Whether a filter admits a text with any of the literals: all trigrams of one are in it (I5). Bit operations only."""
    mask = F.size(bits).cast("long") * 64 - 1

    def has(position: int) -> Column:
        word = F.get(bits, F.shiftright(F.lit(position).bitwiseAND(mask), 6).cast("int"))
        return F.shiftright(word, position & 63).bitwiseAND(F.lit(1)) == 1

    found = F.lit(False)
    for literal in literals:
        every = F.lit(True)
        for position in sorted({int(p) for p in positions(trigrams(literal))}):
            every = every & has(position)
        found = found | every
    return found


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ROW)


def plan(index: DataFrame, tree: DataFrame) -> DataFrame:
    """(path, state) of every file on disk (path, mtime, size) or in the index: fresh, binary (fresh, and known to hold no text), stale,
    unknown or gone (J5, I6)."""
    now = tree.select("path", "mtime", "size", F.lit(True).alias("there"))
    rows = index.select("path", "mtime", "size", F.lit(True).alias("known"), F.col("bits").isNull().alias("binary"))
    both = now.withColumn("known", F.lit(None).cast("boolean")).withColumn("binary", F.lit(None).cast("boolean")).unionByName(rows.withColumn("there", F.lit(None).cast("boolean")))
    states = both.groupBy("path", "mtime", "size").agg(F.max("there").alias("there"), F.max("known").alias("known"), F.max("binary").alias("binary"))
    fresh = F.col("there") & F.col("known")
    per_path = states.groupBy("path").agg(F.max("there").alias("there"), F.max("known").alias("known"), F.max(fresh).alias("fresh"), F.max(fresh & F.col("binary")).alias("binary"))
    state = F.when(F.col("there").isNull(), "gone").when(F.col("known").isNull(), "unknown").when(F.col("fresh").isNull(), "stale").when(F.col("binary"), "binary").otherwise("fresh")
    return per_path.select("path", state.alias("state"))


def to_read(index: DataFrame, tree: DataFrame, pattern: str) -> DataFrame:
    """(path) of files of the tree (path, mtime, size) that a search for the pattern has to read: those the index does not know
    as they are, and of the others those that their filter does not rule out. Without a literal in the pattern all but
    binary ones. Filters are tested where they are stored; only the answers are joined."""
    literals = required_literals(pattern)
    answer = F.when(F.col("bits").isNull(), False).otherwise(allows(F.col("bits"), literals) if literals else F.lit(True))
    known = index.select("path", "mtime", "size", answer.alias("maybe"))
    asked = tree.select("path", "mtime", "size").join(known, ["path", "mtime", "size"], "left")
    return asked.where(F.coalesce("maybe", F.lit(True))).select("path").distinct()


def search(index: DataFrame, tree: DataFrame, pattern: str) -> DataFrame:
    """The lines (path, line, line_text) that match, as a full search of the text files of the tree finds them. """
    read = among(tree, to_read(index, tree, pattern), "path").where(~is_binary(F.col("content")))
    return hits(read.select("path", "content"), pattern, "content")


def indexed_hits(df: DataFrame, index: DataFrame, pattern: str, key: str, text: str = "text") -> DataFrame:
    """As hits() of a table whose rows the index knows by their key (I8), reading only texts that filters admit; all texts if the
    pattern tells nothing (I9)."""
    literals = required_literals(pattern)
    if literals:
        df = among(df, index.where(allows(F.col("bits"), literals)).select(F.col("path").cast(df.schema[key].dataType).alias(key)), key)
    return hits(df, pattern, text)


def among(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of df with one of the keys. Up to FEW keys are a filter, which the scan of df knows; more are written, so that their size
    decides how they are joined."""
    few = keys.limit(FEW + 1).collect()
    if len(few) <= FEW:
        return df.where(F.col(key).isin([r[0] for r in few]))
    return df.join(kept(keys), key, "left_semi")


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of the greatest version in a folder."""
    _, content = versions.latest(spark, folder)
    return spark.read.schema(ROW).parquet(*content["rows"]) if content.get("rows") else empty(spark)


def add(spark: SparkSession, folder: str, rows: DataFrame) -> int:
    """Commit a version with rows beside those there are. If another writer was first, both stay."""
    path = versions.add_table(rows, folder, "rows")
    while True:
        number, content = versions.latest(spark, folder)
        try:
            return versions.commit(spark, folder, number, {"rows": [*content.get("rows", []), path]})
        except versions.Conflict:
            continue


def refresh(spark: SparkSession, folder: str, tree: DataFrame) -> int:
    """Learn the files of the tree (path, mtime, size, content) that the index does not know as they are. The cost is that of
    the changed files and of a join of paths."""
    known = open_index(spark, folder).select("path", "mtime", "size")
    new = kept(tree.select("path", "mtime", "size").join(known, ["path", "mtime", "size"], "left_anti"))
    return add(spark, folder, learn(tree.join(new.select("path"), "path", "left_semi")))


def compact(spark: SparkSession, folder: str, tree: DataFrame) -> int:
    """Commit a version of one table with the rows that are still valid, each once."""
    number, _ = versions.latest(spark, folder)
    rows = open_index(spark, folder).join(tree.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_semi")
    path = versions.add_table(rows.dropDuplicates(["path", "mtime", "size"]), folder, "rows")
    return versions.commit(spark, folder, number, {"rows": [path]})
