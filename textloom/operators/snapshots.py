"""Snapshots of trees: content-addressed manifests, their difference, and restoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import is_secret

MOST_BYTES = 5_000_000


def manifest(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, hash, size) of the files (path, content) that a snapshot takes (F24): not secret, no line break in the
    name, at most so many bytes. A path that comes twice is taken once, its smaller hash."""
    rows = files.where(~is_secret(F.col("path")) & ~F.col("path").rlike(r"[\r\n]") & (F.octet_length("content") <= most_bytes))
    rows = rows.select("path", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size"))
    return rows.groupBy("path").agg(F.min(F.struct("hash", "size")).alias("x")).select("path", "x.hash", "x.size")


def left_out(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, reason) of the files that a snapshot does not take."""
    reason = F.when(is_secret(F.col("path")), "secret").when(F.col("path").rlike(r"[\r\n]"), "name").when(F.octet_length("content") > most_bytes, "size")
    return files.select("path", reason.alias("reason")).where("reason IS NOT NULL")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status, old_hash, hash): A added, D deleted, M modified, between two manifests."""
    o, n = old.select("path", F.col("hash").alias("old_hash")), new.select("path", "hash")
    status = F.when(F.col("old_hash").isNull(), "A").when(F.col("hash").isNull(), "D").otherwise("M")
    return o.join(n, "path", "full_outer").where(~F.col("old_hash").eqNullSafe(F.col("hash"))).select("path", status.alias("status"), "old_hash", "hash")


def line_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, added, removed): changed lines of texts (path, text), as multisets of lines: what a line diff reports when
    no line moves. Lines meet in a shuffle by path and hash, so a long text is not one task's."""
    side = lambda df, v: df.select("path", F.explode(F.split("text", "\n")).alias("row"), F.lit(v).alias("v"))
    counted = side(old, -1).union(side(new, 1)).groupBy("path", F.xxhash64("row").alias("h"), "row").agg(F.sum("v").alias("d"))
    rows = counted.groupBy("path").agg(F.sum(F.greatest("d", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("removed"))
    return rows.where("added + removed > 0")


def restore_preview(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(path, action) of what restore() would do: create, overwrite, or keep for files that the snapshot lacks."""
    now = manifest(current, 1 << 62)
    both = now.select("path", F.col("hash").alias("now")).join(snapshot.select("path", "hash"), "path", "full_outer")
    action = F.when(F.col("now").isNull(), "create").when(F.col("hash").isNull(), "keep").when(F.col("now") != F.col("hash"), "overwrite")
    return both.select("path", action.alias("action")).where("action IS NOT NULL")


def unlike(restored: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(path) of the snapshot's files that a restored tree does not have as they were; none if all is well."""
    now = restored.select("path", F.sha2("content", 256).alias("hash"))
    return snapshot.select("path", "hash").join(now, ["path", "hash"], "left_anti").select("path")


def restore(current: DataFrame, snapshot: DataFrame, contents: DataFrame) -> DataFrame:
    """The files (path, content) as the snapshot has them: contents by hash for what differs, the rest as it is. Files that
    the snapshot lacks stay (M14)."""
    wanted = snapshot.select("path", "hash").join(contents.select("hash", F.col("content").alias("stored")), "hash", "left")
    both = current.join(wanted, "path", "full_outer")
    return both.select("path", F.coalesce("stored", "content").alias("content"))
