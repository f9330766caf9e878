"""Ignore files of any folder of a tree, as tables: rules meet paths by the folders above them, and the last one that fits decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trees import folders


def rules(files: DataFrame) -> DataFrame:
    """(folder, depth, ord, fits, dir_only, keeps) of the lines of ignore files (path, content). fits is an expression for paths relative to
    the folder: * and ? stay in a name, ** does not, a slash before the end ties a rule to its folder, one at the end
    means folders, ! keeps what rules before it ignore. Blank lines and comments are no rules."""
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    rows = files.select(folder.alias("folder"), F.posexplode(F.split("content", "\r?\n")).alias("ord", "line"))
    rows = rows.withColumn("line", F.regexp_replace("line", r"(?<!\\)\s+$", "")).where("line <> '' AND NOT startswith(line, '#')")
    rows = rows.withColumn("keeps", F.startswith("line", F.lit("!"))).withColumn("line", F.regexp_replace("line", r"^[!\\]", ""))
    rows = rows.withColumn("dir_only", F.endswith("line", F.lit("/"))).withColumn("line", F.regexp_replace("line", "/$", ""))
    tied = F.contains("line", F.lit("/"))
    body = F.regexp_replace(F.regexp_replace("line", "^/", ""), r"([\\.^$|+()\[\]{}])", r"\\$1")
    for sign, mark in (("**/", "\x01"), ("/**", "\x02"), ("*", "[^/]*"), ("?", "[^/]"), ("\x01", "(?:.*/)?"), ("\x02", "/.*")):
        body = F.replace(body, F.lit(sign), F.lit(mark))
    fits = F.concat(F.lit("^"), F.when(tied, "").otherwise("(?:.*/)?"), body, F.lit("$"))
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    return rows.select("folder", depth.alias("depth"), "ord", fits.alias("fits"), "dir_only", "keeps")


def entries(tree: DataFrame) -> DataFrame:
    """(path, is_dir): the files of a tree and all folders above them, each once."""
    dirs = tree.select(F.explode(folders(F.col("path"))).alias("path")).distinct()
    return tree.select("path").distinct().select("path", F.lit(False).alias("is_dir")).unionByName(dirs.select("path", F.lit(True).alias("is_dir")))


def judged(tree: DataFrame, files: DataFrame) -> DataFrame:
    """(path, is_dir, ignored) of every entry that a rule of a folder above it fits: the deepest folder's last rule decides."""
    above = lambda p: F.concat(F.array(F.lit("")), folders(p))
    asked = entries(tree).select("path", "is_dir", F.explode(above(F.col("path"))).alias("folder"))
    met = asked.join(rules(files), "folder")
    inside: Column = F.when(F.col("folder") == "", F.col("path")).otherwise(F.substr("path", F.length("folder") + 2))
    met = met.where(F.col("is_dir") | ~F.col("dir_only")).withColumn("inside", inside).where("inside RLIKE fits")
    return met.groupBy("path", "is_dir").agg(F.max_by(~F.col("keeps"), F.struct("depth", "ord")).alias("ignored"))


def not_ignored(tree: DataFrame, files: DataFrame) -> DataFrame:
    """The files of a tree (path, ...) that its ignore files (path, content) leave (S1): neither a file itself nor a folder above it is
    ignored, so nothing below an ignored folder is kept by a later rule. Rules and paths are tables of any size; they
    meet by equal folders."""
    gone = judged(tree, files).where("ignored")
    below = tree.select("path", F.explode(F.concat(folders(F.col("path")), F.array("path"))).alias("entry"))
    hidden = below.join(gone.select(F.col("path").alias("entry")), "entry", "left_semi").select("path").distinct()
    return tree.join(hidden, "path", "left_anti")
