"""File trees as tables: scans with the rules of code search, and readers of parsed formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.code_index import LANGUAGES
from ..operators.trees import SKIP_DIRS, extension, is_skipped

#: Extensions that are never text, prose that a code search leaves out, and copied-library folders.
BINARY_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "ico", "webp", "svg", "mp3", "wav", "ogg", "flac", "mp4", "avi", "mov", "mkv", "zip", "tar", "gz", "7z", "rar", "jar", "aar", "apk", "aab", "dex",
    "so", "dylib", "dll", "exe", "bin", "class", "pyc", "pdf", "db", "sqlite", "sqlite3",
]
PROSE_EXTENSIONS = ["md", "txt", "rst"]
VENDOR_DIRS = ["external", "externals", "extern", "third_party", "third-party", "thirdparty", "3rdparty", "3rd-party", "3rd_party", "vendor", "contrib"]
MOST_BYTES, MOST_NAMED_BYTES = 1_500_000, 256_000_000


def scan(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, mtime, size, content) of all files below a root, paths relative with slashes (S1, S2, S4). Without content in
    the columns that follow, the bytes are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    base = F.lit(root.split("://")[-1].removeprefix("file:").rstrip("/") + "/")
    plain = F.regexp_replace("path", r"^[a-z]+:/*(?=/)", "")
    return reader.load(root).select(F.replace(plain, base, F.lit("")).alias("path"), (F.unix_micros("modificationTime") / 1000).cast("long").alias("mtime"), F.col("length").alias("size"), "content")


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(pattern, keeps) of the lines of an ignore file (S1): * stays in a name, ** does not, a slash at the end means folders, one before it
    ties the rule to the root, ! keeps what rules before it ignore."""
    rules = []
    for line in text.splitlines():
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        keeps, rule = rule.startswith("!"), rule.lstrip("!")
        folder, rule = rule.endswith("/"), rule.rstrip("/")
        parts = re.split(r"(/\*\*/|\*\*/|/\*\*|\*|\?)", rule.lstrip("/"))
        signs = {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}
        body = "".join(signs.get(x, re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", x)) for x in parts)
        rules.append((("^" if "/" in rule else "(?:^|/)") + body + ("/" if folder else "(?:/|$)"), keeps))
    return rules


def is_ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that fits a path ignores it."""
    out = F.lit(False)
    for pattern, keeps in rules:
        out = F.when(path.rlike(pattern), F.lit(not keeps)).otherwise(out)
    return out


def is_binary(content: Column) -> Column:
    """A NUL among the first 8 KB."""
    return F.contains(F.substring(content, 1, 8192), F.lit(b"\x00"))


def code_files(tree: DataFrame, ignore: str = "") -> DataFrame:
    """Files of a language the index knows, outside skipped folders and what an ignore file names."""
    wanted = extension(F.col("path")).isin(list(LANGUAGES)) & ~is_skipped(F.col("path"), SKIP_DIRS)
    return tree.where(wanted & ~is_ignored(F.col("path"), ignore_rules(ignore)))


def searchable(tree: DataFrame, types: list[str] | None = None, prose: bool = False, vendor: bool = False) -> DataFrame:
    """Files that a search reads (F18): no binary type, not too large, of the types asked for, prose and copied libraries only
    if asked for."""
    ext = extension(F.col("path"))
    keep = ~ext.isin(BINARY_EXTENSIONS) & (F.col("size") <= MOST_BYTES)
    if types:
        keep = keep & ext.isin([t.lower().lstrip(".") for t in types])
    elif not prose:
        keep = keep & ~ext.isin(PROSE_EXTENSIONS)
    return tree.where(keep if vendor else keep & ~F.exists(F.split(F.lower("path"), "/"), lambda p: p.isin(VENDOR_DIRS)))


def named_files(tree: DataFrame, scopes: list[str]) -> DataFrame:
    """Files named or below a named folder; a file that is named is read whatever its type, up to 256 MB."""
    path, found = F.col("path"), F.lit(False)
    for scope in scopes:
        s = scope.strip("/")
        found = found | (path == s) | F.startswith(path, F.lit(s + "/"))
    return tree.where(found & (F.col("size") <= MOST_NAMED_BYTES))


def texts(tree: DataFrame) -> DataFrame:
    """Files with content as text, binary ones left out."""
    return tree.where(~is_binary(F.col("content"))).withColumn("content", F.decode("content", "UTF-8"))


def manifest_packages(content: Column) -> Column:
    """Declared packages of a JSON manifest as array<struct<package, section>>; of a package in several sections the first
    counts (S15)."""
    def fresh(names: Column, seen: Column) -> Column:
        return F.filter(names, lambda n: ~F.exists(seen, lambda x: x["package"] == n))

    def labelled(names: Column, section: str) -> Column:
        return F.transform(names, lambda n: F.struct(n.alias("package"), F.lit(section).alias("section")))

    out = F.array().cast("array<struct<package:string,section:string>>")
    for section in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
        found = F.map_keys(F.from_json(F.get_json_object(content, f"$.{section}"), "map<string,string>"))
        out = F.concat(out, labelled(fresh(F.coalesce(found, F.array().cast("array<string>")), out), section))
    return out
