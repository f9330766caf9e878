"""Folder trees: roll-ups, rankings, path suffixes, and comparison of two trees. A tree is rows of (path, size)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Folders of copied or generated code that walks skip, and files that hold secrets.
SKIP_DIRS = [
    ".git", "node_modules", "external", "externals", "extern", "third_party", "third-party", "thirdparty", "3rdparty", "3rd-party", "3rd_party", "vendor", "contrib", "Pods",
]
SECRET_NAMES = ["keystore.properties", "local.properties", "google-services-private.json", "id_rsa", "id_ed25519", "credentials.json", ".env"]
SECRET_EXTENSIONS = ["jks", "keystore", "pem", "p12", "pfx", "key", "ppk"]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The extension in lower case; empty if the name has none."""
    name = basename(path)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def top(path: Column) -> Column:
    """The first folder with its slash; files beside it are root files."""
    return F.when(F.contains(path, F.lit("/")), F.concat(F.substring_index(path, "/", 1), F.lit("/"))).otherwise("(root files)")


def folders(path: Column, deepest: int | None = None) -> Column:
    """Every folder above a path, outermost first."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    n = n if deepest is None else F.least(n, F.lit(deepest))
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def is_secret(path: Column) -> Column:
    """Paths that look like secrets."""
    name = F.lower(basename(path))
    named = name.isin(SECRET_NAMES) | (F.startswith(name, F.lit(".env.")) & ~F.endswith(name, F.lit(".example")))
    return named | (F.contains(name, F.lit(".")) & F.substring_index(name, ".", -1).isin(SECRET_EXTENSIONS))


def is_skipped(path: Column, dirs: list[str] = SKIP_DIRS, paths: tuple = ()) -> Column:
    """Paths below a folder that walks skip."""
    found = F.exists(F.split(path, "/"), lambda p: p.isin(list(dirs)))
    for p in paths:
        found = found | (path == p) | F.endswith(path, F.lit("/" + p))
    return found


def folder_rollup(tree: DataFrame, prefix: str = "") -> DataFrame:
    """Files and bytes per folder directly below a prefix."""
    rest = F.substring(F.col("path"), len(prefix) + 1, 1 << 20)
    below = tree.where(F.startswith("path", F.lit(prefix))).withColumn("folder", F.substring_index(rest, "/", 1))
    return below.groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def subtree_sizes(tree: DataFrame, deepest: int | None = None) -> DataFrame:
    """Files and bytes of every folder with all below it (A8, A13). The explosion is by depth and is summed in the map."""
    rows = tree.select(F.explode(folders(F.col("path"), deepest)).alias("folder"), "size")
    return rows.groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def largest(tree: DataFrame, k: int, *columns: str) -> DataFrame:
    """The k largest files, ties by path."""
    return tree.orderBy(F.desc("size"), "path").limit(k).select(*(columns or tree.columns))


def extension_histogram(tree: DataFrame) -> DataFrame:
    """Files per first folder and extension."""
    return tree.groupBy(top(F.col("path")).alias("top"), extension(F.col("path")).alias("ext")).agg(F.count("*").alias("files"))


def dominant(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value per group, the last in name order among equals (A10)."""
    counted = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    return counted.groupBy(group).agg(F.max(F.struct("n", value)).alias("m")).select(group, F.col(f"m.{value}").alias(value), F.col("m.n").alias("n"))


def dominant_folder(tree: DataFrame, share: float = 0.9, levels: int = 6) -> str:
    """The folder that holds almost all files: from the root down, while one child has that share (A11). Each level asks
    for one row."""
    at, n = "", tree.count()
    for _ in range(levels):
        best = folder_rollup(tree.where(F.contains(F.substring("path", len(at) + 1, 1 << 20), F.lit("/"))), at).orderBy(F.desc("files"), "folder").first()
        if best is None or best["files"] < share * n:
            break
        at, n = f"{at}{best['folder']}/", best["files"]
    return at.rstrip("/")


def open_map(tree: DataFrame, rows: int = 12, most: int = 22, kids: int = 8, least: int = 12, deepest: int = 6) -> list[tuple[str, int]]:
    """A short map of a tree (A7): the largest folder is opened into its children until there are `rows` rows. The counts
    are Spark's, of folders of at least `least` files down to a depth; only those come to the driver."""
    counts = {r["folder"]: r["files"] for r in subtree_sizes(tree, deepest).where(F.col("files") >= least).collect()}

    def children(folder: str) -> list[str]:
        return sorted((c for c in counts if c.rpartition("/")[0] == folder), key=lambda c: (-counts[c], c))

    def chain(folder: str) -> str:
        while len(c := children(folder)) == 1 and counts[c[0]] == counts[folder]:
            folder = c[0]
        return folder

    shown, closed = [chain(c) for c in children("")], set()
    while len(shown) < rows:
        opened = next((f for f in sorted(shown, key=lambda f: (-counts[f], f)) if f not in closed), None)
        if opened is None:
            break
        inner = children(opened)
        if not 1 < len(inner) <= kids or len(shown) - 1 + len(inner) > most:
            closed.add(opened)
            continue
        shown = [f for f in shown if f != opened] + [chain(c) for c in inner]
    return sorted((f, counts[f]) for f in shown)


def shortest_suffix(tree: DataFrame) -> DataFrame:
    """(path, suffix): the fewest last parts of each path that no other path ends with."""
    parts = F.split("path", "/")
    rows = tree.select("path").distinct().withColumn("parts", parts)
    rows = rows.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.struct(i.alias("n"), F.array_join(F.slice("parts", -i, i), "/").alias("suffix")))).alias("s")).select("path", "s.n", "s.suffix")
    unique = rows.groupBy("suffix").agg(F.count("*").alias("k"), F.min("path").alias("path"), F.min("n").alias("n")).where("k = 1")
    best = unique.groupBy("path").agg(F.min_by("suffix", "n").alias("suffix"))
    return tree.select("path").distinct().join(best, "path", "left").select("path", F.coalesce("suffix", "path").alias("suffix"))


def find_by_name(tree: DataFrame, name: str) -> DataFrame:
    """Paths that are a name or end with it at a folder's edge; without regard to case only if none fits."""
    p, low, q = F.col("path"), F.lower("path"), F.lit(name)
    exact = (p == q) | F.endswith(p, F.concat(F.lit("/"), q))
    loose = (low == F.lower(q)) | F.endswith(low, F.concat(F.lit("/"), F.lower(q)))
    tier = tree.where(loose).withColumn("tier", F.when(exact, 1).otherwise(2))
    best = tier.agg(F.min("tier").alias("best"))
    return tier.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("tier", "best")


# Two trees: a and b have (path, size, hash) and may have eol_hash (without carriage returns) and mtime.


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per path: kind is same, eol_only, changed, only_a or only_b (J15). One full join on the path."""
    side = lambda df, x: df.select("path", *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c != "path"])
    both = side(a, "a").join(side(b, "b"), "path", "full_outer")
    eol = F.col("eol_hash_a") == F.col("eol_hash_b") if "eol_hash" in a.columns and "eol_hash" in b.columns else F.lit(False)
    kind = (
        F.when(F.col("hash_b").isNull(), "only_a").when(F.col("hash_a").isNull(), "only_b").when(F.col("hash_a") == F.col("hash_b"), "same").when(eol, "eol_only").otherwise("changed")
    )
    return both.withColumn("kind", kind)


def moved(pairs: DataFrame) -> DataFrame:
    """(path_a, path_b): one-sided files of equal content, paired in path order (J16). Equal content is an equivalence, so
    numbering both sides per content gives the greedy one-to-one match."""
    order = Window.partitionBy("hash").orderBy("path")
    side = lambda x: pairs.where((F.col("kind") == f"only_{x}") & (F.col(f"size_{x}") > 0)).select("path", F.col(f"hash_{x}").alias("hash")).withColumn("n", F.row_number().over(order)).withColumnRenamed("path", f"path_{x}")
    return side("a").join(side("b"), ["hash", "n"]).select("path_a", "path_b")


def by_top(pairs: DataFrame) -> DataFrame:
    """Counts per first folder, most differences first."""
    is_ = lambda k: F.count_if(F.col("kind") == k)
    rows = pairs.groupBy(top(F.col("path")).alias("top")).agg(
        F.count_if(F.col("kind") != "only_b").alias("in_a"), F.count_if(F.col("kind") != "only_a").alias("in_b"), is_("same").alias("same"),
        (is_("changed") + is_("eol_only")).alias("differ"), is_("only_a").alias("only_a"), is_("only_b").alias("only_b"),
    )
    return rows.orderBy(F.desc(F.col("differ") + F.col("only_a") + F.col("only_b")), "top")


def newer(a: Column, b: Column, tolerance: int = 2) -> Column:
    """A or B if that side is newer by more than the tolerance in whole seconds, else null."""
    seconds = lambda x: F.unix_micros(x.cast("timestamp"))
    gap = F.floor((seconds(b) - seconds(a)) / 1_000_000), F.floor((seconds(a) - seconds(b)) / 1_000_000)
    return F.when(gap[0] > tolerance, "B").when(gap[1] > tolerance, "A")


def verdict(pairs: DataFrame) -> DataFrame:
    """Whether side a can go (A16): one row of only_a, newer_a, changed and verdict. Needs mtime on both sides."""
    by = newer(F.col("mtime_a"), F.col("mtime_b"))
    changed = F.col("kind") == "changed"
    counts = pairs.agg(
        F.count_if(F.col("kind") == "only_a").alias("only_a"), F.count_if(changed & (by == "A")).alias("newer_a"),
        F.count_if(changed & (by == "B")).alias("newer_b"), F.count_if(changed).alias("changed"),
    )
    return counts.withColumn("verdict", F.when(F.col("only_a") > 0, "NOT SAFE").when(F.col("newer_a") > 0, "CHECK").otherwise("SAFE"))


def one_sided(pairs: DataFrame, side: str = "a") -> DataFrame:
    """(key, files, bytes): files of one side only, folded to the highest folder without a common file."""
    common = pairs.where(~F.col("kind").isin("only_a", "only_b")).select(F.explode(folders(F.col("path"))).alias("folder")).distinct()
    only = pairs.where(F.col("kind") == f"only_{side}").select("path", F.col(f"size_{side}").alias("size"))
    above = only.select("path", F.posexplode(folders(F.col("path"))).alias("depth", "folder")).join(common, "folder", "left_anti")
    highest = above.groupBy("path").agg(F.min_by("folder", "depth").alias("folder"))
    rows = only.join(highest, "path", "left").withColumn("key", F.coalesce(F.concat("folder", F.lit("/")), "path"))
    return rows.groupBy("key").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, updated, removed or unchanged, by mtime and size."""
    o = old.select("path", F.col("mtime").alias("mo"), F.col("size").alias("so"))
    n = new.select("path", F.col("mtime").alias("mn"), F.col("size").alias("sn"))
    change = F.when(F.col("so").isNull(), "added").when(F.col("sn").isNull(), "removed").when((F.col("mo") == F.col("mn")) & (F.col("so") == F.col("sn")), "unchanged").otherwise("updated")
    return o.join(n, "path", "full_outer").select("path", change.alias("change"))
