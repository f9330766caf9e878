"""Project folders as tables of files (path, size, ...): what they are made of, what they import, what is generated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import imported, package_of
from .trees import basename, extension, folders

#: Marker files of a kind of project, first match first; names of entry points by priority; folders that a
#: build makes; types of files whose imports are read, up to a size.
MARKERS = (
    ("android", ("settings.gradle", "settings.gradle.kts", "AndroidManifest.xml")),
    ("web", ("package.json",)),
    ("rust", ("Cargo.toml",)),
    ("java", ("pom.xml", "build.gradle", "build.gradle.kts")),
    ("python", ("pyproject.toml", "setup.py", "requirements.txt")),
    ("go", ("go.mod",)),
    ("dart", ("pubspec.yaml",)),
)
ENTRY_NAMES = [
    "main.tsx", "main.ts", "index.tsx", "index.ts", "main.jsx", "index.jsx", "main.js", "index.js", "app.tsx", "App.tsx", "main.rs", "lib.rs", "main.py", "__main__.py", "app.py",
    "main.go", "MainActivity.kt", "Main.kt", "MainActivity.java", "Main.java", "Program.cs", "main.dart", "main.cpp", "main.c", "main.swift", "App.swift",
]
GENERATED_DIRS = [".git", "node_modules", ".gradle", "build", ".cxx", "target", ".idea", ".dart_tool", "__pycache__", ".next", ".vs", "pods", "intermediates"]
SOURCE_EXTENSIONS = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts", "vue", "svelte"]
MOST_SOURCE_BYTES = 2 << 20


def entries_below(tree: DataFrame, start: str = "", hidden: bool = False) -> DataFrame:
    """(path, is_dir): files and folders below a folder, by paths relative to it; hidden ones if asked for."""
    prefix = start.strip("/") + "/" if start.strip("/") else ""
    files = tree.where(F.startswith("path", F.lit(prefix))).select(F.substring("path", len(prefix) + 1, 1 << 20).alias("path"))
    if not hidden:
        files = files.where(~F.exists(F.split("path", "/"), lambda p: F.startswith(p, F.lit("."))))
    dirs = files.select(F.explode(folders(F.col("path"))).alias("path")).distinct()
    return files.select("path", F.lit(False).alias("is_dir")).unionByName(dirs.select("path", F.lit(True).alias("is_dir")))


def generated(path: Column, dirs: list[str] = GENERATED_DIRS) -> Column:
    """The outermost generated folder of a path, null if it has none."""
    inner = F.filter(folders(path), lambda f: F.lower(F.substring_index(f, "/", -1)).isin(list(dirs)))
    return F.get(inner, F.lit(0))


def folded_generated(tree: DataFrame, dirs: list[str] = GENERATED_DIRS) -> DataFrame:
    """(folder, files, bytes) of generated folders, instead of their files."""
    rows = tree.withColumn("folder", generated(F.col("path"), dirs)).where("folder IS NOT NULL")
    return rows.groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def skipped_by_name(a: DataFrame, b: DataFrame, dirs: list[str] = GENERATED_DIRS) -> DataFrame:
    """(name, bytes_a, bytes_b) per name of a generated folder that either side has."""
    side = lambda t, c: folded_generated(t, dirs).groupBy(basename(F.col("folder")).alias("name")).agg(F.sum("bytes").alias(c))
    both = side(a, "bytes_a").join(side(b, "bytes_b"), "name", "full_outer")
    return both.select("name", F.coalesce("bytes_a", F.lit(0)).alias("bytes_a"), F.coalesce("bytes_b", F.lit(0)).alias("bytes_b"))


def stack(tree: DataFrame, key: str = "project") -> DataFrame:
    """(key, stack): the kind of each project by the marker files it has; the first kind of MARKERS counts."""
    rank = F.lit(None).cast("int")
    for i, (_, names) in reversed(list(enumerate(MARKERS))):
        rank = F.when(basename(F.col("path")).isin(list(names)), i).otherwise(rank)
    best = tree.groupBy(key).agg(F.min(rank).alias("r"))
    return best.select(key, F.get(F.array(*[F.lit(name) for name, _ in MARKERS]), "r").alias("stack"))


def entry_point(tree: DataFrame, key: str = "project", names: list[str] = ENTRY_NAMES, deepest: int = 6) -> DataFrame:
    """(key, path): the file of the first entry name that a project has, in any case, the shallowest one."""
    at = F.array_position(F.array(*[F.lit(n.lower()) for n in names]), F.lower(basename(F.col("path"))))
    depth = F.size(F.split("path", "/"))
    rows = tree.where((at > 0) & (depth <= deepest))
    return rows.groupBy(key).agg(F.min_by("path", F.struct(at.alias("a"), depth.alias("d"), F.col("path").alias("p"))).alias("path"))


def imports(files: DataFrame, aliases: list[str] | None = None) -> DataFrame:
    """(path, package): packages that source files (path, content) import, each once per file."""
    from ..sources.tables import lines

    named = files.where(extension(F.col("path")).isin(SOURCE_EXTENSIONS) & (F.octet_length("content") <= MOST_SOURCE_BYTES))
    specs = lines(named.select("path", "content"), "content").select("path", F.explode(imported(F.col("line_text"))).alias("spec"))
    return specs.select("path", package_of(F.col("spec"), tuple(aliases or ("@", "~"))).alias("package")).where("package IS NOT NULL").distinct()


def importing_files(found: DataFrame) -> DataFrame:
    """(package, files, names): how many files import a package, and the names of these, sorted."""
    rows = found.select("package", "path", basename(F.col("path")).alias("name")).distinct()
    return rows.groupBy("package").agg(F.count_distinct("path").alias("files"), F.array_sort(F.collect_set("name")).alias("names"))


def path_aliases(config: Column) -> Column:
    """The first parts of the path aliases in a compiler configuration with comments."""
    plain = F.regexp_replace(F.regexp_replace(config, r"(?s)/\*(?!\*?/\*).*?\*/(?=\s*[\"}\],\n]|\s*$)", ""), r"(?m)^\s*//.*$|(?<=[,{\[])\s*//[^\n]*$", "")
    block = F.regexp_extract(plain, r"(?s)\"paths\"\s*:\s*\{(.*?)\}", 1)
    keys = F.regexp_extract_all(block, F.lit(r"\"([^\"]+)\"\s*:"), 1)
    return F.array_distinct(F.transform(keys, lambda k: F.regexp_replace(k, r"/?\*$", "")))


def newest(tree: DataFrame, test: Column, key: str = "project") -> DataFrame:
    """(key, path, mtime): the newest of the files that pass a test, of equal ones the first path."""
    best = tree.where(test).groupBy(key).agg(F.max("mtime").alias("mtime"))
    return tree.where(test).join(best, [key, "mtime"]).groupBy(key, "mtime").agg(F.min("path").alias("path"))


def version_of(text: Column, name: str = "versionCode") -> Column:
    """The whole number that a build file sets a name to."""
    return F.regexp_extract(text, name + r"\s*=?\s*(\d+)", 1).try_cast("long")


def with_version(text: Column, version: Column, name: str = "versionCode") -> Column:
    """The text with the first such number replaced."""
    return F.regexp_replace(text, F.lit(r"(?s)\A(.*?" + name + r"\s*=?\s*)\d+"), F.concat(F.lit("$1"), version.cast("string")))


def next_version(files: DataFrame, text: str = "content", name: str = "versionCode") -> DataFrame:
    """One more than the largest version of all files, 1 if none has one."""
    return files.agg((F.coalesce(F.max(version_of(F.col(text), name)), F.lit(0)) + 1).alias("next"))


def status_counts(rows: DataFrame, code: str = "code") -> DataFrame:
    """Counts of staged, unstaged and untracked files from two-letter status codes."""
    x, y = F.substring(code, 1, 1), F.substring(code, 2, 1)
    new = F.col(code) == "??"
    return rows.agg(F.count_if(~new & (x != " ")).alias("staged"), F.count_if(~new & (y != " ")).alias("unstaged"), F.count_if(new).alias("untracked"))


def with_numstat(changed: DataFrame, stats: DataFrame) -> DataFrame:
    """Changed files (path, ...) with added and deleted lines (path, added, deleted); null where none are known."""
    return changed.join(stats, "path", "left")


def by_size_change(pairs: DataFrame) -> DataFrame:
    """Compared files with their change of size, the largest first, then by path (T4)."""
    change = F.coalesce("size_b", F.lit(0)) - F.coalesce("size_a", F.lit(0))
    return pairs.withColumn("change", change).orderBy(F.desc(F.abs("change")), "path")


def kind_tag(path: Column, dirs: list[str] = GENERATED_DIRS) -> Column:
    """What a folder is by its name, empty for others and for folders below a source folder."""
    parts = F.split(F.lower(path), "/")
    last = F.element_at(parts, -1)
    in_source = F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.isin("src", "source", "sources"))
    named = F.when(last == ".git", "git history: keep").when(last.isin(".idea", ".vs"), "IDE settings").when(last.isin("node_modules", "pods"), "dependencies").when(last.isin(list(dirs)), "build output")
    return F.when(in_source, "").otherwise(F.coalesce(named, F.lit("")))


def remote_url(remote: Column) -> Column:
    """The web address of a remote: owner/name, git@host:path and ssh forms count as https."""
    plain = F.regexp_replace(F.trim(remote), r"\.git/?$", "")
    short = plain.rlike(r"^[\w.-]+/[\w.-]+$")
    ssh = F.regexp_replace(F.regexp_replace(plain, r"^ssh://(?:[^@/]+@)?", "https://"), r"^[\w.-]+@([^:/]+):", "https://$1/")
    return F.when(short, F.concat(F.lit("https://github.com/"), plain)).otherwise(ssh)


def xml_text(text: Column) -> Column:
    """A text with the character references of XML decoded, the ampersand last."""
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#10;", "\n"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def environment_names(text: Column) -> Column:
    """Names of environment variables that a build file reads."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"""(?:getenv|env\.get|environ\.get|process\.env\.)\(?\[?["']?([A-Z][A-Z0-9_]+)"""), 1)))


def is_zip(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(b"PK\x03\x04")


def cache_dir(text: Column, name: str = "CMAKE_HOME_DIRECTORY") -> Column:
    """The folder that a build cache names, with slashes, in lower case and without one at its end."""
    found = F.regexp_extract(text, rf"(?m)^{name}(?::[A-Z]+)?=(.*)$", 1)
    return F.nullif(F.regexp_replace(F.lower(F.replace(F.trim(found), F.lit("\\"), F.lit("/"))), "/+$", ""), F.lit(""))


def shortened(texts: DataFrame, short: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Texts in which every known path is its short form (X41). short: (path, short). Words meet paths in a join, so any
    number of paths serves; words keep their place and what surrounds them."""
    words = texts.select(key, F.posexplode(F.split(text, " ")).alias("n", "word"))
    core = F.regexp_extract("word", r"^[\"'(\[`]*(.*?)[\"')\]`.,;:]*$", 1)
    met = words.withColumn("path", core).join(short, "path", "left")
    word = F.when(F.col("short").isNotNull(), F.expr("replace(word, path, short)")).otherwise(F.col("word"))
    return met.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", word.alias("w")))), lambda x: x["w"]), " ").alias(text))
