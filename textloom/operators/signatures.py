"""Signatures and outlines of files, members of classes, and the text of definitions.

Symbols are rows (path, name, kind, owner, start_line, end_line); kind is class, function or method. Lines are rows (path,
line, line_text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a signature and of a definition, at most.
MOST_HEAD, MOST_BODY = 25, 150


def gathered(symbols: DataFrame, files: DataFrame, most: int = MOST_HEAD) -> DataFrame:
    """symbols with signature: the declaration's lines as one, up to the line where its brackets are closed (E12). files: (path, content).
    A file meets its declarations in one row, and each of them reads at most so many of its lines."""
    own = [c for c in symbols.columns if c != "path"]
    by_file = symbols.groupBy("path").agg(F.collect_list(F.struct(*own)).alias("found"))
    parts = files.select("path", F.split("content", "\n").alias("parts"))
    parts = parts.withColumn("parts", F.when(F.element_at("parts", -1) == "", F.slice("parts", F.lit(1), F.size("parts") - 1)).otherwise(F.col("parts")))
    opens = lambda t: F.length(F.replace(t, F.lit(")"), F.lit(""))) - F.length(F.replace(t, F.lit("("), F.lit("")))
    none = F.lit(None).cast("string")

    def step(head: Column, t: Column) -> Column:
        plain = F.when(F.endswith(t, F.lit("\r")), F.left(t, F.length(t) - 1)).otherwise(t)
        depth = head["depth"] + opens(t)
        longer = F.struct(F.concat_ws(" ", head["text"], F.trim(plain)).alias("text"), depth.alias("depth"), (depth <= 0).alias("closed"))
        return F.when(head["closed"], head).otherwise(longer)

    def signature(s: Column) -> Column:
        near = F.slice("parts", s["start_line"], F.lit(most))
        text = F.aggregate(near, F.struct(none.alias("text"), F.lit(0).alias("depth"), F.lit(False).alias("closed")), step, lambda head: F.when(F.size(near) > 0, head["text"]))
        return F.regexp_replace(F.regexp_replace(text, r"\s*(\{.*|:|=>.*)?\s*$", ""), r"\s+", " ")

    rows = by_file.join(parts, "path", "left")
    rows = rows.select("path", F.inline(F.transform("found", lambda s: F.struct(*[s[c].alias(c) for c in own], signature(s).alias("signature")))))
    return rows.select(*symbols.columns, "signature")


def parameters(signature: Column) -> Column:
    """What a signature has in its outermost brackets."""
    return F.trim(F.regexp_extract(signature, r"^[^(]*\((.*)\)", 1))


def signature_rows(symbols: DataFrame) -> DataFrame:
    """symbols with row_kind (type or method) and ord, from 0 in each file: types first, then methods, each by line (K3)."""
    kind = F.when(F.col("kind") == "class", "type").otherwise("method")
    rows = symbols.withColumn("row_kind", kind)
    order = Window.partitionBy("path").orderBy(F.col("row_kind") != "type", "start_line", "name")
    return rows.withColumn("ord", F.row_number().over(order) - 1)


def below(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows of a file or of the files below a folder."""
    prefix = prefix.strip("/")
    return rows.where((F.col("path") == prefix) | F.startswith("path", F.lit(prefix + "/"))) if prefix else rows


def outlines(signatures: DataFrame, prefix: str = "", what: str = "signature") -> DataFrame:
    """(path, types, rows): the signatures of each file in order, as an array, and how many are types."""
    rows = below(signatures, prefix).groupBy("path").agg(F.count_if(F.col("row_kind") == "type").alias("types"), F.array_sort(F.collect_list(F.struct("ord", F.col(what).alias("text")))).alias("rows"))
    return rows.withColumn("rows", F.transform("rows", lambda r: r["text"]))


def overview_match(signatures: DataFrame, word: str) -> DataFrame:
    """Paths that hold a word in their path or in the name of a type or method, in any case."""
    low = word.lower()
    return signatures.where(F.contains(F.lower("path"), F.lit(low)) | F.contains(F.lower("name"), F.lit(low))).select("path").distinct()


def has_path(files: DataFrame, prefix: str) -> bool:
    """Whether a file or a folder of that name is indexed."""
    return not below(files, prefix).isEmpty()


def members(symbols: DataFrame, path: str, owner: str) -> DataFrame:
    """The methods of an owner in one file, by line."""
    return symbols.where((F.col("path") == path) & (F.col("owner") == owner) & (F.col("kind") == "method")).orderBy("start_line")


def member_counts(symbols: DataFrame) -> DataFrame:
    """(class, members) of every class, also of those without members."""
    classes = symbols.where("kind = 'class'").select(F.col("name").alias("class")).distinct()
    owned = symbols.where("owner IS NOT NULL AND kind <> 'class'").groupBy(F.col("owner").alias("class")).agg(F.count("*").alias("members"))
    return classes.join(owned, "class", "left").select("class", F.coalesce("members", F.lit(0)).alias("members"))


def bridges(symbols: DataFrame) -> DataFrame:
    """Symbols that a bridge between languages starts or ends at (F11): native methods and functions named Java_..."""
    return symbols.where((F.col("detail") == "native") | F.startswith("name", F.lit("Java_")))


def merged_bases(symbols: DataFrame) -> DataFrame:
    """(class, bases): the bases of all classes of one name, each once, sorted."""
    rows = symbols.where("kind = 'class'").select(F.col("name").alias("class"), F.explode("bases").alias("base"))
    return rows.groupBy("class").agg(F.array_sort(F.collect_set("base")).alias("bases"))


def matches_language(path: Column, language: Column, wanted: str) -> Column:
    """Whether a path is of an asked language: by extension, by the language that the extension means, or by a part of the
    language's name (F12)."""
    from .code_index import LANGUAGES
    from .trees import extension

    word = wanted.lower().lstrip(".")
    same = F.coalesce(language == F.lit(LANGUAGES.get(word)), F.lit(False))
    return (extension(path) == word) | same | F.contains(F.lower(F.coalesce(language, F.lit(""))), F.lit(word))


def definition_text(symbols: DataFrame, lines: DataFrame, key: str = "id", most: int = MOST_BODY) -> DataFrame:
    """(key, text, more): the lines of each symbol from its start to its end, at most so many, and how many more there are
    (E22)."""
    last = F.least(F.col("end_line"), F.col("start_line") + most - 1)
    spots = symbols.select(key, "path", (F.col("end_line") - last).alias("more"), F.explode(F.sequence(F.col("start_line"), last)).alias("line"))
    met = spots.join(lines.select("path", "line", "line_text"), ["path", "line"])
    found = met.groupBy(key, "more").agg(F.array_sort(F.collect_list(F.struct("line", "line_text"))).alias("rows"))
    return found.select(key, F.array_join(F.transform("rows", lambda r: r["line_text"]), "\n").alias("text"), "more")


def read_specs(lines: DataFrame, specs: list[str], most: int = 200) -> DataFrame:
    """(spec, path, line, line_text) of several ranges at once (X17): each spec is file, file#L5 or file:10-20, and a file is named by its
    whole path or by the end of it behind a slash. The specs are a constant of the query."""
    from .edits import range_spec

    rows = [(s, *range_spec(s)) for s in specs]
    asked = lines.sparkSession.createDataFrame([(s, p, a or 1, (b or 1 << 30) if a else 120) for s, p, a, b in rows], "spec string, file string, first int, last int")
    asked = asked.withColumn("last", F.least("last", F.col("first") + most - 1))
    name = F.substring_index("path", "/", -1)
    met = lines.select("path", "line", "line_text", name.alias("_n")).join(F.broadcast(asked.withColumn("_n", F.substring_index("file", "/", -1))), "_n")  # a row per spec
    return met.where(((F.col("path") == F.col("file")) | F.endswith("path", F.concat(F.lit("/"), "file"))) & F.col("line").between(F.col("first"), F.col("last"))).select("spec", "path", "line", "line_text")


def adapter_symbols(lines: DataFrame, rules: dict[str, str], guess: int = 15) -> DataFrame:
    """(path, line, kind, name, end_line) by one pattern per kind, whose first group is the name (E20). A symbol ends before the next one
    of its file, at most `guess` lines down."""
    found = F.lit(None).cast("struct<kind:string,name:string>")
    for kind, pattern in reversed(rules.items()):
        found = F.when(F.col("line_text").rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line_text", pattern, 1).alias("name"))).otherwise(found)
    rows = lines.withColumn("s", found).where("s IS NOT NULL").select("path", "line", "s.kind", "s.name")
    following = F.lead("line").over(Window.partitionBy("path").orderBy("line"))
    return rows.withColumn("end_line", F.least(F.coalesce(following - 1, F.col("line") + guess), F.col("line") + guess))


def top_names(symbols: DataFrame, most: int = 8) -> DataFrame:
    """(path, names, more): the first names of a file that have no owner, by line (G-6)."""
    rows = symbols.where("owner IS NULL").withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("start_line", "name")))
    found = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.struct("n", "name")))).alias("x"), F.count("*").alias("k"))
    return found.select("path", F.transform("x", lambda r: r["name"]).alias("names"), (F.col("k") - F.size("x")).alias("more"))
