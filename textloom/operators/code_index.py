"""A code index as tables: files, symbols, call sites and edges, extracted and resolved with joins and windows.

Ids are hashes of what identifies a row, so a refresh keeps the ids of what did not change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let
from . import versions
from .intervals import enclosing, nested  # noqa: F401
from .lexer import with_code
from .links import NOT_CALLS
from .storage import kept

#: Languages by extension, and method names too common to link by name alone.
LANGUAGES = {
    "kt": "Kotlin", "kts": "Kotlin", "java": "Java", "c": "C/C++", "cc": "C/C++", "cpp": "C/C++", "cxx": "C/C++", "h": "C/C++", "hpp": "C/C++", "hh": "C/C++", "rs": "Rust", "py": "Python",
    "ts": "TypeScript", "tsx": "TypeScript", "js": "TypeScript", "jsx": "TypeScript", "go": "Go", "swift": "Swift", "cs": "C#", "dart": "Dart",
}
COMMON_METHODS = [
    "push", "pop", "get", "set", "insert", "remove", "len", "is_empty", "new", "map", "iter", "clone", "unwrap", "contains", "join", "next", "take", "skip", "find", "filter",
    "collect", "from", "into", "to_string", "as_str", "trim", "split", "replace", "write", "read", "push_str", "extend", "clear", "first", "last", "keys", "values", "entry",
    "min", "max", "sort", "dedup", "flush", "lock", "open", "close", "run", "add", "delete", "update", "parse", "format", "print", "log", "then", "catch", "forEach", "includes",
    "append", "count", "start", "stop", "emit", "send", "call", "apply", "bind", "ok", "err", "default", "build", "init", "exists", "starts_with", "ends_with", "chars", "lines",
]
LIBC = [
    "strerror", "printf", "fprintf", "snprintf", "sprintf", "vsnprintf", "puts", "memcpy", "memset", "memmove", "memcmp", "malloc", "calloc", "realloc", "free", "strlen",
    "strcmp", "strncmp", "strcpy", "strncpy", "strcat", "strchr", "strstr", "fopen", "fclose", "fread", "fwrite", "fseek", "ftell", "rewind", "fflush", "open", "close", "read",
    "write", "ioctl", "poll", "select", "usleep", "sleep", "nanosleep", "clock_gettime", "gettimeofday", "getenv", "atoi", "atol", "abs", "exit", "abort", "perror", "errno",
    "pthread_create", "pthread_join", "mmap", "munmap", "dup", "pipe", "fcntl", "stat", "lseek", "unlink", "qsort", "bsearch",
]

_NAME = r"([A-Za-z_]\w*)"
_MODIFIERS = r"(?:public|private|protected|internal|static|final|abstract|open|override|suspend|inline|data|sealed|inner|operator|virtual|async|export|default|native|external|synchronized|readonly|partial|const|unsafe|pub(?:\([a-z]+\))?|@\w+)"
#: Declarations by language: (kind, pattern whose first group is the name and whose second, if any, is the owner). The
#: patterns are tried in order on a line. Spaces before a word are matched possessively: else each of them is tried again.
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "Kotlin": [("class", rf"^\s*+(?:{_MODIFIERS}\s+)*(?:enum\s+class|annotation\s+class|class|interface|object)\s+{_NAME}"), ("function", rf"^\s*+(?:{_MODIFIERS}\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w<>.?]+\.)?{_NAME}\s*\(")],
    "Java": [("class", rf"^\s*+(?:{_MODIFIERS}\s+)*(?:class|interface|enum|record|@interface)\s+{_NAME}"), ("function", rf"^\s*+(?:{_MODIFIERS}\s+)+(?:<[^>]*>\s*)?(?:[\w<>\[\],.?]+\s+)?{_NAME}\s*\([^;=]*$")],
    "C/C++": [("class", rf"^\s*+(?:class|struct|namespace|enum(?:\s+class)?)\s+{_NAME}\s*(?:final\s*)?(?::[^;:]|\{{|$)"), ("function", rf"^\s*(?!return\b|else\b|new\b|delete\b|using\b|typedef\b|std::lock_guard|std::unique_lock)(?:[\w:<>*&,~\s]+?[\s*&]+)?(?:([A-Za-z_]\w*)::)?(~?[A-Za-z_]\w*)\s*\([^;]*(?:\)|,|\{{)\s*(?:const|override|noexcept|final|=\s*0|;|\{{|:|$).*$")],
    "Rust": [("class", rf"^\s*+(?:{_MODIFIERS}\s+)*(?:struct|enum|trait|union)\s+{_NAME}"), ("impl", r"^\s*+(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?([A-Za-z_]\w*)"), ("function", rf"^\s*+(?:{_MODIFIERS}\s+)*(?:extern\s+\"[^\"]*\"\s+)?fn\s+{_NAME}")],
    "Python": [("class", rf"^\s*+class\s+{_NAME}"), ("function", rf"^\s*+(?:async\s+)?def\s+{_NAME}\s*\(")],
    "TypeScript": [
        ("class", rf"^\s*+(?:{_MODIFIERS}\s+)*(?:class|interface|enum)\s+{_NAME}"), ("class", rf"^\s*+(?:export\s+)?type\s+{_NAME}\s*(?:<[^>]*>)?\s*="), ("function", rf"^\s*+(?:{_MODIFIERS}\s+)*function\s*\*?\s*{_NAME}\s*[(<]"),
        ("function", rf"^\s*+(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::\s*[\w<>\[\]| ]+)?\s*=>"), ("member", rf"^\s++(?:{_MODIFIERS}\s+)*(?:get\s+|set\s+)?{_NAME}\s*\([^;]*\)\s*(?::\s*[^{{;]+)?\{{"),
    ],
    "Go": [("class", rf"^\s*type\s+{_NAME}\s+(?:struct|interface)"), ("function", rf"^func\s+{_NAME}\s*[(\[]"), ("receiver", rf"^func\s+\(\s*\w*\s*\*?\s*([A-Za-z_]\w*)[^)]*\)\s*{_NAME}\s*\(")],
    "Swift": [("class", rf"^\s*+(?:{_MODIFIERS}\s+)*(?:class|struct|protocol|enum|extension|actor)\s+{_NAME}"), ("function", rf"^\s*+(?:{_MODIFIERS}\s+)*func\s+{_NAME}"), ("function", r"^\s*+(?:\w+\s+)*(init)\s*[?(]")],
    "C#": [("class", rf"^\s*+(?:{_MODIFIERS}\s+)*(?:class|struct|interface|enum|record)\s+{_NAME}"), ("member", rf"^\s*+(?:{_MODIFIERS}\s+)+(?:[\w<>\[\],.?]+\s+)?{_NAME}\s*(?:\(|\{{\s*get|=>)")],
    "Dart": [("class", rf"^\s*+(?:abstract\s+|sealed\s+)?(?:class|mixin|enum|extension|typedef)\s+{_NAME}"), ("function", rf"^\s*(?:(?:static|external|final|late)\s+)*(?!return\b|await\b|else\b|new\b|throw\b)(?:[\w<>?,\[\] ]+\s+)(?:get\s+)?{_NAME}\s*\([^;]*\)\s*(?:async\*?\s*)?(?:\{{|=>)")],
}


def family(language: Column) -> Column:
    """Languages that call each other by name: Kotlin and Java are one, every other is its own."""
    return F.when(language.isin("Kotlin", "Java"), "JVM").otherwise(language)


def language_of(path: Column) -> Column:
    ext = F.lower(F.substring_index(path, ".", -1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext)


def file_id(path: Column) -> Column:
    return F.xxhash64(path)


def numbered(files: DataFrame, more: bool = False) -> DataFrame:
    """Lines of files (path, content) with their language, their code without comments and literals (bare), the braces that they open and
    close, and the indentation. With more, also the head of a type (its line and the next ones) and the declaration on a line
    (decl). Nothing is shuffled: the lines around are those of the file's array."""
    known = files.select("path", F.col("content"), language_of(F.col("path")).alias("language")).where("language IS NOT NULL")
    read = with_code(known).select("path", "language", F.split("content", "\n").alias("texts"), F.split("code", "\n").alias("bares"))
    read = read.withColumn("n_lines", F.size("bares") - (F.element_at("texts", -1) == "").cast("int"))
    unended = lambda c: F.when(F.endswith(c, F.lit("\r")), F.left(c, F.length(c) - 1)).otherwise(c)
    read = read.withColumn("bares", F.transform(F.slice("bares", F.lit(1), "n_lines"), unended))
    head = lambda b, i: F.when(b.rlike(r"\b(class|struct|interface|object|record|mixin|enum)\b"), F.array_join(F.slice("bares", i + 1, F.lit(HEAD_LINES)), " "))
    parts = [F.slice("texts", F.lit(1), "n_lines").alias("line_text"), F.col("bares").alias("bare")]
    if more:
        parts += [F.transform("bares", head).alias("head"), F.transform("bares", lambda b: declaration(b, F.col("language"))).alias("decl")]
    rows = read.select(file_id(F.col("path")).alias("file_id"), "path", "language", "n_lines", F.posexplode(F.arrays_zip(*parts)).alias("line", "x"))
    rows = rows.select("file_id", "path", "language", "n_lines", (F.col("line") + 1).alias("line"), unended(F.col("x.line_text")).alias("line_text"), "x.bare", *["x.head", "x.decl"][: 2 * more])
    count = lambda sign: F.length("bare") - F.length(F.replace("bare", F.lit(sign), F.lit("")))
    indent = F.length("line_text") - F.length(F.ltrim("line_text"))
    return rows.withColumn("opens", count("{")).withColumn("closes", count("}")).withColumn("indent", F.when(F.trim("bare") != "", indent))


def coded(files: DataFrame) -> DataFrame:
    """The numbered lines that have code, written once. Their text is kept where it is read: where a line declares something or
    asks for a method by its name."""
    read = F.col("decl").isNotNull() | F.contains("bare", F.lit("MethodID"))
    return kept(numbered(files, more=True).where(F.trim("bare") != "").withColumn("line_text", F.when(read, F.col("line_text"))), compression="zstd")


#: Lines that a type's head may have, and how deep brackets in it may nest.
HEAD_LINES, DEEPEST = 4, 8


def unbracketed(text: Column, brackets: tuple[str, ...] = (r"<[^<>]*>", r"\([^()]*\)", r"\[[^\[\]]*\]")) -> Column:
    """A text without what is in brackets, from the inside out, so that the commas left are those of depth 0."""
    for _ in range(DEEPEST):
        for pair in brackets:
            text = F.regexp_replace(text, pair, "")
    return text


def base_names(head: Column, name: Column, language: Column) -> Column:
    """The bases that a type's head names (E16): behind the name to the first brace or semicolon, at commas of bracket depth 0, without
    access words, type arguments and namespaces. Of Python what stands in the brackets, elsewhere what follows extends and
    implements (in Dart also with and on) or the first single colon."""
    behind = F.regexp_extract(F.substr(head, F.instr(head, name) + F.length(name)), r"^([^{;]*)", 1)
    listed = let(behind, lambda b: F.when(language == "Python", unbracketed(F.regexp_extract(b, r"^\s*\((.*)\)", 1))).otherwise(let(unbracketed(b), lambda plain: _listed(plain, language))))
    listed = F.regexp_replace(F.regexp_extract(listed, r"^(.*?)(?:\bwhere\b|$)", 1), r"\b(public|protected|private|virtual|final|internal|open|abstract)\b", " ")
    items = F.filter(F.split(listed, ","), lambda item: ~item.contains("="))  # keyword arguments are no bases
    return F.filter(F.transform(items, lambda item: F.regexp_extract(item, r"([\p{L}_]\w*)\W*$", 1)), lambda word: word != "")


def _listed(plain: Column, language: Column) -> Column:
    """What of a head without brackets names bases."""
    dart = F.when(language == "Dart", F.regexp_replace(F.regexp_replace(plain, r"\bwith\b", ","), r"\bon\b", "extends")).otherwise(plain)
    named = F.concat_ws(",", F.regexp_extract(dart, r"\bextends\b(.*?)(?:\bimplements\b|$)", 1), F.regexp_extract(dart, r"\bimplements\b(.*?)(?:\bextends\b|$)", 1))
    colon = F.regexp_extract(dart, r"(?<!:):(?!:)(.*)$", 1)
    return F.when(dart.rlike(r"\b(extends|implements)\b"), named).otherwise(colon)


def scopes(spans: DataFrame) -> DataFrame:
    """Declarations with level and parent: the innermost declaration, a type or a function, that holds them."""
    found = nested(spans, F.col("end_line") > F.col("line"), "kind", "name")
    return found.select(*spans.columns, "level", F.col("within.name").alias("parent"), F.col("within.start").alias("parent_line"), F.col("within.kind").alias("parent_kind"))


def definitions(files: DataFrame, name: str, most: int = 60) -> DataFrame:
    """(path, start_line, end_line) of the first definition of a name in each file (E21): a line of code that holds the name, with a
    brace on it or the next one, to the line on which its braces are closed, at most so many lines further."""
    order = Window.partitionBy("file_id").orderBy("line")
    rows = numbered(files).select("file_id", "path", "line", "bare", "opens", "closes").withColumn("after", F.sum(F.col("opens") - F.col("closes")).over(order))
    rows = rows.withColumn("depth", F.col("after") - F.col("opens") + F.col("closes"))
    target = name.rsplit("::", 1)[-1].strip()
    braced = F.col("opens") + F.coalesce(F.lead("opens").over(order), F.lit(0)) > 0
    fits = F.contains("bare", F.lit(target)) & (braced | F.startswith(F.ltrim("bare"), F.lit("def ")))
    rows = rows.withColumn("start_line", F.min(F.when(fits, F.col("line"))).over(Window.partitionBy("file_id"))).where("line >= start_line")
    before = F.first("depth").over(order)
    opened = F.sum("opens").over(order) > 0
    rows = rows.withColumn("closes", opened & (F.col("after") <= before))
    ends = rows.groupBy("path", "start_line").agg(F.min(F.when(F.col("closes"), F.col("line"))).alias("closed"), F.max("line").alias("last"))
    return ends.select("path", "start_line", F.least(F.coalesce("closed", "last"), F.col("start_line") + most).alias("end_line"))


def declaration(bare: Column, language: Column) -> Column:
    """struct<kind, name, hint> of what a line of code declares, or null; hint is an owner that the line names."""
    any_of = F.lit(None).cast("struct<kind:string,name:string,hint:string>")
    for known, rules in DECLARATIONS.items():
        found = F.lit(None).cast("struct<kind:string,name:string,hint:string>")
        for kind, pattern in reversed(rules):
            first = F.regexp_extract(bare, pattern, 1)
            two_groups = kind == "receiver" or known == "C/C++" and kind == "function"
            name = F.regexp_extract(bare, pattern, 2) if two_groups else first
            row = F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.nullif(first, F.lit("")).alias("hint") if two_groups else F.lit(None).cast("string").alias("hint"))
            fits = (name != "") & ~name.isin([w for w in NOT_CALLS if w != "new"])  # a pattern that fits has a name
            found = F.when(fits, row).otherwise(found)
        any_of = F.when(language == known, found).otherwise(any_of)
    return F.when(~(F.contains(bare, F.lit("#")) & bare.rlike(r"^\s*#(?!\s*\[)")), any_of)


def declared(rows: DataFrame) -> DataFrame:
    """Declarations of coded lines: (file_id, path, language, n_lines, line, kind, name, hint, indent, text, head)."""
    found = rows.where("decl IS NOT NULL")
    return found.select("file_id", "path", "language", "n_lines", "line", "decl.kind", "decl.name", "decl.hint", "indent", F.col("line_text").alias("text"), "head")


def spans(decls: DataFrame, rows: DataFrame) -> DataFrame:
    """Declarations with depth (of braces, before the line), end_line and has_body.

    A block starts at the first brace before the next declaration and ends where the depth is back; in Python it ends
    before the next line that is indented no deeper. Without a block a declaration ends before the next one. Declarations and the
    lines that have braces (in Python an indentation) are dealt by file once. A window from the end of the file finds depths, the
    next brace and the next declaration; then every line that ends something is posted under the depths (indentations) that it
    ends, and a second window finds the first one behind each declaration's start.
    """
    python = F.col("language") == "Python"
    marks = rows.where((F.col("opens") > 0) | (F.col("closes") > 0) | (python & F.col("indent").isNotNull()))
    marks = marks.select("file_id", "language", "line", "opens", "closes", "indent", F.lit(False).alias("is_decl"))
    both = marks.unionByName(decls.withColumn("is_decl", F.lit(True)), allowMissingColumns=True)
    back = Window.partitionBy("file_id").orderBy(F.desc("line"), "is_decl")
    here, whole = back.rowsBetween(Window.unboundedPreceding, Window.currentRow), back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step, mine = F.coalesce(F.col("opens") - F.col("closes"), F.lit(0)), F.col("is_decl")
    both = both.withColumns({
        "depth": (F.sum(step).over(whole) - F.sum(step).over(here)).cast("int"),
        "opening": F.last(F.when(F.col("opens") > 0, F.col("line")), ignorenulls=True).over(here),
        "next": F.last(F.when(mine, F.col("line")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)),
        "levels": F.collect_set(F.when(mine & python, F.col("indent"))).over(whole),
    }).withColumn("next", F.coalesce("next", F.col("n_lines") + 1))
    opened = F.when((F.col("opening") < F.col("next")) | (F.col("opening") == F.col("line")), F.col("opening"))
    # a line on which the depth falls from above d to d or below ends what was opened at d
    top, after = F.col("depth") + F.col("opens"), F.col("depth") + F.col("opens") - F.col("closes")
    ended = F.when(python, F.filter("levels", lambda x: x >= F.col("indent"))).otherwise(F.when(after < top, F.sequence(after, top - 1)).otherwise(F.array().cast("array<int>")))
    starts = F.array(F.struct(F.when(python, F.col("indent")).when(opened.isNotNull(), F.col("depth")).alias("key"), F.when(python, F.col("line")).otherwise(F.coalesce(opened, "line")).alias("at")))
    posted = F.when(mine, starts).otherwise(F.transform(ended, lambda key: F.struct(key.alias("key"), F.col("line").alias("at"))))
    out = [c for c in decls.columns if c != "n_lines"]
    both = both.select(*out, "n_lines", "depth", "next", "is_decl", F.explode(posted).alias("e")).select(*out, "n_lines", "depth", "next", "is_decl", "e.key", "e.at")
    # an end on the line of the start counts, but for indentations
    order = Window.partitionBy("file_id", "key").orderBy(F.desc("at"), F.when(python, ~mine).otherwise(mine)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("met", F.last(F.when(~mine, F.col("at")), ignorenulls=True).over(order)).where("is_decl")
    end = F.when(python, F.coalesce(F.col("met") - 1, "n_lines")).otherwise(F.coalesce("met", F.col("next") - 1))
    return found.select(*out, "depth", (python | F.col("met").isNotNull()).alias("has_body"), F.greatest("line", end).alias("end_line"))


def symbols(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, bodies, lines). symbols: (id, file_id, path, language, name, name_lower, kind, detail, owner, start_line,
    end_line, has_body, bases); the first of a file, owner and name stays (K1). bodies: the span of every declaration, also
    of later overloads, with the id of the symbol that it counts for."""
    rows = coded(files)
    holders = F.col("kind").isin("class", "impl") & (F.col("end_line") > F.col("line"))
    owned = nested(spans(declared(rows), rows), holders, "name", "depth").where("kind <> 'impl'").where("kind <> 'member' OR depth = within.depth + 1")
    is_class = F.col("kind") == "class"
    owned = owned.withColumn("owner", F.when(~is_class, F.coalesce("hint", "within.name")))
    bases = base_names(F.col("head"), F.col("name"), F.col("language"))
    made = owned.select(
        F.xxhash64("path", F.coalesce("owner", F.lit("")), "name").alias("id"), "file_id", "path", "language", "name", F.lower("name").alias("name_lower"),
        F.when(is_class, "class").when(F.col("owner").isNotNull(), "method").otherwise("function").alias("kind"), F.when(F.col("text").rlike(r"\b(external|native)\b") & ~is_class, "native").otherwise(F.col("kind")).alias("detail"),
        "owner", F.col("line").alias("start_line"), "end_line", "has_body", F.when(is_class & F.col("head").isNotNull(), bases).otherwise(F.array().cast("array<string>")).alias("bases"),
    )
    order = Window.partitionBy("file_id", F.coalesce("owner", F.lit("")), "name").orderBy(F.col("kind") != "class", "start_line")
    made = kept(made.withColumn("_n", F.row_number().over(order)))
    return made.where("_n = 1").drop("_n"), made.select("id", "file_id", "language", "name", "kind", "owner", "start_line", "end_line"), rows


_CALL = r"(?:([A-Za-z_]\w*)(\([^()]*\))?[?! ]*(\.|->|::))?\s*\b([A-Za-z_]\w*)\s*\("
#: A line as words and signs, and wrappers whose argument is the type that counts.
_TOKEN = r"(::|->|\w+|[^\s\w])"
#: Lines of a block, in which call sites meet bodies.
BLOCK = 16
_WRAPPERS = ["shared_ptr", "unique_ptr", "weak_ptr", "sp", "RefPtr"]


def typed_names(line: Column) -> Column:
    """array<struct<rank, ident, type>> of the names a line declares with a type, by what stands beside each word: a type
    in angle brackets or bare before it (in a wrapper rank 0, else 2), a colon and a type behind it (1), or = and a type that
    makes a value (3). Types are words with a capital; reference signs do not count."""
    tokens = F.regexp_extract_all(line, F.lit(_TOKEN), 1)
    return let(F.filter(tokens, lambda t: ~t.isin("&", "*", "mut", "new")), _typed)


def _typed(plain: Column) -> Column:
    """typed_names() of the words and signs of a line."""

    def at(i: Column) -> Column:
        return F.coalesce(F.get(plain, i), F.lit(""))

    def is_type(word: Column) -> Column:
        return word.rlike(r"^\p{Lu}")

    def declared(word: Column, i: Column) -> Column:
        before, after = at(i - 1), at(i + 1)
        ends = after.isin("=", ";", ",", ")", "{", "(")
        # Vec < Item > name: the bracket that opens last before the one that closes here
        opened = i - F.array_position(F.reverse(F.slice(plain, F.lit(1), i)), "<").cast("int")
        inner = F.filter(F.slice(plain, opened + 2, F.greatest(i - opened - 2, F.lit(0))), is_type)
        wrapped = at(opened - 1).isin(_WRAPPERS)
        closed = (before == ">") & (opened < i) & (opened > 0)
        path = F.slice(plain, i + 3, F.greatest(F.size(plain) - i - 2, F.lit(0)))
        behind = F.get(F.filter(path, lambda t, k: is_type(t) & ~F.exists(F.slice(path, F.lit(1), k), lambda x: ~x.rlike(r"^(\.|[\p{Ll}_]\w*)$"))), F.lit(0))
        out = F.when(closed & wrapped & (F.size(inner) > 0), F.struct(F.lit(0).alias("rank"), word.alias("ident"), F.element_at(inner, -1).alias("type")))
        out = out.when((after == ":") & behind.isNotNull(), F.struct(F.lit(1).alias("rank"), word.alias("ident"), behind.alias("type")))
        small = word.rlike(r"^[\p{Ll}_]")
        out = out.when(ends & small & is_type(before) & (at(i - 2) != "."), F.struct(F.lit(2).alias("rank"), word.alias("ident"), before.alias("type")))
        out = out.when(ends & small & closed & ~wrapped & is_type(at(opened - 1)), F.struct(F.lit(2).alias("rank"), word.alias("ident"), at(opened - 1).alias("type")))
        made = (after == "=") & is_type(at(i + 2)) & at(i + 3).isin("(", "<", "{")
        return out.when(made, F.struct(F.lit(3).alias("rank"), word.alias("ident"), at(i + 2).alias("type")))

    return F.array_compact(F.transform(plain, lambda word, i: F.when(word.rlike(r"^[\p{L}_]\w*$"), declared(word, i))))


def declared_types(rows: DataFrame) -> DataFrame:
    """(file_id, ident, type): what the file declares a name to be; the surest form and the first line decide."""
    likely = rows.where(F.col("bare").rlike(r"\p{Lu}"))
    found = likely.select("file_id", "line", F.explode(typed_names(F.col("bare"))).alias("d")).select("file_id", "line", "d.*")
    return found.groupBy("file_id", "ident").agg(F.min_by("type", F.struct("rank", "line", "type")).alias("type"))


#: Bytes up to which counted keys are broadcast.
FEW_BYTES = 16 << 20


def broadcast_few(keys: DataFrame, width: int) -> DataFrame:
    """keys marked for broadcast, if their counted bytes are few."""
    return F.broadcast(keys) if width <= FEW_BYTES else keys


def call_sites(bodies: DataFrame, rows: DataFrame) -> DataFrame:
    """(symbol_id, file_id, language, caller_owner, callee, dotted, recv_type), each once.

    Constructs, C library functions and names behind std:: are no calls. A receiver is this or self, a name with a declared
    type, a type itself, or the result of a call (ret:name). Native code that asks for a method of the virtual machine by its
    name calls it (receiver @jvm), and a component's tag in a script is a call of it.
    """
    code = rows.where(F.contains("bare", F.lit("(")) & ~F.col("bare").rlike(r"^\s*+#")).select("file_id", "line", F.regexp_extract_all("bare", F.lit(_CALL), 1).alias("r"), F.regexp_extract_all("bare", F.lit(_CALL), 2).alias("p"), F.regexp_extract_all("bare", F.lit(_CALL), 3).alias("d"), F.regexp_extract_all("bare", F.lit(_CALL), 4).alias("c"))
    code = code.select("file_id", "line", F.arrays_zip("r", "p", "d", "c").alias("met"))
    # A chained call hides in the receiver's brackets: a().b() is a call of a as well.
    hidden = F.transform(F.filter("met", lambda x: x["p"] != ""), lambda x: F.struct(F.lit("").alias("r"), F.lit("").alias("p"), F.lit("").alias("d"), x["r"].alias("c")))
    sites = code.select("file_id", "line", F.explode(F.concat("met", hidden)).alias("x")).select("file_id", "line", "x.r", "x.p", "x.d", "x.c")
    named = lambda some, text, pattern, mark: some.select("file_id", "line", F.lit(mark).alias("r"), F.lit("").alias("p"), F.lit("").alias("d"), F.explode(F.regexp_extract_all(text, F.lit(pattern), 1)).alias("c"))
    callbacks = named(rows.where("language = 'C/C++' AND contains(bare, 'MethodID')"), "line_text", r'Get(?:Static)?MethodID\s*\([^"]*"(\w+)"', "@jvm")
    tags = named(rows.where(F.lower("path").rlike(r"\.[jt]sx$")), "bare", r"<(\p{Lu}\w*)(?=[\s/>])", "")
    sites = sites.unionByName(callbacks).unionByName(tags).where(~F.col("c").isin(NOT_CALLS) & ~((F.col("r") == "std") & (F.col("d") == "::")))
    sites = kept(sites, compression="zstd")
    # bodies meet the sites of the same few lines, so a long body costs a row for each block of lines and not one for each line
    block = lambda line: F.floor(line / F.lit(BLOCK)).cast("int")
    methods = bodies.where("kind <> 'class'").withColumn("block", F.explode(F.sequence(block(F.col("start_line")), block(F.col("end_line")))))
    in_body = sites.withColumn("block", block(F.col("line"))).join(methods, ["file_id", "block"]).where("line BETWEEN start_line AND end_line").where(~((F.col("language") == "C/C++") & (F.col("d") == "") & F.col("c").isin(LIBC)))
    # types are looked for in files that call something of a named receiver
    asked = sites.where("d <> '' AND p = ''").select("file_id").distinct()
    types = declared_types(rows.join(broadcast_few(asked, asked.count() * 16), "file_id", "left_semi"))
    typed = in_body.join(types.withColumnRenamed("ident", "r"), ["file_id", "r"], "left")
    recv = (
        F.when(F.col("r") == "@jvm", "@jvm").when(F.col("d") == "", "").when(F.col("p") != "", F.concat(F.lit("ret:"), "r")).when(F.col("r").isin("this", "self", "Self"), F.coalesce("owner", F.lit("")))
        .when(F.col("r") == "super", "").when(F.col("type").isNotNull(), F.col("type")).when(F.col("r").rlike("^[A-Z]"), F.col("r")).otherwise("")
    )
    out = typed.select(F.col("id").alias("symbol_id"), "file_id", "language", F.col("owner").alias("caller_owner"), F.col("c").alias("callee"), (F.col("d") != "").alias("dotted"), recv.alias("recv_type"), "name")
    own = (F.col("callee") == F.col("name")) & ((F.col("recv_type") == "") | F.coalesce(F.col("recv_type") == F.col("caller_owner"), F.lit(False)))
    return out.where(~own).drop("name").distinct()


def resolve(sites: DataFrame, syms: DataFrame) -> DataFrame:
    """CALLS edges (from_id, to_id, kind) of call sites, an edge for each site.

    The rule is a fall through tiers: the receiver's type, the caller's own class for plain calls, the caller's file, a
    name that is unique in the language family and not a common method. A self link is dropped after its tier was chosen.
    Every tier looks up one candidate in a table that is grouped by its key beforehand, so a name with many candidates
    and many calls costs their sum and not their product. A dotted call asks for its receiver's type and a plain one for its
    caller's class, so both ask the same tables.
    """
    cands = syms.select("id", "name", "owner", "file_id", family(F.col("language")).alias("family"), "has_body", "path", "start_line")
    is_ctor = F.coalesce(F.col("owner") == F.col("name"), F.lit(False))
    key = ["name", "family", "owner"]
    # declarations give way to a definition of the same owner: few have none, so only those look for one
    bare = cands.where("NOT has_body")
    bodies = cands.where("has_body").select(*key).distinct()
    same = (F.col("l.name") == F.col("r.name")) & (F.col("l.family") == F.col("r.family")) & F.col("l.owner").eqNullSafe(F.col("r.owner"))
    usable = cands.where("has_body").unionByName(bare.alias("l").join(bodies.alias("r"), same, "left_anti"))
    # and all candidates of a name to its constructor, if it has one
    ctors = usable.where(is_ctor).groupBy("name", "family").agg(F.count("*").alias("_c")).where("_c = 1").select("name", "family", F.lit(True).alias("_one"))
    usable = kept(usable.join(ctors, ["name", "family"], "left").where(F.col("_one").isNull() | is_ctor).drop("_one"))
    first = F.min(F.struct("path", "start_line", "id")).getField("id")

    def table(name: str, *keys: str) -> DataFrame:
        rows = usable.where("owner IS NOT NULL") if "owner" in keys else usable
        return rows.groupBy(*keys).agg(first.alias(name)).withColumnRenamed("name", "callee")

    plain = ~F.col("dotted")
    asked = F.when(F.col("recv_type") != "", F.col("recv_type")).when(plain, F.col("caller_owner"))
    keyed = sites.select("symbol_id", "file_id", "callee", "dotted", "recv_type", family(F.col("language")).alias("family"), asked.alias("owner"))
    owned = keyed.where("owner IS NOT NULL AND recv_type <> '@jvm'")
    owned = owned.join(table("here", "name", "family", "owner", "file_id"), ["callee", "family", "owner", "file_id"], "left").join(table("there", "name", "family", "owner"), ["callee", "family", "owner"], "left")
    rest = keyed.where("owner IS NULL AND recv_type <> '@jvm'").withColumns({"here": F.lit(None).cast("long"), "there": F.lit(None).cast("long")})
    rows = owned.unionByName(rest).withColumn("found", F.coalesce("here", "there")).drop("here", "there", "owner")
    unique = usable.groupBy("name", "family").agg(F.min("id").alias("any"), F.count("*").alias("n")).where("n = 1").select(F.col("name").alias("callee"), "family", "any")
    rows = rows.join(table("same_file", "name", "family", "file_id"), ["callee", "family", "file_id"], "left").join(unique, ["callee", "family"], "left")
    anywhere = F.when(plain | ~F.col("callee").isin(COMMON_METHODS), F.col("any"))
    in_file = F.when(plain | (F.col("recv_type") == ""), F.col("same_file"))
    linked = rows.select("symbol_id", F.coalesce("found", in_file, anywhere).alias("to_id"))
    jvm = cands.where("family = 'JVM'").groupBy(F.col("name").alias("callee")).agg(F.min("id").alias("to_id"), F.count("*").alias("n")).where("n = 1")
    linked = linked.unionByName(sites.where("recv_type = '@jvm'").join(jvm, "callee").select("symbol_id", "to_id"))
    return linked.where("to_id IS NOT NULL AND to_id <> symbol_id").select(F.col("symbol_id").alias("from_id"), "to_id", F.lit("CALLS").alias("kind"))


def effective_receivers(sites: DataFrame, returns: DataFrame) -> DataFrame:
    """Receivers ret:name as the one type that all methods of that name return, else unknown (J10). returns: (name, type)."""
    from .lookup import unanimous

    asks = F.startswith("recv_type", F.lit("ret:"))
    known = unanimous(returns, "name", "type").select(F.concat(F.lit("ret:"), "name").alias("recv_type"), F.col("type").alias("_t"))
    rows = sites.where(asks).join(known, "recv_type", "left").withColumn("recv_type", F.coalesce("_t", F.lit(""))).drop("_t")
    return sites.where(~asks).unionByName(rows)


def returned_types(rows: DataFrame, bodies: DataFrame) -> DataFrame:
    """(name, type) of methods whose declaration names a type: before the name, or behind an arrow or colon."""
    from ..functions.text import simplify_type

    head = rows.where("decl IS NOT NULL").select("file_id", F.col("line").alias("start_line"), F.col("line_text").alias("text"))
    heads = bodies.where("kind <> 'class'").join(head, ["file_id", "start_line"])
    behind = F.regexp_extract("text", r"\)\s*(?:->|:)\s*([^={]+)", 1)
    before = F.regexp_extract("text", r"^\s*(.*?)[\w:~]+\s*\(", 1)
    return heads.select("name", simplify_type(F.when(behind != "", behind).otherwise(before)).alias("type"))


def dispatch_edges(syms: DataFrame) -> DataFrame:
    """DISPATCH edges from base methods to their overrides."""
    from .graph import override_links

    bases = syms.where("kind = 'class'").select(F.col("name").alias("class"), F.explode("bases").alias("base"))
    methods = syms.where("owner IS NOT NULL").select("id", "owner", "name", "has_body")
    return override_links(bases, methods).withColumn("kind", F.lit("DISPATCH"))


def bridge_edges(syms: DataFrame) -> DataFrame:
    """CALLS edges from native methods to the functions that carry them out."""
    from .lookup import suffix_join

    natives = syms.where("detail = 'native'").select("id", "owner", "name")
    functions = syms.where(F.startswith("name", F.lit("Java_"))).select("id", "name", "has_body")
    return suffix_join(natives, functions).select(F.col("native_id").alias("from_id"), F.col("function_id").alias("to_id"), F.lit("CALLS").alias("kind"))


def linked(sites: DataFrame, syms: DataFrame) -> DataFrame:
    """All edges between symbols: calls, bridges between languages, and dispatch to overrides."""
    return resolve(sites, syms).unionByName(bridge_edges(syms)).unionByName(dispatch_edges(syms)).distinct()


def with_definitions(index: dict[str, DataFrame]) -> DataFrame:
    """(from_name, to_name, kind): the whole graph by readable names, with DEFINES edges of files and classes (G-9)."""
    from .graph import full_graph

    named = index["symbols"].withColumn("node", F.concat_ws(":", "path", F.concat(F.coalesce(F.concat("owner", F.lit(".")), F.lit("")), "name")))
    a = named.select(F.col("id").alias("from_id"), F.col("node").alias("from_name"))
    b = named.select(F.col("id").alias("to_id"), F.col("node").alias("to_name"))
    edges = index["edges"].join(a, "from_id").join(b, "to_id").select(F.col("from_name").alias("from_id"), F.col("to_name").alias("to_id"), "kind")
    return full_graph(edges, named.select("node", "path", "name", "owner", "kind")).withColumnsRenamed({"from_id": "from_name", "to_id": "to_name"})


def parsed(files: DataFrame) -> dict[str, DataFrame]:
    """What files (path, content, mtime, size) have by themselves, as tables: files, symbols, call_sites."""
    syms, bodies, rows = symbols(files)
    sites = kept(call_sites(bodies, rows), compression="zstd")
    asked = sites.where("recv_type LIKE 'ret:%'").select(F.substr("recv_type", F.lit(5)).alias("name")).distinct()
    sites = kept(effective_receivers(sites, returned_types(rows, bodies.join(asked, "name", "left_semi"))), compression="zstd")
    known = files.select(file_id(F.col("path")).alias("id"), "path", language_of(F.col("path")).alias("language"), "mtime", "size").where("language IS NOT NULL")
    return {"files": known, "symbols": syms, "call_sites": sites}


class Index(dict):
    """Tables by name; edges are linked when they are first asked for, so an index that is only refreshed is not linked twice."""

    def __missing__(self, name: str) -> DataFrame:
        if name != "edges":
            raise KeyError(name)
        self[name] = linked(self["call_sites"], self["symbols"])
        return self[name]


def build(files: DataFrame) -> dict[str, DataFrame]:
    """The index of files (path, content, mtime, size) as tables: files, symbols, call_sites, edges."""
    return Index(parsed(files))


def refresh(index: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    """The index after a change of files (M10): only files whose mtime or size changed are parsed; calls are resolved again
    if their file changed or if they name something that a changed file declares or declared, and all if a quarter of the
    files changed (G-10). What changed is written once, and joins with it do not shuffle the texts of all files, as long as it is
    small."""
    from .trees import changes

    known = files.where(language_of(F.col("path")).isNotNull())
    diff = kept(changes(index["files"], known).where("change <> 'unchanged'").withColumn("file_id", file_id(F.col("path"))))
    n_changed, width = diff.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("path") + 16), F.lit(0))).first()
    few = lambda keys: broadcast_few(keys, width)
    touched, gone = diff.select("path"), diff.select("file_id")
    keep = lambda df: df.join(few(touched), "path", "left_anti")
    new = parsed(known.join(few(diff.where("change IN ('added', 'updated')").select("path")), "path", "left_semi"))
    all_files = keep(index["files"]).unionByName(new["files"])
    syms = keep(index["symbols"]).unionByName(new["symbols"])
    sites = index["call_sites"].join(few(gone), "file_id", "left_anti").unionByName(new["call_sites"])
    whole = Index(files=all_files, symbols=syms, call_sites=sites)
    if n_changed * 4 < known.select("path").count():
        names = index["symbols"].join(few(touched), "path", "left_semi").select("name").union(new["symbols"].select("name")).distinct()
        affected = sites.join(names.withColumnRenamed("name", "callee"), "callee", "left_semi").select("symbol_id").union(new["call_sites"].select("symbol_id")).union(index["call_sites"].join(few(gone), "file_id", "left_semi").select("symbol_id")).distinct()
        others = bridge_edges(syms).unionByName(dispatch_edges(syms))  # cheap, and a change reaches far
        old = index["edges"].where("kind = 'CALLS'").join(affected.withColumnRenamed("symbol_id", "from_id"), "from_id", "left_anti")
        whole["edges"] = old.unionByName(resolve(sites.join(affected, "symbol_id", "left_semi"), syms)).unionByName(others).distinct()
    return whole


SCHEMA_VERSION = "1"
TABLES = ("files", "symbols", "call_sites", "edges")


def write_index(index: dict[str, DataFrame], folder: str) -> int:
    """The tables as a new version (K10): a reader sees the old tables or the new, whole. If another writer made a version
    meanwhile, Conflict."""
    spark: SparkSession = index["files"].sparkSession
    base, _ = versions.latest(spark, folder)
    tables = {name: [versions.add_table(index[name], folder, name)] for name in TABLES}
    return versions.commit(spark, folder, base, tables | {"schema": [SCHEMA_VERSION]})


def read_index(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    """The tables of the greatest version, or None if there is none or their schema is another one: the index is a cache and
    is built again."""
    _, content = versions.latest(spark, folder)
    if content.get("schema") != [SCHEMA_VERSION]:
        return None
    return {name: spark.read.parquet(*content[name]) for name in TABLES}
