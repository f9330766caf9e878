"""Code index queries over source files that are made of the documents: a file per document, a function per line.

Every function holds its line's text in a comment, and calls in comments and literals that must not count. What the index
has to find follows from the number of lines, so SQL over the documents states it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code_index as c
from ..operators.lexer import with_code
from ..sources.tables import LINES_SQL, load
from .registry import query


def _lit(template: str, doc, i=None, text=None):
    """A column of a template: $d is the document, $i the line's number, $j the next one, $t the line's text without signs of comments,
    quotes and templates."""
    values = {"$d": doc.cast("string")}
    if i is not None:
        values |= {"$i": (i + 1).cast("string"), "$j": (i + 2).cast("string"), "$t": F.regexp_replace(text, "[\"'`\\\\/*#$\r]", "")}
    out = F.lit(template)
    for sign, value in values.items():
        out = F.replace(out, F.lit(sign), value)
    return out


def made(spark, sf_dir, path, head, each, foot, last=None):
    """Files (doc_id, path, content, mtime, size): head, each for every line of the document, the last line's one if it differs, foot."""
    doc = F.col("doc_id")
    parts = F.coalesce(F.split("text", "\n"), F.array().cast("array<string>"))
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    docs = load(spark, sf_dir, "documents").select("doc_id", parts.alias("parts"))
    pick = lambda x, *more: x(doc, *more) if callable(x) else _lit(x, doc, *more)
    final = each if last is None else last
    body = F.transform("parts", lambda t, i: F.when(i == F.size("parts") - 1, pick(final, i, t)).otherwise(pick(each, i, t)))
    content = F.concat(pick(head), F.array_join(body, ""), pick(foot))
    rows = docs.select("doc_id", pick(path).alias("path"), content.alias("content"))
    return rows.select("doc_id", "path", "content", F.lit(1).cast("long").alias("mtime"), F.length("content").cast("long").alias("size"))


#: A function of six lines. The text and the calls of f1 around the real call are in comments and literals over several lines.
HEAD = "class C$d : Base$d<K, V<W, X>>(1, 2), pkg.I$d {\n"
EACH = '    fun f$i(a: Int) {\n        // f1(a) { $t\n        val s = """{ f1(\n        } "f1(" """; /* { f1(\n        */ f$j(a)\n    }\n'
LAST = EACH.replace("f$j(a)", "done(a)")


def kotlin(spark, sf_dir):
    return made(spark, sf_dir, "k/d$d.kt", HEAD, EACH, "}\n", LAST)


def readable_edges(index):
    s = index["symbols"].select("id", F.concat(F.coalesce(F.concat("owner", F.lit(".")), F.lit("")), "name").alias("q"), "path")
    a = s.select(F.col("id").alias("from_id"), F.concat_ws(":", "path", "q").alias("from_name"))
    b = s.select(F.col("id").alias("to_id"), F.concat_ws(":", "path", "q").alias("to_name"))
    return index["edges"].join(a, "from_id").join(b, "to_id").select("from_name", "to_name", "kind")


#: n lines per document, and f a row per line.
_N = (
    LINES_SQL
    + """, n AS (SELECT d.doc_id, count(l.line) AS n FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id GROUP BY d.doc_id),
    f AS (SELECT doc_id, n, unnest(range(1, n + 1)) AS i FROM n)
"""
)
_PATH = "'k/d' || doc_id || '.kt'"


@query(
    _N
    + f"""SELECT {_PATH} AS path, 'C' || doc_id AS name, NULL AS owner, 'class' AS kind, 1 AS start_line, CAST(2 + 6 * n AS INTEGER) AS end_line FROM n
    UNION ALL SELECT {_PATH}, 'f' || i, 'C' || doc_id, 'method', CAST(6 * i - 4 AS INTEGER), CAST(6 * i + 1 AS INTEGER) FROM f"""
)
def parse_source_snippets(spark, sf_dir):
    """Classes and methods of a file per document."""
    return c.symbols(kotlin(spark, sf_dir))[0].select("path", "name", "owner", "kind", "start_line", "end_line")


@query(_N + f"SELECT {_PATH} || ':C' || doc_id || '.f' || i AS from_name, {_PATH} || ':C' || doc_id || '.f' || (i + 1) AS to_name, 'CALLS' AS kind FROM f WHERE i < n")
def resolve_fixture(spark, sf_dir):
    """Calls of the next method of the own class; every document has methods of these names."""
    return readable_edges(c.build(kotlin(spark, sf_dir))).where("kind = 'CALLS'")


@query(
    LINES_SQL
    + f"""SELECT {_PATH} AS path, line * 6 - 4 + step AS line, code FROM (SELECT doc_id, line, line_text, unnest(range(0, 6)) AS step FROM lines) l
    JOIN (VALUES (0, NULL), (1, '         '), (2, '        val s = ""'), (3, ';  '), (4, NULL), (5, '    }}')) v(k, text) ON k = step
    CROSS JOIN LATERAL (SELECT coalesce(text, CASE WHEN step = 0 THEN '    fun f' || line || '(a: Int) {{' ELSE ' ' || CASE WHEN line = (SELECT count(*) FROM lines m WHERE m.doc_id = l.doc_id) THEN 'done(a)' ELSE 'f' || (line + 1) || '(a)' END END) AS code)"""
)
def code_lines(spark, sf_dir):
    """The lines of the methods without comments and literals."""
    rows = c.numbered(kotlin(spark, sf_dir))
    return rows.where("NOT bare RLIKE '^(class|[}]$)'").select("path", "line", F.col("bare").alias("code"))


@query(_N + f"SELECT {_PATH} AS path, CAST(2 AS INTEGER) AS start_line, CAST(7 AS INTEGER) AS end_line FROM n WHERE n > 0")
def definitions_by_braces(spark, sf_dir):
    """The first definition of f1 in each file."""
    return c.definitions(kotlin(spark, sf_dir), "x::f1(")


@query("SELECT 'C' || doc_id AS class, 'Base' || doc_id || ' I' || doc_id AS bases FROM documents")
def base_lists(spark, sf_dir):
    """Bases with type arguments that hold commas."""
    found = c.symbols(kotlin(spark, sf_dir))[0].where("kind = 'class'")
    return found.select(F.col("name").alias("class"), F.array_join("bases", " ").alias("bases"))


#: A class in a class, and a function in every method.
NESTED = "    fun f$i(a: Int) {\n        fun g$i() {\n            f$j(a) // }\n        }\n    }\n"


@query(
    _N
    + """SELECT doc_id, 'C' || doc_id AS name, 0 AS level, NULL AS parent, 'class' AS kind FROM n UNION ALL SELECT doc_id, 'In' || doc_id, 1, 'C' || doc_id, 'class' FROM n
    UNION ALL SELECT doc_id, 'f' || i, 2, 'In' || doc_id, 'function' FROM f UNION ALL SELECT doc_id, 'g' || i, 3, 'f' || i, 'function' FROM f
    UNION ALL SELECT doc_id, 'z' || doc_id, 1, 'C' || doc_id, 'function' FROM n"""
)
def scope_tree(spark, sf_dir):
    """The innermost declaration that holds each declaration."""
    source = made(spark, sf_dir, "k/$d.kt", "class C$d {\n  class In$d {\n", NESTED, "  }\n  fun z$d() {\n  }\n}\n")
    rows = c.coded(source)
    found = c.scopes(c.spans(c.declared(rows), rows))
    return found.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id"), "name", "level", "parent", "kind")


#: By language: extension, head, function, foot; then lines of the head, of a function, its last line, and lines behind the last one.
LANGUAGES = [
    ("java", "public class C$d {\n", "    public void f$i(int a) {\n        f$j(a); // f1(a) { $t\n    }\n", "}\n", 1, 3, 2, 1),
    ("py", "class C$d:\n", '    def f$i(self):\n        self.f$j("# f1(")  # f1( $t\n', "", 1, 2, 1, 0),
    ("ts", "export class C$d {\n", "  f$i(a: number) {\n    this.f$j(`}\n }`); // $t\n  }\n", "}\n", 1, 4, 3, 1),
    ("cs", "public class C$d\n{\n", '    public void f$i(int a)\n    {\n        f$j(@"}"""); /* $t\n        } */\n    }\n', "}\n", 2, 5, 4, 1),
    ("dart", "class C$d {\n", "  void f$i(int a) {\n    f$j('''}\n''');\n  }\n", "}\n", 1, 4, 3, 1),
    ("swift", "class C$d {\n", "    func f$i(a: Int) {\n        f$j(a) // { $t\n    }\n", "}\n", 1, 3, 2, 1),
    ("rs", "pub struct C$d { a: u32 }\nimpl C$d {\n", '    fn f$i(&self) {\n        self.f$j(r##"}"#"##); // $t\n    }\n', "}\n", 2, 3, 2, -1),
    ("go", "type C$d struct {\n}\n", "func (c *C$d) f$i(a int) {\n\tc.f$j(`}\n`) // $t\n}\n", "", 2, 4, 3, -1),
]
_SHAPES = ", ".join(f"({k}, '{x[0]}', {x[4]}, {x[5]}, {x[6]}, {x[7]})" for k, x in enumerate(LANGUAGES))


@query(
    _N
    + f""", s AS (SELECT * FROM (VALUES {_SHAPES}) v(k, ext, head, size, last, foot))
    SELECT 'm/d' || doc_id || '.' || ext AS path, 'C' || doc_id AS name, NULL AS owner, 'class' AS kind, 1 AS start_line,
      CAST(CASE WHEN ext = 'rs' THEN 1 WHEN ext = 'go' THEN 2 ELSE head + size * n + foot END AS INTEGER) AS end_line FROM n JOIN s ON k = doc_id % {len(LANGUAGES)}
    UNION ALL SELECT 'm/d' || doc_id || '.' || ext, 'f' || i, 'C' || doc_id, 'method', CAST(head + size * (i - 1) + 1 AS INTEGER), CAST(head + size * (i - 1) + 1 + last AS INTEGER)
    FROM f JOIN s ON k = doc_id % {len(LANGUAGES)}"""
)
def parse_more_languages(spark, sf_dir):
    """The same file in eight languages, with their own comments and strings that hold braces."""
    found = None
    for k, (ext, head, each, foot, *_) in enumerate(LANGUAGES):
        files = made(spark, sf_dir, f"m/d$d.{ext}", head, each, foot).where(F.col("doc_id") % len(LANGUAGES) == k)
        found = files if found is None else found.unionByName(files)
    return c.symbols(found)[0].select("path", "name", "owner", "kind", "start_line", "end_line")


@query(
    _N
    + f"""SELECT 'k/d' || (f.doc_id - 1) || '.kt:C' || (f.doc_id - 1) || '.f' || i AS from_name, 'k/d' || f.doc_id || '.kt:C' || f.doc_id || '.f' || i AS to_name, 'DISPATCH' AS kind
    FROM f JOIN n b ON b.doc_id = f.doc_id - 1 WHERE f.doc_id % 2 = 1 AND i <= b.n"""
)
def dispatch_fixture(spark, sf_dir):
    """Every second document's class extends the one before; methods of one name are overrides."""
    head = lambda doc: F.when(doc % 2 == 1, F.concat(F.lit("class C"), doc, F.lit(" : C"), doc - 1, F.lit("() {\n"))).otherwise(F.concat(F.lit("open class C"), doc, F.lit(" {\n")))
    syms = c.symbols(made(spark, sf_dir, "k/d$d.kt", head, EACH, "}\n"))[0]
    return readable_edges({"symbols": syms, "edges": c.dispatch_edges(syms)})


@query(_N + "SELECT 0 AS only_full, 0 AS only_incremental, CAST(coalesce(sum(greatest(n - 1, 0)), 0) AS INTEGER) AS edges FROM n WHERE doc_id % 7 <> 3")
def incremental_equals_full(spark, sf_dir):
    """An index refreshed after every tenth file changed and every seventh went, against one built anew: edges that one has."""
    source = kotlin(spark, sf_dir)
    changed = F.col("doc_id") % 10 == 0
    after = source.where("doc_id % 7 <> 3").withColumn("content", F.when(changed, F.regexp_replace("content", r"\bf(\d+)\(a", "h$1(a")).otherwise(F.col("content")))
    after = after.withColumn("mtime", F.when(changed, 2).otherwise(1).cast("long"))
    calls = lambda index, n: index["edges"].where("kind = 'CALLS'").select("from_id", "to_id", F.lit(n).alias("side"))  # noqa: E731  ids are of path, owner and name
    inc, full = c.refresh(c.build(source), after), c.build(after)
    both = calls(full, 1).union(calls(inc, 2)).groupBy("from_id", "to_id").agg(F.sum("side").alias("s"))
    count = lambda k: F.count_if(F.col("s") == k).cast("int")
    return both.agg(count(1).alias("only_full"), count(2).alias("only_incremental"), count(3).alias("edges"))


@query(
    """SELECT 'jni/d' || doc_id || '.cpp:notify' || doc_id AS from_name, 'k/d' || doc_id || '.kt:C' || doc_id || '.only' || doc_id AS to_name, 'CALLS' AS kind FROM documents
    UNION ALL SELECT 'web/d' || doc_id || '.tsx:App' || doc_id, 'web/d' || doc_id || '.tsx:Panel' || doc_id, 'CALLS' FROM documents"""
)
def callback_fixture(spark, sf_dir):
    """Native code that calls into the virtual machine by a method's name, and a component that uses another."""
    parts = [
        ("k/d$d.kt", "class C$d {\n    fun only$d() {\n    }\n}\n"),
        ("jni/d$d.cpp", 'void notify$d(int env) {\n    jmethodID m = env->GetMethodID(cls, "only$d", "()V"); // notify$d(1)\n}\n'),
        ("web/d$d.tsx", "export function App$d() {\n  return <Panel$d size={1} />;\n}\nexport function Panel$d(p: any) {\n  return null; /* <App$d /> */\n}\n"),
    ]
    source = None
    for path, text in parts:
        files = made(spark, sf_dir, path, text, lambda doc, i, t: F.lit(""), "")
        source = files if source is None else source.unionByName(files)
    return readable_edges(c.build(source)).where("kind = 'CALLS'")


@query(
    """WITH d AS (SELECT doc_id, 'k/d' || doc_id || '.kt' AS k, 'jni/d' || doc_id || '.cpp' AS j, 'k/d' || doc_id || '.kt:C' || doc_id AS cls, 'jni/d' || doc_id || '.cpp:Java_app_C' || doc_id || '_open' || doc_id AS fn FROM documents)
    SELECT cls || '.open' || doc_id AS from_name, fn AS to_name, 'CALLS' AS kind FROM d UNION ALL SELECT 'file:' || k, cls, 'DEFINES' FROM d UNION ALL SELECT cls, cls || '.open' || doc_id, 'DEFINES' FROM d
    UNION ALL SELECT cls, cls || '.play', 'DEFINES' FROM d UNION ALL SELECT 'file:' || j, fn, 'DEFINES' FROM d
    UNION ALL SELECT 'k/d' || (doc_id - 1) || '.kt:C' || (doc_id - 1) || '.play', cls || '.play', 'DISPATCH' FROM d WHERE doc_id % 2 = 1 AND doc_id - 1 IN (SELECT doc_id FROM documents)"""
)
def full_graph_fixture(spark, sf_dir):
    """Edges of all kinds: bridges to native code, dispatch to overrides, and what files and classes define."""
    head = lambda doc: F.concat(F.lit("open class C"), doc, F.when(doc % 2 == 1, F.concat(F.lit(" : C"), doc - 1, F.lit("()"))).otherwise(""), F.lit(" {\n"))
    none = lambda doc, i, t: F.lit("")
    source = made(spark, sf_dir, "k/d$d.kt", head, none, "    open fun play() {\n    }\n    external fun open$d(): Int\n}\n")
    return c.with_definitions(c.build(source.unionByName(made(spark, sf_dir, "jni/d$d.cpp", "int Java_app_C$d_open$d(int env) {\n    return 0;\n}\n", none, ""))))


@query(_N + """SELECT 'k/d' || doc_id || '.kt' AS path, 'f' || i AS name, 'fun f' || i || '( a: Int, b' || i || ': Map<K, V> )' AS signature, 'a: Int, b' || i || ': Map<K, V>' AS params FROM f""")
def multi_line_signatures(spark, sf_dir):
    """Signatures over four lines, as one."""
    from ..operators import signatures as g

    source = made(spark, sf_dir, "k/d$d.kt", "class C$d {\n", "    fun f$i(\n        a: Int,\n        b$i: Map<K, V>\n    ) {\n        // $t\n    }\n", "}\n")
    found = g.gathered(c.symbols(source)[0].where("kind = 'method'"), source.select("path", "content"))
    return found.select("path", "name", "signature", g.parameters(F.col("signature")).alias("params"))


@query("SELECT CAST(count(*) AS BIGINT) AS files, CAST(0 AS BIGINT) AS with_text FROM documents")
def texts_only_in_comments(spark, sf_dir):
    """Documents' texts stand in comments, so none of them is left in the code of its file."""
    source = with_code(kotlin(spark, sf_dir).withColumn("language", F.lit("Kotlin")))
    words = F.regexp_extract_all("content", F.lit(r"// f1\(a\) \{ ([^\n]*)"), F.lit(1))
    left = F.exists(words, lambda w: (F.length(w) > 12) & F.contains(F.col("code"), w))
    return source.agg(F.count("*").alias("files"), F.count_if(left).alias("with_text"))
