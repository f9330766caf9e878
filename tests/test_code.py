"""Lexer, scopes, bases and definitions on sources of our own."""

import pytest
from pyspark.sql import functions as F
from snippets import CALLBACKS, CALLS, MORE, MORE_SPANS, SNIPPETS, SPANS, files

from textloom.operators import code_index as c
from textloom.operators import lexer

CASES = [
    ("Kotlin", 'a /* { " \n } */ b "x /* \\" y" c // "z\nd """raw " { \n// no """ e \'{\' f', 'a  \n b "" c  \nd ""\n e \'\' f'),
    ("Java", "s = \"\";t=\"\\\\\"; u = '\\n'; v='\\u0041'; /* unclosed {\n", 's = "";t=""; u = \'\'; v=\'\';  \n'),
    ("C/C++", 'R"ab(x)" )ab" y L"q" \'{\' 1\'000 R"(\n{ )" z', '"" y L"" \'\' 1\'000 ""\n z'),
    ("Rust", 'r#"a"b"# x r"\\" y \'a str b\'{\' "q\\\n"', '"" x "" y \'a str b\'\' ""\n'),
    ("Python", "x = \"\"\"a # ' \n {\"\"\" + 'b\"#' # c \"d\n'''e\n\"''' f\"\"", "x = \"\"\n + ''  \n''\n f\"\""),
    ("TypeScript", "`a ${b} \\` \" \n{` c 'd' \"e\"", "``\n c '' \"\""),
    ("Go", "`a \\` b \"c\\\"d\" '\\'' e", "`` b \"\" '' e"),
    ("C#", '@"a ""b"" \\" c "d" @"" e $@"x" \'"\' f', '"" c "" "" e "" \'\' f'),
    ("Dart", "'''x\n\"''' a 'b' \"c\"", "''\n a '' \"\""),
    ("Swift", '"a" b "it\'s" c\'d', '"" b "" c\'d'),
    ("Zig", '"keep" // this', '"keep" // this'),
    ("Java", None, None),
    ("Java", "", ""),
    ("Java", '"' + "a\\n" * 60_000 + '" {', '"" {'),
    ("Go", "/*" + "x { \n" * 30_000 + "*/ b", " " + "\n" * 30_000 + " b"),
]


def test_code_without_comments_and_literals(spark):
    df = spark.createDataFrame([(i, lang, text) for i, (lang, text, _) in enumerate(CASES)], "i int, language string, content string")
    found = {r["i"]: r["code"] for r in lexer.with_code(df).collect()}
    for i, (lang, text, code) in enumerate(CASES):
        assert found[i] == code, (lang, text and text[:60])


BASES = [
    ("Kotlin", "class A<T : X>(val a: Map<K, V> = f(1)) : Base<K, V>(a, b), pkg.One, Two {", ["Base", "One", "Two"]),
    ("Java", "public class A extends B<C, D> implements E, f.G<H<I, J>> {", ["B", "E", "G"]),
    ("C/C++", "class A final : public ns::B<int, C>, private virtual D { // : x", ["B", "D"]),
    ("C#", "class A<T> : B<T>, IC where T : D", ["B", "IC"]),
    ("Dart", "class A extends B with M<X, Y>, N implements O {", ["B", "M", "N", "O"]),
    ("Python", "class A(m.B, C[D, E], metaclass=F):", ["B", "C"]),
    ("TypeScript", "class A {", []),
    ("Swift", "class A", []),
]


@pytest.mark.parametrize("language, head, bases", BASES)
def test_bases(spark, language, head, bases):
    df = spark.createDataFrame([(head, "A", language)], "head string, name string, language string")
    assert df.select(c.base_names(F.col("head"), F.col("name"), F.col("language")).alias("b")).first()["b"] == bases


def brute_enclosing(points, intervals):
    found = {}
    for f, line in points:
        holds = [(s, -e, n) for g, s, e, n in intervals if g == f and s < line <= e]
        found[f, line] = (max(holds)[2] if holds else None, len(holds))
    return found


def test_innermost_intervals(spark):
    import random

    random.seed(3)
    intervals = []

    def nest(f, lo, hi, deep):
        at = lo
        while at < hi - 2 and deep:
            end = random.randint(at + 1, hi)
            intervals.append((f, at, end, f"{f}-{at}"))
            nest(f, at + 1, end - 1, deep - 1)
            at = end + random.randint(1, 4)

    for f in range(6):
        nest(f, 1, 60, 5)
    points = [(f, line) for f in range(7) for line in range(1, 64)]
    found = c.enclosing(spark.createDataFrame(points, "file_id long, line int"), spark.createDataFrame(intervals, "file_id long, start int, end int, name string")).collect()
    assert {(r["file_id"], r["line"]): (r["within"] and r["within"]["name"], r["level"]) for r in found} == brute_enclosing(points, intervals)


def test_comments_and_literals_hide_no_brace_and_invent_no_call(spark):
    text = 'class A {\n  /* { start(\n  } } */\n  fun go() {\n    val s = """{ end(\n } } """\n    real(1) // fake(2) {\n  }\n  fun real(a: Int) {\n    fun inner() {\n      go()\n    }\n  }\n}\nfun start() {\n}\nfun end() {\n}\nfun fake(x: Int) {\n}\n'
    df = spark.createDataFrame([("a/A.kt", text, 1, len(text))], "path string, content string, mtime long, size long")
    found, _, rows = c.symbols(df)
    spans = {(r["owner"], r["name"]): (r["start_line"], r["end_line"]) for r in found.collect()}
    assert spans[None, "A"] == (1, 14) and spans["A", "go"] == (4, 8) and spans["A", "real"] == (9, 13)
    tree = {r["name"]: (r["level"], r["parent"]) for r in c.scopes(c.spans(c.declared(rows), rows)).collect()}
    assert tree == {"A": (0, None), "go": (1, "A"), "real": (1, "A"), "inner": (2, "real"), "start": (0, None), "end": (0, None), "fake": (0, None)}
    from textloom.plans.code_queries import readable_edges

    edges = {(r["from_name"], r["to_name"]) for r in readable_edges(c.build(df)).collect()}
    assert ("a/A.kt:A.go", "a/A.kt:A.real") in edges and not [e for e in edges if e[1].split(":")[1] in ("start", "end", "fake")]
    assert [tuple(r) for r in c.definitions(df, "X::real").collect()] == [("a/A.kt", 9, 13)]


@pytest.mark.parametrize("sources, spans", [(SNIPPETS, SPANS), (MORE, MORE_SPANS)])
def test_spans_of_snippets(spark, sources, spans):
    found = c.symbols(files(spark, sources))[0].where("owner IS NULL OR owner <> name").select("path", "name", "owner", "kind", "start_line", "end_line")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(spans, key=repr)


def test_calls_of_snippets(spark):
    from textloom.plans.code_queries import readable_edges

    found = readable_edges(c.build(files(spark, SNIPPETS | CALLBACKS))).where("kind = 'CALLS'").select("from_name", "to_name")
    extra = [("jni/Call.cpp:notify_all", "app/Player.kt:Player.helper"), ("web/App.tsx:App", "web/App.tsx:Panel")]
    assert sorted(map(tuple, found.collect())) == sorted(CALLS + extra)


def kept_bytes(tables):
    import os

    paths = {p.removeprefix("file://") for t in tables for p in [x.rsplit("/", 1)[0] for x in t.inputFiles()]}
    return sum(os.path.getsize(os.path.join(p, f)) for p in paths for f in os.listdir(p) if f.endswith(".parquet"))


def test_symbols_keep_no_text_of_comments_and_deal_lines_out_once(spark):
    """What is written and shuffled follows the code of files, not their texts."""
    import random

    random.seed(5)
    notes = "".join(f"// {random.getrandbits(2000):x}\n" for _ in range(2000))
    text = notes + "class A {\n  fun go() {\n  }\n}\n"
    found, _, rows = c.symbols(spark.createDataFrame([("a/A.kt", text)], "path string, content string"))
    assert {(r["name"], r["start_line"], r["end_line"]) for r in found.collect()} == {("A", 2001, 2004), ("go", 2002, 2003)}
    assert kept_bytes([rows]) < len(text) / 10
    spans = c.spans(c.declared(rows), rows)
    spans.count()
    assert spans._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_signatures_over_lines_against_a_walk(spark):
    """Lines up to the closing bracket, 25 at most, from a file with carriage returns; a file is shuffled once, not its lines."""
    from textloom.operators import signatures as g

    long = "fun far(\n" + "".join(f"  a{i}: Int,\n" for i in range(40)) + ") {\n}\n"
    text = "class A {\r\n  fun one(a: Int) = f(a)\r\n  fun two(\r\n    a: Map<K, V>,\r\n    b: (Int) -> Int\r\n  ) {\r\n  }\r\n" + long + "fun end(\n"
    symbols = [("a", 2), ("a", 3), ("a", 8), ("a", 51), ("a", 99), ("gone", 1)]
    df = spark.createDataFrame(symbols, "path string, start_line int")
    found = g.gathered(df, spark.createDataFrame([("a", text)], "path string, content string"))
    got = {(r["path"], r["start_line"]): r["signature"] for r in found.collect()}
    assert got["a", 2] == "fun one(a: Int) = f(a)" and got["a", 3] == "fun two( a: Map<K, V>, b: (Int) -> Int )"
    assert got["a", 8] == "fun far( " + " ".join(f"a{i}: Int," for i in range(24)) and got["a", 51] == "fun end("
    assert got["a", 99] is None and got["gone", 1] is None and len(got) == len(symbols)
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 2


def test_lexer_with_the_sign_that_marks_tokens(spark):
    cases = [('a \x01 "b" // \x01 c\nd', 'a \x01 ""  \nd'), ('a "b" // c\nd', 'a ""  \nd')]
    df = spark.createDataFrame([("Kotlin", text, code) for text, code in cases], "language string, content string, wanted string")
    assert lexer.with_code(df).where("code = wanted").count() == len(cases)


def test_scopes_of_a_long_file(spark):
    """A file of 20,000 nested functions: every declaration and every closing brace of one depth, without a scan of all that follow."""
    import time

    n = 20_000
    text = "class C {\n" + "".join(f"  fun f{i}() {{\n    fun g{i}() {{\n    }}\n  }}\n" for i in range(n)) + "}\n"
    rows = c.coded(spark.createDataFrame([("k/C.kt", text)], "path string, content string"))
    began = time.time()
    found = c.scopes(c.spans(c.declared(rows), rows)).select("name", "level", "parent", "end_line").collect()
    assert time.time() - began < 40
    tree = {r["name"]: (r["level"], r["parent"], r["end_line"]) for r in found}
    assert len(found) == 2 * n + 1 and tree["C"] == (0, None, 4 * n + 2)
    assert all(tree[f"f{i}"] == (1, "C", 4 * i + 5) and tree[f"g{i}"] == (2, f"f{i}", 4 * i + 4) for i in range(n))


def test_refresh_reads_old_edges_only_if_it_keeps_them(spark):
    """An index that is refreshed after most files changed does not link the old state."""
    sources = {f"a/C{i}.kt": f"class C{i} {{\n  fun one{i}() {{\n    two{i}(1)\n  }}\n  fun two{i}(a: Int) {{\n  }}\n}}\n" for i in range(4)}
    index = c.build(files(spark, sources))
    now = files(spark, {k: v.replace("two", "three") for k, v in sources.items()})
    after = c.refresh(index, now)
    assert "edges" not in index and sorted(after["edges"].select("from_id", "to_id").collect()) == sorted(c.build(now)["edges"].select("from_id", "to_id").collect())
