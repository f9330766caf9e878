import pytest

from textloom.functions.patterns import required_literals, search_pattern, smart_pattern
from textloom.operators import search as s
from textloom.operators import text_index as ti


def test_patterns():
    assert search_pattern(["a.b", "c"]) == r"(?miu)a\.b|c"
    assert search_pattern(["word"]) == r"(?miu)\bword\b"
    assert search_pattern(["a.b"]) == r"(?miu)a\.b"
    assert search_pattern([r"foo\|bar"]) == "(?miu)foo|bar"
    assert search_pattern(["(a|b"]) == r"(?miu)\(a\|b"
    with pytest.raises(ValueError):
        search_pattern(["(a|b"], regex=True)
    assert smart_pattern("abc") == "(?iu)abc" and smart_pattern("Abc") == "Abc" and smart_pattern("(x") == r"(?iu)\(x"


def test_required_literals():
    assert required_literals("fooling.*bar") == ["fooling"]
    assert required_literals("(foo1|bar2)x") == ["bar2", "foo1"]
    assert required_literals("ab") is None and required_literals("a*bcd") is None and required_literals("éab") is None
    assert required_literals("(?miu)worthless") == ["worthle"]  # what follows may be a long s


def test_indexed_search_equals_full_scan(spark):
    texts = [(0, "Worthless\nline"), (1, "worth"), (2, "xx"), (3, ""), (4, "the Kelvin word\nWORTHLESS"), (5, "kelvin")]
    df = spark.createDataFrame(texts, "k int, text string")
    index = ti.learn(df.selectExpr("string(k) AS path", "1 AS mtime", "1 AS size", "text AS content")).cache()
    for term in (["worthless"], ["kelvin"], ["x"], ["worthless|kelvin"]):
        pattern = search_pattern(term)
        full = {tuple(r) for r in s.hits(df, pattern).collect()}
        assert {tuple(r) for r in ti.indexed_hits(df, index, pattern, "k").collect()} == full


def test_lines_and_context(spark):
    df = spark.createDataFrame([(1, "a\r\nhit hit\nb\nhit\n")], "k int, text string")
    rows = s.with_context(df, "hit", "k", 1).orderBy("line").collect()
    assert [(r["line"], r["line_text"], [x["line"] for x in r["before"]], [x["line"] for x in r["after"]]) for r in rows] == [(2, "hit hit", [1], [3]), (4, "hit", [3], [])]


def test_context_blocks(spark):
    from pyspark.sql import functions as F

    rows = spark.range(30).select(F.lit(0).alias("k"), F.col("id").alias("pos"))
    found = s.context_blocks(rows, F.col("pos").isin(1, 10, 15, 28), ["k"], "pos", 3)
    assert sorted((r["first"], r["last"]) for r in found.collect()) == [(0, 4), (7, 18), (25, 29)]


def test_page_past_the_end(spark):
    df = spark.createDataFrame([(1, "hit"), (2, "hit")], "k int, text string")
    assert s.page(s.hits(df, "hit"), "k", offset=5).count() == 0
    assert [r["k"] for r in s.page(s.hits(df, "hit"), "k", offset=1).collect()] == [2]
