from pyspark.sql import functions as F

from textloom.functions import text as x
from textloom.operators import edits as e
from textloom.operators import lookup, snapshots
from textloom.operators import trees as t


def test_compare_kinds(spark):
    schema = "path string, size long, hash string, eol_hash string"
    a = spark.createDataFrame([("s/a", 1, "1", "1"), ("s/e", 2, "2", "9"), ("s/c", 2, "3", "3"), ("gone/x", 4, "m", "m")], schema)
    b = spark.createDataFrame([("s/a", 1, "1", "1"), ("s/e", 3, "5", "9"), ("s/c", 2, "4", "4"), ("new/x", 4, "m", "m"), ("new/y", 0, "z", "z")], schema)
    pairs = t.compared(a, b)
    assert {r["path"]: r["kind"] for r in pairs.collect()} == {"s/a": "same", "s/e": "eol_only", "s/c": "changed", "gone/x": "only_a", "new/x": "only_b", "new/y": "only_b"}
    assert [tuple(r) for r in t.moved(pairs).collect()] == [("gone/x", "new/x")]
    assert [tuple(r) for r in t.one_sided(pairs, "b").collect()] == [("new/", 2, 4)]


def test_suffixes_find_their_file(spark):
    paths = ["a/b/x.kt", "a/c/x.kt", "d/x.kt", "y.kt", "a/y.kt"]
    tree = spark.createDataFrame([(p, 1) for p in paths], "path string, size long")
    found = {r["path"]: r["suffix"] for r in t.shortest_suffix(tree).collect()}
    assert found["a/b/x.kt"] == "b/x.kt" and found["d/x.kt"] == "d/x.kt" and found["a/y.kt"] == "a/y.kt"
    for p, s in found.items():
        assert s == p or [q for q in paths if q == s or q.endswith("/" + s)] == [p]


def test_dominant_folder_and_map(spark):
    tree = spark.createDataFrame([(f"src/main/p{i % 3}/f{i}.kt", 10) for i in range(60)] + [("docs/a.md", 1)], "path string, size long")
    assert t.dominant_folder(tree) == "src/main"
    assert t.open_map(tree) == [("src/main/p0", 20), ("src/main/p1", 20), ("src/main/p2", 20)]


def test_patch_strategies(spark):
    files = spark.createDataFrame([("a", "one\r\ntwo\r\n"), ("b", "one\ntwo\n"), ("c", "  one  "), ("d", "x one two x one"), ("e", "none of it")], "path string, content string")
    rows = {r["path"]: r for r in e.patch(files, "one\ntwo", "1\n2").collect()}
    assert (rows["a"]["strategy"], rows["a"]["result"]) == ("crlf_normalized", "1\r\n2\r\n")
    assert (rows["b"]["strategy"], rows["b"]["result"]) == ("exact_match", "1\n2\n")
    assert rows["e"]["status"] == "not_found"
    rows = {r["path"]: r for r in e.patch(files, " one\n", "$1\\").collect()}
    assert rows["c"]["strategy"] == "trimmed_match" and rows["c"]["result"] == "  $1\\  " and rows["d"]["status"] == "ambiguous"


def test_blocks_are_all_or_nothing(spark):
    files = spark.createDataFrame([("a", "one two"), ("b", "x")], "path string, content string")
    good = spark.createDataFrame([("a", 1, "one", "two"), ("b", 1, "x", "y")], "path string, ord int, old string, new string")
    bad = good.union(spark.createDataFrame([("b", 2, "zzz", "y")], good.schema))
    assert {r["path"]: r["result"] for r in e.apply_blocks(files, good).collect()} == {"a": "two two", "b": "y"}
    assert {r["path"]: r["result"] for r in e.apply_blocks(files, bad).collect()} == {"a": "one two", "b": "x"}


def test_snapshot_round_trip(spark):
    old = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2")), (".env", bytearray(b"s"))], "path string, content binary")
    new = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"3")), ("c", bytearray(b"4"))], "path string, content binary")
    m = snapshots.manifest(old)
    assert {r["path"]: r["status"] for r in snapshots.diff(m, snapshots.manifest(new)).collect()} == {"b": "M", "c": "A"}
    store = old.select(F.sha2("content", 256).alias("hash"), "content")
    assert {r["path"]: bytes(r["content"]) for r in snapshots.restore(new, m, store).collect()} == {"a": b"1", "b": b"2", "c": b"4"}


def test_scalars(spark):
    one = spark.createDataFrame([("shared_ptr<ns::Decoder>", "impl Draw for Shape<T>", 1280, 3725, "a\nb")], "t string, i string, n long, s long, x string")
    r = one.select(x.simplify_type(F.col("t")), x.canonical_type(F.col("i")), x.human_size(F.col("n")), x.duration(F.col("s")), x.line_count(F.col("x")), x.thousands(F.col("s"))).first()
    assert tuple(r) == ("Decoder", "Shape", "1.2 KB", "62m05s", 2, "3,725")


def test_cascade_stops_at_first_tier(spark):
    rows = spark.createDataFrame([("open", "Box", "a/b.kt"), ("openAll", "Box", "a/b.kt"), ("50%_x", None, "c.kt")], "name string, owner string, path string")
    ask = lambda q: [(r["name"], r["tier"]) for r in lookup.candidates(rows, q).collect()]
    assert ask("OPEN") == [("open", 1)] and ask("Box::open") == [("open", 2)] and ask("b.kt:open") == [("open", 3)]
    assert ask("nall") == [("openAll", 4)] and ask("%_") == [("50%_x", 4)] and ask("zzz") == []
