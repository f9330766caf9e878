from pyspark.sql import functions as F

from textloom.functions.patterns import search_pattern
from textloom.operators import edits as e
from textloom.operators import search as s
from textloom.operators import signatures as g
from textloom.operators import text_index as ti
from textloom.operators import versions
from textloom.operators.storage import kept

TREE = "path string, mtime long, size long, content string"


def tree(spark, files):
    return spark.createDataFrame([(p, m, len(t), t) for p, (m, t) in files.items()], TREE)


def test_index_reads_what_it_does_not_know_and_misses_nothing(spark):
    files = {"a": (1, "Worthless line\nx"), "b": (1, "nothing here"), "c": (1, "\0worthless"), "d": (1, "")}
    pattern = search_pattern(["worthless"])
    index = ti.empty(spark)
    now = tree(spark, files)
    names = lambda df: sorted(r["path"] for r in df.collect())
    full = lambda t: sorted(tuple(r) for r in s.hits(t.where(~F.contains("content", F.lit("\0"))).select("path", "content"), pattern, "content").collect())
    assert names(ti.to_read(index, now, pattern)) == ["a", "b", "c", "d"]
    index = kept(ti.learn(now, now))
    assert names(ti.to_read(index, now, pattern)) == ["a"]  # c is known to be binary
    assert names(ti.to_read(index, now, "(?i)w.*s")) == ["a", "b", "d"]  # no literal: all texts
    # edited, added, deleted
    later = files | {"b": (2, "now worthless"), "e": (1, "worthless too")}
    later.pop("a")
    then = tree(spark, later)
    states = {r["path"]: r["state"] for r in ti.plan(index, then).collect()}
    assert states == {"a": "gone", "b": "stale", "c": "binary", "d": "fresh", "e": "unknown"}
    assert names(ti.to_read(index, then, pattern)) == ["b", "e"]
    assert sorted(tuple(r) for r in ti.search(index, then, pattern).collect()) == full(then)
    # a file that changed while it was read is not learnt
    moving = tree(spark, later | {"e": (3, "other words")})
    index = index.unionByName(kept(ti.learn(then.where("path IN ('b', 'e')"), moving)))
    assert {r["path"]: r["state"] for r in ti.plan(index, moving).collect()} == {"a": "gone", "b": "fresh", "c": "binary", "d": "fresh", "e": "unknown"}
    assert sorted(tuple(r) for r in ti.search(index, moving, pattern).collect()) == full(moving)


def test_filters_are_exact_in_size_and_miss_nothing():
    text = "the quick brown\nfox İstanbul \U0001f600 " * 3
    found = ti.trigrams(text)
    plain = {text[i : i + 3] for i in range(len(text) - 2)} - {x for x in (text[i : i + 3] for i in range(len(text) - 2)) if "\n" in x}
    assert len(found) == len(plain)
    words = ti.bloom(found)
    assert len(words) * 64 == max(256, 1 << (6 * len(found) - 1).bit_length())
    assert all(int(words[p % (len(words) * 64) >> 6]) >> (p & 63) & 1 for p in ti.positions(found).tolist())
    assert len(ti.bloom(ti.trigrams("ab"))) == 4


def test_a_filter_rules_most_texts_out(spark):
    texts = spark.range(2000).select(F.col("id").cast("string").alias("path"), F.lit(1).alias("mtime"), F.lit(1).alias("size"), F.expr("sha2(string(id), 512)").alias("content"))
    index = ti.learn(texts)
    maybe = index.where(ti.allows(F.col("bits"), ["abcde"])).count()
    truly = texts.where(F.col("content").contains("abcde")).count()
    assert truly <= maybe < 2000 * 0.02


def test_index_learns_and_compacts(spark, tmp_path):
    """Created, edited, added and deleted files: every search finds what a full one does and reads little."""
    folder, pattern = f"file://{tmp_path}/index", search_pattern(["worthless"])
    names = lambda df: sorted(r["path"] for r in df.collect())
    now = tree(spark, {"a": (1, "worthless"), "b": (1, "none"), "c": (1, None or "\0")})
    assert names(ti.to_read(ti.open_index(spark, folder), now, pattern)) == ["a", "b", "c"]
    assert ti.refresh(spark, folder, now) == 1
    assert names(ti.to_read(ti.open_index(spark, folder), now, pattern)) == ["a"]
    then = tree(spark, {"b": (2, "worthless"), "c": (1, "\0"), "d": (1, "some words")})
    old = ti.open_index(spark, folder)
    assert ti.refresh(spark, folder, then) == 2
    assert names(ti.to_read(ti.open_index(spark, folder), then, pattern)) == ["b"]
    assert ti.open_index(spark, folder).count() == 5 and old.count() == 3  # only what changed was added
    assert ti.compact(spark, folder, then) == 3
    assert names(ti.open_index(spark, folder)) == ["b", "c", "d"] and old.count() == 3
    versions.expire(spark, folder)
    assert names(ti.open_index(spark, folder)) == ["b", "c", "d"]
    assert len(list((tmp_path / "index" / "tables").iterdir())) == 1 and len(list((tmp_path / "index" / "log").glob("*.json"))) == 1


def test_a_reader_between_the_steps_sees_the_old_version(spark, tmp_path):
    folder = f"file://{tmp_path}/v"
    table = lambda n: versions.add_table(spark.range(n), folder, "rows")
    assert versions.latest(spark, folder) == (0, {})
    assert versions.commit(spark, folder, 0, {"rows": [table(3)]}) == 1
    new = table(5)
    (tmp_path / "v" / "log" / ".draft-x").write_text('{"rows"')  # of a writer that died
    number, content = versions.latest(spark, folder)
    assert number == 1 and spark.read.parquet(*content["rows"]).count() == 3
    versions.commit(spark, folder, 1, {"rows": [new]})
    assert spark.read.parquet(*versions.latest(spark, folder)[1]["rows"]).count() == 5
    assert spark.read.parquet(*versions.read(spark, folder, 1)["rows"]).count() == 3


def test_of_two_writers_one_commits(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    folder = f"file://{tmp_path}/v"
    path = versions.add_table(spark.range(1), folder, "rows")
    versions.commit(spark, folder, 0, {"rows": [path]})

    def write(n):
        try:
            return versions.commit(spark, folder, 1, {"rows": [path], "by": [str(n)]})
        except versions.Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(write, range(8)))
    assert done.count(2) == 1 and done.count(None) == 7
    assert versions.latest(spark, folder)[1]["by"] == [str(done.index(2))]


def test_two_threads_keep_their_tables_apart(spark):
    from concurrent.futures import ThreadPoolExecutor

    from textloom.operators.storage import kept, release, workspace

    def work(n):
        with workspace(spark) as keep:
            table = keep(kept(spark.range(n)))
            for _ in range(3):
                kept(spark.range(5))
        found = table.count()
        release(spark)
        return found

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(work, range(1, 9))) == list(range(1, 9))


def test_empty_old_texts_are_refused(spark):
    files = spark.createDataFrame([("a", "one two"), ("b", "x")], "path string, content string")
    assert {r["status"] for r in e.patch(files, "", "new").collect()} == {"refused"}
    blocks = spark.createDataFrame([("a", 1, "", "ONE"), ("b", 1, "x", "y")], "path string, ord int, old string, new string")
    assert sorted(tuple(r) for r in e.apply_blocks(files, blocks).collect()) == [("a", "one two", "one two", 1), ("b", "x", "x", 0)]
    assert sorted(tuple(r) for r in e.apply_in_turn(files, blocks).collect()) == [("a", "one two", 0, 1), ("b", "y", 1, None)]


def test_languages_and_paths(spark):
    rows = spark.createDataFrame([("a/x.kt", "Kotlin"), ("a/y.kts", "Kotlin"), ("b/z.c", "C/C++"), ("b/q", None)], "path string, language string")
    ask = lambda w: [r["path"] for r in rows.where(g.matches_language(F.col("path"), F.col("language"), w)).collect()]
    assert ask("kt") == ["a/x.kt", "a/y.kts"] and ask("kot") == ["a/x.kt", "a/y.kts"] and ask("c++") == ["b/z.c"] and ask("rs") == []
    assert g.has_path(rows, "a") and g.has_path(rows, "b/q") and not g.has_path(rows, "c")


def test_ignore_rules(spark):
    from textloom.sources import files as src

    rules = "# comment\n*.log\n/build\nout/\n!keep.log\nsrc/**/gen_?.py\n"
    paths = ["a.log", "x/b.log", "x/keep.log", "build/a.py", "x/build/a.py", "x/out/a.py", "out", "src/gen_1.py", "src/a/b/gen_2.py", "src/gen_10.py", "a+log"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [r["path"] for r in df.where(src.is_ignored(F.col("path"), src.ignore_rules(rules))).collect()]
    assert got == ["a.log", "x/b.log", "build/a.py", "x/out/a.py", "src/gen_1.py", "src/a/b/gen_2.py"]


def test_recording_goes_on_where_it_ended(spark, tmp_path):
    from textloom.streaming import recorder as r

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.where("event_id % 2 = 0").coalesce(1).write.parquet(folder)
    assert r.run_to(r.recorded(r.read_events(spark, folder), ["error"]), out).count() == events.where("event_id % 2 = 0 AND (event_type = 'error' OR props LIKE '%error%')").count()
    events.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(folder)
    assert r.run_to(r.recorded(r.read_events(spark, folder), ["error"]), out).count() == events.where("event_type = 'error' OR props LIKE '%error%'").count()
