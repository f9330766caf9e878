import tempfile

from pyspark.sql import functions as F
from snippets import SNIPPETS, files

from textloom.operators import code_index as c
from textloom.operators import logs
from textloom.plans.code_queries import readable_edges
from textloom.sources import files as src
from textloom.streaming import recorder


def edges(index):
    return sorted((r["from_name"], r["to_name"]) for r in readable_edges(index).collect())


def test_link_rules(spark):
    """Typed receivers, prototypes that give way to definitions, language families, and self hits that stop the search."""
    found = edges(
        c.build(
            files(
                spark,
                {
                    "a/engine.h": "class Engine {\n  void start();\n};\n",
                    "a/engine.cpp": "void Engine::start() {\n  prepare_all(1);\n}\nvoid prepare_all(int x) {\n  strerror(x);\n}\n",
                    "a/x.py": "def start():\n    return run_it()\n\ndef run_it():\n    return run_it()\n",
                    "a/y.js": "function go() {\n  run_it();\n}\n",
                    "b/Main.java": "public class Main {\n  private Helper helper;\n  public void go() {\n    helper.work(1);\n    this.other(2);\n  }\n  public void other(int a) {\n  }\n}\n",
                    "b/Helper.kt": "class Helper {\n  fun work(a: Int) {\n  }\n}\n",
                    "b/Other.kt": "class Other {\n  fun work(a: Int) {\n  }\n}\n",
                },
            )
        )
    )
    assert ("a/engine.cpp:Engine.start", "a/engine.cpp:prepare_all") in found
    assert ("a/x.py:start", "a/x.py:run_it") in found
    assert ("b/Main.java:Main.go", "b/Helper.kt:Helper.work") in found and ("b/Main.java:Main.go", "b/Main.java:Main.other") in found
    assert not [x for x in found if x[0].startswith("a/y.js")] and not [x for x in found if x[0] == x[1]]


def test_index_versions(spark):
    folder = tempfile.mkdtemp(prefix="spark-index-")
    index = c.build(files(spark))
    c.write_index(index, folder)
    assert edges(c.read_index(spark, folder)) == edges(index)


def test_refresh_after_removal_equals_full(spark):
    state = dict(SNIPPETS)
    index = c.build(files(spark, state))
    state.pop("lib/b.py")
    now = files(spark, state)
    assert edges(c.refresh(index, now)) == edges(c.build(now))


def test_file_scan(spark, tmp_path):
    for name, data in {"src/a.py": b"x = 1\n", "src/b.bin": b"\0\1", "vendor/c.py": b"y", "notes.md": b"#"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    tree = src.scan(spark, str(tmp_path))
    assert sorted(r["path"] for r in tree.collect()) == ["notes.md", "src/a.py", "src/b.bin", "vendor/c.py"]
    assert [r["path"] for r in src.searchable(tree).collect()] == ["src/a.py"]
    assert [r["path"] for r in src.code_files(tree).collect()] == ["src/a.py"]
    assert [r["content"] for r in src.texts(src.named_files(tree, ["src"])).collect()] == ["x = 1\n"]


def test_manifest_sections(spark):
    df = spark.createDataFrame([('{"dependencies": {"a": "1"}, "devDependencies": {"a": "2", "b": "3"}}',)], "content string")
    assert [tuple(x) for x in df.select(src.manifest_packages(F.col("content")).alias("p")).first()["p"]] == [("a", "dependencies"), ("b", "devDependencies")]


LOG = "pid long, pos long, ts timestamp, level string, stage string"


def at(minute):
    from datetime import UTC, datetime, timedelta

    return datetime(2024, 1, 1, tzinfo=UTC) + timedelta(minutes=minute)


def run_progress(spark, rows, folder, out):
    """One more file of entries, and a run over what there is; rows of state at its end."""
    spark.createDataFrame([(p, i, at(m), lv, st) for i, (p, m, lv, st) in enumerate(rows)], LOG).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(LOG).parquet(folder)
    query = recorder.progress(stream, 30 * 60_000, "5 minutes").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return query.recentProgress[-1].stateOperators[0].numRowsTotal


def test_idle_keys_leave_the_state_and_runs_end(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    found = lambda: sorted((r["pid"], r["start"].minute, r["entries"], r["errors"], r["warnings"], r["stage"]) for r in spark.read.parquet(f"{out}/rows").collect())
    assert run_progress(spark, [(1, 0, "I", "setup"), (1, 3, "E", None), (2, 1, "W", None), (3, 50, "I", "run")], folder, out) == 1
    assert found() == [(1, 0, 2, 1, 0, "setup"), (2, 1, 1, 0, 1, "")]  # idle by minute 45, the watermark
    assert run_progress(spark, [(3, 55, "E", "test"), (1, 50, "I", None)], folder, out) == 2  # 1 starts anew
    assert len(found()) == 2
    # within one batch: 3 is idle between two of its entries
    assert run_progress(spark, [(3, 120, "I", None), (3, 57, "I", None)], folder, out) == 1
    assert found()[2:] == [(2, 1, 1, 0, 1, ""), (3, 50, 3, 1, 0, "test")] and found()[1] == (1, 50, 1, 0, 0, "")


def test_totals_and_stats(spark):
    lines = spark.createDataFrame([("test result: ok. 3 passed; 1 failed; 2 ignored",), ("ran",), ("2 passed",)], "line string")
    assert tuple(logs.test_totals(lines).first()) == (5, 1, 2)
    stat = spark.createDataFrame([(" 4 files changed, 37 insertions(+), 9 deletions(-)",), (" 1 file changed, 2 insertions(+)",)], "s string")
    assert [r[0] for r in stat.select(logs.short_stat(F.col("s"))).collect()] == ["4 files, +37 -9", "1 file, +2 -0"]


def disk_bytes(spark):
    """Bytes of shuffle files and of kept tables."""
    import os

    from textloom.operators import storage

    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    total = 0
    while blocks.hasNext():
        total += blocks.next().length()
    for folder in storage._spaces()[0]:
        path = folder.removeprefix("file://")
        total += sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)
    return total


def test_an_index_moves_code_and_not_texts(spark):
    """Comments of two million random bytes neither go through shuffles nor into kept tables."""
    import random

    random.seed(7)
    note = "\n".join(f"// {random.getrandbits(4000):x}" for _ in range(2000))
    text = "class A {\n  fun go() {\n    stay(1)\n  }\n  fun stay(a: Int) {\n  }\n}\n" + note
    df = spark.createDataFrame([("a/A.kt", text, 1, len(text))], "path string, content string, mtime long, size long")
    before = disk_bytes(spark)
    assert edges(c.build(df)) == [("a/A.kt:A.go", "a/A.kt:A.stay")]
    assert disk_bytes(spark) - before < len(text) / 4


def test_link_rule_against_a_walk(spark):
    """Every tier of the rule, with declarations that give way, constructors and common names, against a walk over all candidates."""
    import random

    random.seed(11)
    names, owners, languages = ["a", "b", "A", "B", "get", "z"], [None, "A", "B"], ["Kotlin", "Java", "Python"]
    syms = {}
    for i in range(60):
        file, lang = random.randrange(12), None
        lang = languages[file % 3]
        name, owner = random.choice(names), random.choice(owners)
        syms[file, owner, name] = (i, name, owner, file, lang, random.random() < 0.6, f"p{file}", i)
    syms = list(syms.values())
    sites = []
    for i in range(400):
        file = random.randrange(12)
        dotted = random.random() < 0.5
        recv = random.choice(["", "A", "B", "X"]) if dotted else random.choice(["", "", "@jvm"])
        sites.append((1000 + i if i % 4 else random.choice(syms)[0], file, languages[file % 3], random.choice(owners), random.choice(names), dotted, recv))
    family = lambda lang: "JVM" if lang in ("Kotlin", "Java") else lang

    def walk(site):
        _, file, lang, caller, callee, dotted, recv = site
        if recv == "@jvm":
            of = [s for s in syms if s[1] == callee and family(s[4]) == "JVM"]
            return of[0][0] if len(of) == 1 else None
        of = [s for s in syms if s[1] == callee and family(s[4]) == family(lang)]
        of = [s for s in of if s[5] or not any(t[5] and t[2] == s[2] for t in of)]
        own = [s for s in of if s[2] == s[1]]
        of = own if len(own) == 1 else of
        first = lambda some: min(some, key=lambda s: (s[6], s[7], s[0]))[0] if some else None
        tiers = [first([s for s in of if recv and s[2] == recv and s[3] == file]), first([s for s in of if recv and s[2] == recv])]
        if not dotted:
            tiers += [first([s for s in of if caller and s[2] == caller and s[3] == file]), first([s for s in of if caller and s[2] == caller])]
        if not (dotted and recv):
            tiers.append(first([s for s in of if s[3] == file]))
        if len(of) == 1 and not (dotted and callee in c.COMMON_METHODS):
            tiers.append(of[0][0])
        return next((t for t in tiers if t is not None), None)

    found = c.resolve(
        spark.createDataFrame(sites, "symbol_id long, file_id long, language string, caller_owner string, callee string, dotted boolean, recv_type string"),
        spark.createDataFrame(syms, "id long, name string, owner string, file_id long, language string, has_body boolean, path string, start_line int"),
    )
    wanted = {(s[0], to, "CALLS") for s in sites if (to := walk(s)) is not None and to != s[0]}
    assert {tuple(r) for r in found.collect()} == wanted and len(wanted) > 50
