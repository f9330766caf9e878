"""Hunks, ignore files, includes and markup against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import diffs, ignores, includes, markup


def edited(lines, rng):
    out = list(lines)
    for _ in range(rng.randint(0, 6)):
        at = rng.randint(0, len(out))
        pick = rng.random()
        if pick < 0.4:
            out[at:at] = [rng.choice("abc}") for _ in range(rng.randint(1, 3))]
        elif pick < 0.8:
            del out[at : at + rng.randint(1, 4)]
        else:
            out[at : at + 5] = reversed(out[at : at + 5])
    return out


def test_alignment_is_rising_and_keeps_unmoved_lines():
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.choice("abcdefgh}}}") for _ in range(rng.randint(0, 40))]
        b = edited(a, rng)
        found = diffs.matches(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p < x and q < y for (p, q), (x, y) in zip(found, found[1:], strict=False))
        if a == b:
            assert len(found) == len(a)
    big = [f"line {i % 9000}" for i in range(60_000)]
    assert len(diffs.matches(big, big[:30_000] + ["new"] + big[30_000:])) == 60_000


def test_hunks_apply(spark):
    rng = random.Random(8)
    rows = []
    for k in range(120):
        a = [rng.choice(["a", "b", "c", "", "}", f"l{rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 30))]
        rows.append((f"f{k}", "\n".join(a), "\n".join(edited(a, rng))))
    rows += [("e", "", "x\n"), ("g", "x", ""), ("n", None, "x"), ("same", "a\nb", "a\nb")]
    df = spark.createDataFrame(rows, "path string, old string, new string")
    old, new = df.select("path", F.col("old").alias("text")), df.select("path", F.col("new").alias("text"))
    hunks = diffs.line_hunks(old, new).cache()
    done = {r["path"]: r["text"] for r in diffs.apply_hunks(old, hunks).collect()}
    assert done == {p: b or "" for p, _, b in rows}
    for r in hunks.collect():
        signs = [x["sign"] for x in r["rows"]]
        assert r["old_lines"] == len(signs) - signs.count("+") and r["new_lines"] == len(signs) - signs.count("-")
        assert len(signs) - len("".join(signs).lstrip(" ")) <= 2 and len(signs) - len("".join(signs).rstrip(" ")) <= 2


RULES = {".gitignore": "# c\n*.log\n/build\nout/\n!keep.log\nsrc/**/gen_?.py\nlogs/\n", "x/.gitignore": "!b.log\nkeep.log\n/only.txt\n", "logs/.gitignore": "!*\n", "x/y/.gitignore": "*\n!a+b.c\n"}
PATHS = {
    "a.log": False, "x/b.log": True, "x/keep.log": False, "keep.log": True, "build/a.py": False, "x/build/a.py": True, "x/out/a.py": False, "out": True, "src/gen_1.py": False,
    "src/a/b/gen_2.py": False, "src/gen_10.py": True, "a+log": True, "logs/deep/a.txt": False, "x/only.txt": False, "x/z/only.txt": True, "x/y/q.c": False, "x/y/a+b.c": True,
}


def test_ignore_files_of_nested_folders(spark):
    tree = spark.createDataFrame([(p, 1) for p in PATHS], "path string, size long")
    files = spark.createDataFrame(list(RULES.items()), "path string, content string")
    assert {r["path"] for r in ignores.not_ignored(tree, files).collect()} == {p for p, kept in PATHS.items() if kept}
    assert ignores.not_ignored(tree, files.where("false")).count() == len(PATHS)


def test_includes(spark):
    texts = {
        "src/m/a.cpp": '#include "b.h"\n #  include "deep/c.h"\n#include <d.h>\n', "src/m/b.h": '#include "e.h"\n', "b.h": "far", "src/e.h": '#include "f.h"\n#include "b.h"\n', "f.h": '#include "g.h"\n', "g.h": "too deep",
        "src/deep/c.h": "x" * 40, "src/m/a.hpp": "own", "d.h": "", "src/m/z.cpp": "none",
    }
    files = spark.createDataFrame(list(texts.items()), "path string, content string")
    sources = files.where("path LIKE '%.cpp'")
    found = lambda **k: sorted((r["path"], r["header"], r["depth"]) for r in includes.included(sources, files, **k).collect())
    a = "src/m/a.cpp"
    assert found() == sorted([(a, "src/m/b.h", 0), (a, "src/deep/c.h", 0), (a, "src/m/a.hpp", 0), (a, "src/e.h", 1), (a, "f.h", 2), (a, "b.h", 2)])
    assert found(deepest=0) == sorted([(a, "src/m/b.h", 0), (a, "src/deep/c.h", 0), (a, "src/m/a.hpp", 0)])
    assert (a, "src/deep/c.h", 0) not in found(most_header=40)
    assert found(most_all=1) == [(a, "src/deep/c.h", 0)]
    text = {r["path"]: r["content"] for r in includes.expanded(sources, files).collect()}
    assert text["src/m/z.cpp"] == "none" and text[a].endswith(texts[a]) and text[a].startswith(texts["src/deep/c.h"] + "\nown\n" + texts["src/m/b.h"])


def brute_nodes(events):
    """Stack-based: (pre, end, depth, parent) of (kind, name) with kind open, close or alone."""
    out, stack = [], []
    for kind, name in events:
        if kind == "close":
            out[stack.pop()][1] = len(out)
        else:
            out.append([len(out), len(out) + 1, len(stack), stack[-1] if stack else None, name])
            if kind == "open":
                stack.append(len(out) - 1)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_markup(spark, seed):
    rng = random.Random(seed)
    rows, expected = [], {}
    for k in range(12):
        events = []

        def grow(deep, events=events):
            for _ in range(rng.randint(0, 3)):
                name = rng.choice(["div", "a", "span", "button"])
                if rng.random() < 0.3:
                    events.append(("alone", rng.choice(["br", "img", "input"])))
                elif deep:
                    events.append(("open", name))
                    grow(deep - 1)
                    events.append(("close", name))

        grow(5)
        text = "".join({"open": f'<{n} t="a>b">x', "close": f"</{n}>", "alone": f"<{n}/>" if n != "br" else "<br>"}[kind] for kind, n in events)
        rows.append((k, "<!-- <div> --><script>'<a>'</script>" + text))
        expected[k] = brute_nodes(events)
    df = spark.createDataFrame([*rows, (98, None), (99, "no tags")], "page_id long, html string")
    nodes = markup.nodes(df).cache()
    found = sorted((r["page_id"], r["pre"], r["end"], r["depth"], r["parent"], r["name"]) for r in nodes.collect())
    assert found == sorted((k, *n) for k, ns in expected.items() for n in ns)
    focus = ("a", "button", "input")
    for r in markup.targets(nodes, F.col("name").isin(*focus)).collect():
        ns = expected[r["page_id"]]
        own = ns[r["pre"]]
        up, at = None, own[3]
        while at is not None and up is None:
            up, at = (at if ns[at][4] in focus else None), ns[at][3]
        down = next((n[0] for n in ns[own[0] + 1 : own[1]] if n[4] in focus), None)
        assert r["target"] == (own[0] if own[4] in focus else up if up is not None else down)


def test_closest_line_equals_brute_force(spark):
    from collections import Counter

    from textloom.operators import lookup

    rng = random.Random(12)
    texts = ["".join(rng.choice("abcd e") for _ in range(rng.randint(0, 14))) for _ in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")

    def grams(text):
        s = "".join(text.lower().split())
        return Counter(s[i : i + 2] for i in range(len(s) - 1))

    wanted = {}
    for a, x in enumerate(texts[:30]):
        best = []
        for b, y in enumerate(texts):
            p, q = grams(x), grams(y)
            if p and q and a != b and 0.5 * len(x) <= len(y) <= 2 * len(x) and (dice := 2 * (p & q).total() / (p.total() + q.total())) >= 0.6:
                best.append((dice, -b))
        if best:
            wanted[a] = (-max(best)[1], round(max(best)[0], 9))
    found = lookup.closest_line(df.where("id < 30").selectExpr("id AS probe_id", "t AS probe"), df.selectExpr("id AS line_id", "t AS line"), others=True)
    assert {r["probe_id"]: (r["line_id"], round(r["dice"], 9)) for r in found.collect()} == wanted
