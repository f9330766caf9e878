"""Line hunks between two versions of texts, and their application."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HUNK = "path string, old_start int, old_lines int, new_start int, new_lines int, added int, removed int, rows array<struct<sign:string,line:string>>"
#: Places of the rarest common line that are tried for the longest run.
TRIED = 16


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, given by their first numbers, whose second numbers rise."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back.append(ends[at - 1] if at else -1)
        tails[at : at + 1] = [j]
        ends[at : at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal lines (i, j), rising in both: an alignment in linear memory. Equal starts and ends are taken first; what is
    left is cut at the longest rising sequence of lines that are unique in both, or, if there are none, at the longest run
    around a rarest common line, and its parts are aligned likewise."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            found.append((k, m))
        if i == k or j == m:
            continue
        in_a, in_b = Counter(a[i:k]), Counter(b[j:m])
        where = {line: y for y, line in enumerate(b[j:m], j) if in_b[line] == 1}
        anchors = _rising([(x, where[line]) for x, line in enumerate(a[i:k], i) if in_a[line] == 1 and line in where])
        if not anchors:
            common = in_a.keys() & in_b.keys()
            if not common:
                continue
            rare = min(common, key=lambda line: (in_a[line] + in_b[line], line))
            xs = [x for x in range(i, k) if a[x] == rare][:TRIED]
            ys = [y for y in range(j, m) if b[y] == rare][:TRIED]
            best = (0, 0, 0)
            for x in xs:
                for y in ys:
                    n = 1
                    while x + n < k and y + n < m and a[x + n] == b[y + n]:
                        n += 1
                    best = max(best, (n, -x, -y))
            anchors = [(-best[1], -best[2])]
        found += anchors
        ends = [(i - 1, j - 1), *anchors, (k, m)]
        todo += [(p + 1, x, q + 1, y) for (p, q), (x, y) in zip(ends, ends[1:], strict=False)]
    return sorted(found)


def hunks_of(a: list[str], b: list[str], around: int) -> Iterator[tuple[int, int, int, int, list[tuple[str, str]]]]:
    """(old start, new start, removed, added, rows) of the hunks with so many lines of context; starts from 1, rows signed as in
    a unified diff."""
    pairs = [(-1, -1), *matches(a, b), (len(a), len(b))]
    gaps = [(p + 1, x, q + 1, y) for (p, q), (x, y) in zip(pairs, pairs[1:], strict=False) if x > p + 1 or y > q + 1]
    groups: list[list[tuple[int, int, int, int]]] = []
    for gap in gaps:
        if groups and gap[0] - groups[-1][-1][1] <= 2 * around:
            groups[-1].append(gap)
        else:
            groups.append([gap])
    for group in groups:
        first = max(0, group[0][0] - around)
        shift = group[0][2] - group[0][0]
        rows, at = [], first
        for x, x_end, y, y_end in group:
            rows += [(" ", line) for line in a[at:x]] + [("-", line) for line in a[x:x_end]] + [("+", line) for line in b[y:y_end]]
            at = x_end
        rows += [(" ", line) for line in a[at : at + around]]
        yield first + 1, first + shift + 1, sum(s == "-" for s, _ in rows), sum(s == "+" for s, _ in rows), rows


def line_hunks(old: DataFrame, new: DataFrame, around: int = 2) -> DataFrame:
    """Hunks of texts (path, text) that are on both sides and differ (M13): where they start and how many lines they have on each side,
    with their rows: ' ' kept, '-' removed, '+' added. A file is one task's work, in memory linear in its lines; an empty
    text has no line, and a line break at the end is an empty line more. Null texts count as empty."""
    both = old.select("path", F.coalesce("text", F.lit("")).alias("old")).join(new.select("path", F.coalesce("text", F.lit("")).alias("new")), "path").where("old <> new")

    def diff(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, a, b in frame.itertuples(index=False):
                split = [x.split("\n") if x else [] for x in (a, b)]
                out = []
                for at, to, removed, added, rows in hunks_of(*split, around):
                    kept = len(rows) - removed - added
                    out.append((path, at, kept + removed, to, kept + added, added, removed, [{"sign": s, "line": line} for s, line in rows]))
                if out:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in HUNK.split(", ")])

    return both.mapInPandas(diff, HUNK)


def apply_hunks(old: DataFrame, hunks: DataFrame) -> DataFrame:
    """(path, text) of the old texts with their hunks applied. The fold is per file, over that file's hunks."""
    grouped = hunks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("old_start", "old_lines", F.transform(F.filter("rows", lambda r: r["sign"] != "-"), lambda r: r["line"]).alias("lines")))).alias("hunks"))
    rows = old.select("path", F.coalesce("text", F.lit("")).alias("text")).join(grouped, "path", "left")
    rows = rows.withColumn("was", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n")))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, h):
        before = F.slice(F.col("was"), acc["at"], F.greatest(h["old_start"] - acc["at"], F.lit(0)))
        return F.struct((h["old_start"] + h["old_lines"]).cast("int").alias("at"), F.concat(acc["out"], before, h["lines"]).alias("out"))

    done = F.aggregate("hunks", start, step)
    rows = rows.withColumn("done", F.when(F.col("hunks").isNotNull(), done))
    rest = F.slice("was", F.col("done.at"), F.greatest(F.size("was") - F.col("done.at") + 1, F.lit(0)))
    return rows.select("path", F.when(F.col("done").isNull(), F.col("text")).otherwise(F.array_join(F.concat("done.out", rest), "\n")).alias("text"))
