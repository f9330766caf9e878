"""Text edits over tables of files (path, content): match strategies, batches, line edits, replacing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bigrams, break_counts, is_crlf, numbered, with_endings


def occurrences(text: Column, part: str) -> Column:
    """How often a non-empty part occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def _literal(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def plan(content: Column, old: str, new: str) -> Column:
    """struct<strategy, matches, result> of replacing old by new, or null if old is not there.

    The strictest strategy that matches decides: the exact text, then line breaks of either kind, then the text without
    surrounding white space. The replacement takes the file's kind of line breaks, or the match's.
    """
    crlf = is_crlf(content)
    trimmed = old.strip()
    made = lambda name, n, result: F.struct(F.lit(name).alias("strategy"), n.alias("matches"), result.alias("result"))
    exact = occurrences(content, old)
    out = F.when(exact > 0, made("exact_match", exact, F.replace(content, F.lit(old), with_endings(F.lit(new), crlf))))
    if "\n" in old:
        pattern = r"\r?\n".join(_literal(x) for x in old.replace("\r\n", "\n").split("\n"))
        loose = F.regexp_count(content, F.lit(pattern))
        ends = F.contains(F.regexp_extract(content, pattern, 0), F.lit("\r\n"))
        safe = F.replace(F.replace(with_endings(F.lit(new), ends), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        out = out.when(loose > 0, made("crlf_normalized", loose, F.regexp_replace(content, F.lit(pattern), safe)))
    if trimmed:
        n = occurrences(content, trimmed)
        out = out.when(n > 0, made("trimmed_match", n, F.replace(content, F.lit(trimmed), with_endings(F.lit(new.strip()), crlf))))
    return out


def patch(files: DataFrame, old: str, new: str, replace_all: bool = False, text: str = "content") -> DataFrame:
    """Files with strategy, matches, status and result (R3): ok, not_found, ambiguous if there are several matches and not
    all are asked for, or refused if there is nothing to look for; the result of what is not ok is the text as it was."""
    rows = files.withColumn("_p", plan(F.col(text), old, new) if old else F.lit(None).cast("struct<strategy:string,matches:int,result:string>"))
    status = F.when(F.lit(not old), "refused").when(F.col("_p").isNull(), "not_found").when((F.col("_p.matches") > 1) & F.lit(not replace_all), "ambiguous").otherwise("ok")
    rows = rows.withColumn("strategy", F.col("_p.strategy")).withColumn("matches", F.coalesce("_p.matches", F.lit(0))).withColumn("status", status)
    return rows.withColumn("result", F.when(F.col("status") == "ok", F.col("_p.result")).otherwise(F.col(text))).drop("_p")


def _times(text: Column, part: Column) -> Column:
    """How often a part occurs; null if the part is empty."""
    return (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.nullif(F.length(part), F.lit(0))


def apply_in_turn(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, result, applied, failed_at): ordered blocks (path, ord, old, new) applied in turn to each file up to the first that
    finds no text or an ambiguous one, whose ord is failed_at; what went before stays (R9)."""
    blocks = edits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ord", "old", "new"))).alias("blocks"))
    rows = files.join(blocks, "path")
    start = F.struct(F.col("content").alias("text"), F.lit(0).alias("applied"), F.lit(None).cast(edits.schema["ord"].dataType).alias("failed_at"))

    def step(acc: Column, b: Column) -> Column:
        good = acc["failed_at"].isNull() & F.coalesce(_times(acc["text"], b["old"]) == 1, F.lit(False))
        text = F.when(good, F.replace(acc["text"], b["old"], b["new"])).otherwise(acc["text"])
        failed = F.when(good, F.lit(None)).otherwise(F.coalesce(acc["failed_at"], b["ord"]))
        return F.struct(text.alias("text"), (acc["applied"] + F.when(good, 1).otherwise(0)).cast("int").alias("applied"), failed.cast(edits.schema["ord"].dataType).alias("failed_at"))

    return rows.withColumn("done", F.aggregate("blocks", start, step)).select("path", F.col("done.text").alias("result"), "done.applied", "done.failed_at")


def match_lines(content: Column, part: str) -> Column:
    """The lines, from 1, on which the occurrences of a non-empty part start."""
    pieces = F.split(content, _literal(part), -1)
    inside = part.count("\n")
    zero = F.struct(F.lit(1).alias("line"), F.array().cast("array<int>").alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        line = (acc["line"] + F.regexp_count(piece, F.lit("\n"))).cast("int")
        return F.struct((line + inside).cast("int").alias("line"), F.concat(acc["found"], F.array(line)).alias("found"))

    return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), zero, step)["found"]


def preview(files: DataFrame, old: str, new: str, text: str = "content", around: int = 1) -> DataFrame:
    """Files that an edit would change, without changing them (R4): lines of the matches, and the lines around the first one before and
    after. Of files that match only with tolerant line ends or trimmed, the match is the first line that differs."""
    rows = patch(files, old, new, True, text).where("status = 'ok'")
    rows = rows.withColumn("_a", F.split(text, "\n")).withColumn("_b", F.split("result", "\n"))
    rows = rows.withColumn("_head", F.array_position(F.zip_with("_a", "_b", lambda a, b: ~a.eqNullSafe(b)), True).cast("int")).where("_head > 0")
    first = F.greatest(F.col("_head") - around, F.lit(1))
    cut = lambda c, extra: F.array_join(F.slice(c, first, F.lit(1 + extra.count("\n")) + F.col("_head") - first + around), "\n")
    lines = F.when(F.contains(text, F.lit(old)), match_lines(F.col(text), old)).otherwise(F.array("_head"))
    return rows.select(*[c for c in files.columns if c != text], lines.alias("lines"), cut("_a", old).alias("before"), cut("_b", new).alias("after"))


def hints(files: DataFrame, old: str, text: str = "content", least: float = 0.6) -> DataFrame:
    """For files in which an edit finds no text (R5): the line that resembles the first line looked for most, by Dice of bigrams, and
    whether line breaks are mixed. (path, line, line_text, dice, mixed)"""
    from ..sources.tables import lines

    probe = old.strip("\n").split("\n")[0]
    missing = patch(files, old, "", True, text).where("status = 'not_found'").select("path", F.col(text).alias("_text"))
    breaks = break_counts(F.col("_text"))
    rows = lines(missing.withColumn("mixed", (breaks["crlf"] > 0) & (breaks["lf"] > 0)), "_text")
    rows = rows.where(F.length("line_text").between(int(len(probe) / 2), 2 * len(probe)))
    rows = rows.withColumn("_a", F.array_sort(bigrams(F.lit(probe)))).withColumn("_b", F.array_sort(bigrams(F.col("line_text"))))
    rows = rows.withColumn("dice", 2.0 * F.size(F.array_intersect(numbered("_a"), numbered("_b"))) / (F.size("_a") + F.size("_b"))).where(F.col("dice") >= least)
    return rows.groupBy("path").agg(F.min_by(F.struct("line", "line_text", "dice", "mixed"), F.struct((-F.col("dice")).alias("d"), "line")).alias("x")).select("path", "x.*")


def put(files: DataFrame, rows: DataFrame, only_new: bool = False) -> DataFrame:
    """Files with others (path, content) written over them or beside them; with only_new, those that exist stay."""
    if only_new:
        return files.unionByName(rows.join(files, "path", "left_anti"))
    return files.join(rows, "path", "left_anti").unionByName(rows)


def appended(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Files with texts (path, content) at their ends, on a line of their own; new files where there are none."""
    more = rows.select("path", F.col("content").alias("_more"))
    both = files.join(more, "path", "full_outer")
    gap = F.when(F.endswith("content", F.lit("\n")) | (F.col("content") == ""), "").otherwise("\n")
    return both.select("path", F.when(F.col("_more").isNull(), F.col("content")).when(F.col("content").isNull(), F.col("_more")).otherwise(F.concat("content", gap, "_more")).alias("content"))


def moved_to(files: DataFrame, old: str, new: str, copy: bool = False) -> DataFrame:
    """Files with a file or folder under another name, or copied to it (R10). A name that is taken keeps its file."""
    inside = (F.col("path") == old) | F.startswith("path", F.lit(old + "/"))
    named = files.where(inside).withColumn("path", F.concat(F.lit(new), F.substring("path", len(old) + 1, 1 << 20)))
    left = files if copy else files.where(~inside)
    return put(left, named, only_new=True)


def without(files: DataFrame, name: str) -> DataFrame:
    """Files without a file or folder."""
    return files.where(~((F.col("path") == name) | F.startswith("path", F.lit(name + "/"))))


def apply_blocks(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, content, result, failed): ordered blocks (path, ord, old, new) applied in turn to each file, and all files or
    none (R6): if any block finds no text or an ambiguous one, every result is the content as it was. A block for a path
    without file fails as well, and so does one without anything to look for. The fold is per file, over that file's blocks."""
    blocks = edits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ord", "old", "new"))).alias("blocks"))
    both = files.join(blocks, "path", "full_outer")
    start = F.struct(F.col("content").alias("text"), F.when(F.col("content").isNull(), 1).otherwise(0).alias("failed"))

    def step(acc: Column, b: Column) -> Column:
        good = F.coalesce(_times(acc["text"], b["old"]) == 1, F.lit(False))
        return F.struct(F.when(good, F.replace(acc["text"], b["old"], b["new"])).otherwise(acc["text"]).alias("text"), (acc["failed"] + F.when(good, 0).otherwise(1)).cast("int").alias("failed"))

    rows = both.withColumn("done", F.aggregate(F.coalesce("blocks", F.array().cast(both.schema["blocks"].dataType)), start, step)).where("content IS NOT NULL OR blocks IS NOT NULL")
    gate = rows.agg(F.sum("done.failed").alias("failed_blocks"), F.lit(1).alias("one"))
    rows = rows.withColumn("one", F.lit(1)).join(F.broadcast(gate), "one")  # one row
    return rows.select("path", "content", F.when(F.col("failed_blocks") == 0, F.col("done.text")).otherwise(F.col("content")).alias("result"), F.col("done.failed").alias("failed"))


def replace_all(files: DataFrame, old: str, new: str, text: str = "content") -> DataFrame:
    """Files that hold a text, with the count and the result."""
    rows = files.where(F.contains(text, F.lit(old))).withColumn("n", occurrences(F.col(text), old))
    return rows.withColumn("result", F.replace(F.col(text), F.lit(old), F.lit(new)))


def edit_line(text: Column, line: int, action: str, new: str = "", expect: str | None = None) -> Column:
    """A text with one line replaced, deleted, or with a line inserted before or after it; null if there is no such line
    or it is not what is expected (R8)."""
    rows = F.split(text, "\n")
    before, after = F.slice(rows, F.lit(1), F.lit(line - 1)), F.slice(rows, F.lit(line + 1), F.greatest(F.size(rows) - line, F.lit(0)))
    here, added = F.slice(rows, F.lit(line), F.lit(1)), F.array(F.lit(new))
    parts = {"replace": [added], "delete": [], "before": [added, here], "after": [here, added]}[action]
    result = F.array_join(F.concat(before, *parts, after), "\n")
    good = F.size(rows) >= line
    if expect is not None:
        good = good & (F.trim(F.get(rows, F.lit(line - 1))) == expect.strip())
    return F.when(good, result)


def read_range(rows: DataFrame, first: int, second: int | None = None, full: bool = False) -> DataFrame:
    """A window of numbered lines (X16): a second number above the first is the last line, else a count; at most 200 lines, or 600
    of a full read."""
    most = 600 if full else 200
    last = first + 119 if second is None else second if second > first else first + second - 1
    return rows.where(F.col("line").between(first, min(last, first + most - 1)))


def range_spec(spec: str) -> tuple[str, int | None, int | None]:
    """file#L10-20, file:10-20 or file#L5 as (file, first, last)."""
    m = re.fullmatch(r"(.*?)(?:#L|:)(\d+)(?:-L?(\d+))?", spec)
    return (m[1], int(m[2]), int(m[3] or m[2])) if m else (spec, None, None)
