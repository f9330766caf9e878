"""Output of build tools as tables: rows (pos, line) of a log, in the order of pos within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines that sum up other diagnostics and are none of their own.
ROLL_UPS = ("warning: `", "error: could not compile", "error: aborting", "warning: build failed")


def severity(line: Column) -> Column:
    """error or warning if a line of Kotlin, C, Rust or TypeScript tools reports one, else null."""
    text = F.trim(line)
    starts = lambda *heads: _any(F.startswith(text, F.lit(h)) for h in heads)
    error = starts("e: ", "error:", "error[") | F.contains(text, F.lit(": error:")) | F.contains(text, F.lit(": fatal error:")) | F.contains(text, F.lit("error TS"))
    warning = starts("w: ", "warning:") | F.contains(text, F.lit(": warning:"))
    return F.when(starts(*ROLL_UPS), F.lit(None)).when(error, "error").when(warning, "warning")


def _any(tests) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def paired_headers(log: DataFrame, keys: list[str], line: str = "line", order: str = "pos") -> DataFrame:
    """(keys, pos, severity, location, message): headers with the place that a line behind them names by an arrow (W17). A
    header that another one follows first has no place; each entry is once, where it was first seen."""
    w = Window.partitionBy(*keys).orderBy(order)
    text = F.trim(line)
    arrow = F.startswith(text, F.lit("-->"))
    kind = F.when(F.startswith(text, F.lit("error")), "error").when(F.startswith(text, F.lit("warning")), "warning")
    kind = F.when(_any(F.startswith(text, F.lit(r)) for r in ROLL_UPS), F.lit(None)).otherwise(kind)
    rows = log.select(*keys, F.col(order).alias("pos"), text.alias("_t"), arrow.alias("_a"), kind.alias("_k")).where("_a OR _k IS NOT NULL")
    w = Window.partitionBy(*keys).orderBy("pos")
    place = F.when(F.lead("_a").over(w), F.trim(F.substring(F.lead("_t").over(w), 4, 1 << 20)))
    heads = rows.withColumn("location", place).where("_k IS NOT NULL")
    return heads.groupBy(*keys, F.col("_k").alias("severity"), F.coalesce("location", F.lit("")).alias("location"), F.col("_t").alias("message")).agg(F.min("pos").alias("pos"))


def relative(text: Column, root: str) -> Column:
    """A text with the root folder cut from its paths, in any case and with either slash."""
    parts = [p for p in root.replace("\\", "/").split("/") if p]
    sign = lambda p: "".join(c if c.isalnum() or c == "_" else "\\" + c for c in p)
    lead = r"[/\\]" if root.startswith(("/", "\\")) else ""
    return F.regexp_replace(text, "(?i)" + lead + r"[/\\]".join(map(sign, parts)) + r"[/\\]", "")


def without_ansi(text: Column) -> Column:
    """A text without terminal colours and other escape sequences."""
    return F.regexp_replace(text, r"\x1B\[[0-9;?]*[A-Za-z]", "")


def served_url(text: Column) -> Column:
    """The url a dev server prints: the first local one, else the first."""
    urls = F.transform(F.regexp_extract_all(without_ansi(text), F.lit(r"(https?://[^\s\"'<>)]+)"), 1), lambda u: F.regexp_replace(u, r"[.,;]+$", ""))
    local = F.filter(urls, lambda u: u.rlike(r"^https?://(localhost|127\.0\.0\.1)(:|/|$)"))
    return F.coalesce(F.get(local, F.lit(0)), F.get(urls, F.lit(0)))


def port(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/:]+:(\d+)", 1).try_cast("int")


def deploy_url(output: Column, keys: tuple = ("url", "deploy_url", "inspectorUrl")) -> Column:
    """The address a deployment reports: a field of its JSON, else the last url of its text."""
    fields = [F.get_json_object(output, f"$.{k}") for k in keys]
    return F.coalesce(*fields, F.try_element_at(F.regexp_extract_all(output, F.lit(r"(https://[^\s\"']+)"), 1), F.lit(-1)))


def number_after(text: Column, words: str) -> Column:
    """The first whole number behind words such as TotalTime:."""
    return F.regexp_extract(text, words + r"\s*:?\s*(\d+)", 1).try_cast("long")


def frame_stats(text: Column) -> Column:
    """struct<frames, janky, janky_percent> of a frame report."""
    return F.struct(
        number_after(text, "Total frames rendered").alias("frames"), number_after(text, "Janky frames").alias("janky"),
        F.regexp_extract(text, r"Janky frames:\s*\d+\s*\(([0-9.]+)%\)", 1).try_cast("double").alias("janky_percent"),
    )


def failure_blocks(log: DataFrame, keys: list[str], start: Column, end: Column, line: str = "line", order: str = "pos") -> DataFrame:
    """(keys, block, first, last, head, rows): stretches from a start line up to the next start or end line."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = log.withColumn("_s", start).withColumn("_b", F.sum(F.when(F.col("_s"), 1).otherwise(0)).over(w))
    closed = F.max(F.when(end & ~F.col("_s"), 1).otherwise(0)).over(Window.partitionBy(*keys, "_b").orderBy(order))
    rows = rows.withColumn("_c", closed).where("_b > 0 AND _c = 0")
    return rows.groupBy(*keys, F.col("_b").alias("block")).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.min_by(line, order).alias("head"), F.count("*").alias("rows")).drop("block")


def reasons(log: DataFrame, start: Column, reason: Column, within: int, keys: tuple = ("pid",)) -> DataFrame:
    """(crash, pos, msg): for each start the first row with a reason among the next rows of its keys."""
    from .logs import look_ahead

    near = look_ahead(log, start, within, keys)
    return near.where(reason).groupBy("crash").agg(F.min(F.struct("pos", "msg")).alias("x")).select("crash", "x.pos", "x.msg")


def same_keywords(a: Column, b: Column) -> Column:
    """Whether two keyword lists are equal as sets, in any case."""
    norm = lambda c: F.array_sort(F.array_distinct(F.transform(c, F.lower)))
    return norm(a) == norm(b)


def of_package(log: DataFrame, package: str, column: str = "msg") -> DataFrame:
    """Log rows that name a package."""
    return log.where(F.contains(F.col(column), F.lit(package)))
