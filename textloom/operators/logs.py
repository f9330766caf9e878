"""Log processing in batch: entries are rows (pos, ts, pid, level, tag, msg), pos their order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order of levels, and the stage that a task's name belongs to, first match first; a list in a test
#: means that all of its words are in the name.
LEVELS = "VDIWE"
STAGES = (
    ("native C++", ("externalnativebuild", "cmake", "ndk")),
    ("annotation processing", ("kapt", "ksp")),
    ("Kotlin compile", (["compile", "kotlin"],)),
    ("Java compile", (["compile", "java"],)),
    ("R8 shrink", ("r8", "minify", "shrink", "proguard")),
    ("dexing", ("dex",)),
    ("lint", ("lint",)),
    ("tests", ("test",)),
    ("packaging", ("nativelibs", "strip", "package", "assemble", "bundle", "sign", "zipalign")),
    ("resources/manifest", ("manifest", "resource", "aapt", "databinding", "buildconfig", "metadata", "prebuild", "generate", "merge", "check")),
)


def parse_threadtime(line: Column) -> Column:
    """struct<time, pid, level, tag, msg> of a log line, or null (X24): five fields, the fifth a level letter, then
    the tag up to the first colon and blank."""
    head = r"^\s*\S+\s+(\S+)\s+(\S+)\s+\S+\s+([VDIWEFS])\s+"
    rest = F.regexp_replace(line, head, "")
    cut = F.instr(rest, ": ")
    tag = F.when(cut > 0, F.trim(F.substring(rest, F.lit(1), cut - 1))).otherwise(F.trim(F.regexp_replace(rest, ":+$", "")))
    msg = F.when(cut > 0, F.substring(rest, cut + 2, F.lit(1 << 30))).otherwise("")
    part = lambda i: F.regexp_extract(line, head, i)
    return F.when(line.rlike(head), F.struct(part(1).alias("time"), part(2).alias("pid"), part(3).alias("level"), tag.alias("tag"), msg.alias("msg")))


def keyword_list(asked: str) -> list[str]:
    """Keywords from a list with commas, which keeps phrases, or from words."""
    return [k for k in (x.strip() for x in (asked.split(",") if "," in asked else asked.split())) if k]


def has_keyword(keywords: list[str]) -> Column:
    """Any keyword in tag or message, in any case; no keywords are in everything (F16)."""
    text = F.lower(F.concat_ws(" ", F.coalesce("tag", F.lit("")), F.coalesce("msg", F.lit(""))))
    found = F.lit(not keywords)
    for k in keywords:
        found = found | F.contains(text, F.lit(k.lower()))
    return found


def level_rank(level: Column) -> Column:
    """V, D, I, W, E from 0; others above."""
    at = F.instr(F.lit(LEVELS), level)
    return F.when(at > 0, at - 1).otherwise(len(LEVELS))


def keyword_hits(log: DataFrame, keywords: list[str]) -> DataFrame:
    """(keyword, hits) of every keyword, also of those without hits."""
    counts = log.agg(*[F.count_if(has_keyword([k])).alias(f"k{i}") for i, k in enumerate(keywords)])
    pairs = F.array(*[F.struct(F.lit(k).alias("keyword"), F.col(f"k{i}").alias("hits")) for i, k in enumerate(keywords)])
    return counts.select(F.explode(pairs).alias("x")).select("x.keyword", "x.hits")


def collapsed(log: DataFrame, keys: list[str], same: tuple = ("tag", "msg", "level"), least: str = "V") -> DataFrame:
    """Runs of equal entries per key, after the level filter: first and last pos and their number."""
    order = Window.partitionBy(*keys).orderBy("pos")
    rows = log.where(level_rank(F.col("level")) >= level_rank(F.lit(least)))
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(order))
    starts = F.when(F.row_number().over(order) == 1, 1).otherwise(changed.cast("int"))
    rows = rows.withColumn("_start", starts).withColumn("_run", F.sum("_start").over(order))
    return rows.groupBy(*keys, "_run").agg(*[F.first(c).alias(c) for c in same], F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n")).drop("_run")


def stage_of(task: Column) -> Column:
    """The stage of a task, null if it has none."""
    name = F.lower(F.substring_index(task, ":", -1))
    out = F.lit(None).cast("string")
    for stage, tests in reversed(STAGES):
        hit = F.lit(False)
        for test in tests:
            every = F.lit(True)
            for word in test if isinstance(test, list) else [test]:
                every = every & F.contains(name, F.lit(word))
            hit = hit | every
        out = F.when(hit, stage).otherwise(out)
    return out


def stage_spans(rows: DataFrame, keys: list[str], order: list[str], ts: str = "ts", stage: str = "stage") -> DataFrame:
    """Spans of one stage per key (W5): a row without a stage keeps the one before; a span ends where the next begins,
    the last at the last row. (keys, stage, started, ended)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    filled = rows.withColumn("_s", F.last(stage, ignorenulls=True).over(w)).withColumn("_end", F.max(ts).over(Window.partitionBy(*keys))).where("_s IS NOT NULL")
    first = filled.withColumn("_before", F.lag("_s").over(w)).where("_before IS NULL OR _before <> _s")
    return first.select(*keys, F.col("_s").alias("stage"), F.col(ts).alias("started"), F.coalesce(F.lead(ts).over(w), F.col("_end")).alias("ended"))


def stage_totals(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Milliseconds per stage."""
    ms = F.floor((F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1000)
    return spans.groupBy(*keys, "stage").agg(F.sum(ms).alias("ms"))


def split_diagnostic(entry: Column) -> Column:
    """struct<location, message> (X27): split at : warning: or : error:, else at the first blank if the word before it is
    a place with a colon and a digit."""
    marked = r"^(.*?): (?:warning|error):(.*)$"
    place = r"^(\S*:\S*\d\S*|\S*\d\S*:\S*) (.*)$"
    parts = lambda p: F.struct(F.regexp_extract(entry, p, 1).alias("location"), F.trim(F.regexp_extract(entry, p, 2)).alias("message"))
    return F.when(entry.rlike(marked), parts(marked)).when(entry.rlike(place), parts(place)).otherwise(F.struct(F.lit("").alias("location"), entry.alias("message")))


def grouped_diagnostics(rows: DataFrame, most: int = 10) -> DataFrame:
    """(message, n, first, sample, more) per message (A18): most frequent first, ties as first seen; two places as a sample.
    Samples are minima of (pos, place), so no group is gathered."""
    sample = F.when(F.col("location") != "", F.struct("pos", "location"))
    found = rows.groupBy("message").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.min(sample).alias("a"))
    found = found.orderBy(F.desc("n"), "first").limit(most)  # a few messages, so the join for their second places is small
    second = rows.join(F.broadcast(found.select("message", F.col("a.pos").alias("p"))), "message").where("location <> '' AND pos > p").groupBy("message").agg(F.min(F.struct("pos", "location")).alias("b"))
    found = found.join(second, "message", "left").withColumn("sample", F.array_compact(F.array(F.col("a.location"), F.col("b.location"))))
    return found.select("message", "n", "first", "sample", (F.col("n") - F.size("sample")).alias("more")).orderBy(F.desc("n"), "first").limit(most)


def distinct_first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each entry once, where it was first seen."""
    return rows.groupBy(*keys).agg(F.min("pos").alias("first"))


def recording_seconds(asked: int | None = None) -> int:
    """The length of a recording: what is asked, from 10 to 60 s, or 20 s (M2)."""
    return min(max(20 if asked is None else asked, 10), 60)


def fixed_windows(log: DataFrame, seconds: int = 20) -> DataFrame:
    """Entries per window of so many seconds (M2). (start, n, errors)."""
    rows = log.groupBy(F.window("ts", f"{seconds} seconds")).agg(F.count("*").alias("n"), F.count_if(F.col("level").isin("E", "F")).alias("errors"))
    return rows.select(F.col("window.start").alias("start"), "n", "errors")


def idle_sessions(log: DataFrame, keys: list[str], gap_seconds: int) -> DataFrame:
    """Sessions that end when nothing comes for the gap (M3). (keys, start, last, n)."""
    return log.groupBy(*keys, F.session_window("ts", f"{gap_seconds} seconds")).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("session_window")


def stale(log: DataFrame, keys: list[str], now: Column, seconds: int) -> DataFrame:
    """(keys, updated, status): failed if the last entry is older than so many seconds, else running (M4)."""
    last = log.groupBy(*keys).agg(F.max("ts").alias("updated"))
    old = F.unix_micros(now) - F.unix_micros(F.col("updated").cast("timestamp")) > seconds * 1_000_000
    return last.withColumn("status", F.when(old, "failed").otherwise("running"))


def look_ahead(log: DataFrame, start: Column, n: int, keys: tuple = ("pid", "tag")) -> DataFrame:
    """The next n entries of the same keys behind each start (W14): (crash, pos, msg) with the start's pos. Entries are
    numbered per key and meet by equal number, so a start costs n rows, not a scan."""
    order = Window.partitionBy(*keys).orderBy("pos")
    rows = log.withColumn("_n", F.row_number().over(order)).withColumn("_start", start)
    starts = rows.where("_start").select(*keys, F.col("pos").alias("crash"), F.explode(F.sequence(F.col("_n") + 1, F.col("_n") + n)).alias("_n"))
    return starts.join(rows.select(*keys, "_n", "pos", "msg"), [*keys, "_n"]).select("crash", "pos", "msg")


def attributed(events: DataFrame, steps: DataFrame, hours: int = 24) -> DataFrame:
    """Events (event_id, ts) with the step (step_id, start, end) that ran then (M8). Steps are posted under each bucket of
    time that they touch, so it is a join on the bucket and a test, not one of all pairs."""
    width = hours * 3600
    bucket = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / width)
    posted = steps.select("step_id", "start", "end", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))).alias("bucket"))
    rows = events.select("event_id", "ts", bucket(F.col("ts")).alias("bucket"))
    return rows.join(posted, "bucket").where("ts >= start AND ts < end").select("event_id", "step_id")


def progress(running: DataFrame, past: DataFrame, keys: list[str]) -> DataFrame:
    """Percent done of what runs, by the size of past runs, at most 99 (M7). running: (keys, done); past: (keys, total)."""
    share = F.least(F.lit(99), F.floor(100 * F.col("done") / F.col("total"))).cast("int")
    return running.join(past, keys, "left").withColumn("pct", F.when(F.col("total") > 0, share))


def settled(frames: DataFrame, key: str, order: str, fingerprint: str) -> DataFrame:
    """The first place per key with three equal fingerprints in a row (M9)."""
    w = Window.partitionBy(key).orderBy(order)
    rows = frames.withColumn("_1", F.lag(fingerprint, 1).over(w)).withColumn("_2", F.lag(fingerprint, 2).over(w))
    rows = rows.where((F.col("_1") == F.col(fingerprint)) & (F.col("_2") == F.col(fingerprint)))
    return rows.groupBy(key).agg(F.min(order).alias(order))


def test_totals(lines: DataFrame, column: str = "line") -> DataFrame:
    """Sums of N passed, N failed, N ignored over all result lines."""
    count = lambda word: F.sum(F.coalesce(F.expr(f"try_cast(nullif(regexp_extract({column}, '([0-9]+) {word}', 1), '') AS bigint)"), F.lit(0)))
    return lines.where(F.col(column).rlike("[0-9]+ (passed|failed)")).agg(count("passed").alias("passed"), count("failed").alias("failed"), count("ignored").alias("ignored"))


def short_stat(line: Column) -> Column:
    """N files, +A -B from a summary of changes."""
    number = lambda word: F.coalesce(F.nullif(F.regexp_extract(line, rf"(\d+) {word}", 1), F.lit("")), F.lit("0"))
    files = number("file")
    return F.concat(files, F.when(files == "1", " file, +").otherwise(" files, +"), number("insertion"), F.lit(" -"), number("deletion"))
