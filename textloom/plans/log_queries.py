"""Log queries: events are log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as g
from ..sources.tables import LOG_SQL, load, log_entries
from .registry import query


@query(LOG_SQL + "SELECT pos, tag, msg FROM log WHERE contains(lower(tag || ' ' || msg), 'signup') OR contains(lower(tag || ' ' || msg), '\"k\": 42}')")
def log_keyword_filter(spark, sf_dir):
    return log_entries(spark, sf_dir).where(g.has_keyword(g.keyword_list('Signup, "k": 42}'))).select("pos", "tag", "msg")


@query(LOG_SQL + "SELECT pos, level, tag FROM log WHERE level IN ('W', 'E')")
def log_level_filter(spark, sf_dir):
    return log_entries(spark, sf_dir).where(g.level_rank(F.col("level")) >= g.level_rank(F.lit("W"))).select("pos", "level", "tag")


@query(LOG_SQL + "SELECT k AS keyword, count(*) FILTER (contains(lower(tag || ' ' || msg), k)) AS hits FROM log, (VALUES ('click'), ('error'), ('nothing')) v(k) GROUP BY k")
def keyword_hits(spark, sf_dir):
    return g.keyword_hits(log_entries(spark, sf_dir), ["click", "error", "nothing"])


@query(
    LOG_SQL
    + """, s AS (SELECT *, CASE WHEN tag IS NOT DISTINCT FROM lag(tag) OVER w AND level IS NOT DISTINCT FROM lag(level) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS st FROM log WINDOW w AS (PARTITION BY pid ORDER BY pos)),
    r AS (SELECT *, sum(st) OVER (PARTITION BY pid ORDER BY pos) AS run FROM s)
    SELECT pid, any_value(tag) AS tag, any_value(level) AS level, min(pos) AS first, max(pos) AS last, count(*) AS n FROM r GROUP BY pid, run"""
)
def run_collapse(spark, sf_dir):
    return g.collapsed(log_entries(spark, sf_dir), ["pid"], same=("tag", "level"))


def _stages(spark, sf_dir):
    stage = F.when(F.col("tag") == "signup", "setup").when(F.col("tag") == "purchase", "packaging").when(F.col("tag") == "error", "repair")
    return log_entries(spark, sf_dir).withColumn("stage", stage)


_STAGES = (
    LOG_SQL
    + """, s AS (SELECT *, CASE tag WHEN 'signup' THEN 'setup' WHEN 'purchase' THEN 'packaging' WHEN 'error' THEN 'repair' END AS stage, max(ts) OVER (PARTITION BY pid) AS fin FROM log),
    f AS (SELECT *, last_value(stage IGNORE NULLS) OVER (PARTITION BY pid ORDER BY ts, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st FROM s),
    c AS (SELECT *, lag(st) OVER (PARTITION BY pid ORDER BY ts, pos) AS prev FROM f WHERE st IS NOT NULL),
    span AS (SELECT pid, st AS stage, ts AS started, coalesce(lead(ts) OVER (PARTITION BY pid ORDER BY ts, pos), fin) AS ended FROM c WHERE prev IS NULL OR prev <> st) """
)


@query(_STAGES + "SELECT pid, stage, CAST(sum((epoch_us(ended) - epoch_us(started)) // 1000) AS BIGINT) AS ms FROM span GROUP BY ALL")
def stage_durations(spark, sf_dir):
    return g.stage_totals(g.stage_spans(_stages(spark, sf_dir), ["pid"], ["ts", "pos"]), ["pid"])


@query(_STAGES + "SELECT pid, stage, min(started) AS started FROM span GROUP BY ALL")
def stage_first_task(spark, sf_dir):
    return g.stage_spans(_stages(spark, sf_dir), ["pid"], ["ts", "pos"]).groupBy("pid", "stage").agg(F.min("started").alias("started"))


TASKS = ["compileDebugKotlin", "kspDebug", "mergeDexDebug", "preBuild", "externalNativeBuildDebug", "hello", "packageRelease"]


@query(
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Kotlin compile' WHEN 1 THEN 'annotation processing' WHEN 2 THEN 'dexing' WHEN 3 THEN 'resources/manifest'
    WHEN 4 THEN 'native C++' WHEN 6 THEN 'packaging' END AS stage FROM events"""
)
def stage_of_task(spark, sf_dir):
    """Events as tasks of a module named by their type."""
    task = F.concat(F.lit(":"), "event_type", F.lit(":"), F.get(F.array(*map(F.lit, TASKS)), (F.col("event_id") % 7).cast("int")))
    return load(spark, sf_dir, "events").select("event_id", g.stage_of(task).alias("stage"))


@query(LOG_SQL + "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, count(*) FILTER (level = 'E') AS errors FROM log GROUP BY 1")
def fixed_window_20s(spark, sf_dir):
    """The recording window of 20 s, scaled to six hours for a month of events."""
    return g.fixed_windows(log_entries(spark, sf_dir), 6 * 3600)


@query(
    LOG_SQL
    + """, s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS st FROM log WINDOW w AS (PARTITION BY pid ORDER BY ts, pos)),
    r AS (SELECT *, sum(st) OVER (PARTITION BY pid ORDER BY ts, pos) AS k FROM s) SELECT pid, min(ts) AS start, max(ts) AS last, count(*) AS n FROM r GROUP BY pid, k"""
)
def idle_sessions(spark, sf_dir):
    """Sessions that end after half an hour, scaled to twelve hours."""
    return g.idle_sessions(log_entries(spark, sf_dir), ["pid"], 12 * 3600)


@query(LOG_SQL + "SELECT pid, max(ts) AS updated, CASE WHEN TIMESTAMP '2024-01-31' - max(ts) > INTERVAL 12 HOUR THEN 'failed' ELSE 'running' END AS status FROM log GROUP BY pid")
def stale_status(spark, sf_dir):
    return g.stale(log_entries(spark, sf_dir), ["pid"], F.lit("2024-01-31").cast("timestamp"), 12 * 3600)


@query(
    LOG_SQL
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY pos) AS rn FROM log)
    SELECT a.pos AS crash, b.pos, b.msg FROM n a JOIN n b ON a.pid = b.pid AND b.rn > a.rn AND b.rn <= a.rn + 7 WHERE a.level = 'E' AND a.msg = '{"k": 7}'"""
)
def crash_lookahead(spark, sf_dir):
    start = (F.col("level") == "E") & (F.col("msg") == '{"k": 7}')
    return g.look_ahead(log_entries(spark, sf_dir), start, 7, keys=("pid",))


@query(
    """WITH steps AS (SELECT o_orderkey AS step_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (o_orderkey * 7) AS start, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (o_orderkey * 7 + 9) AS fin FROM orders)
    SELECT event_id, step_id FROM events JOIN steps ON ts >= start AND ts < fin"""
)
def step_attribution(spark, sf_dir):
    hour = lambda h: F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + 3600 * h)
    key = F.col("o_orderkey")
    steps = load(spark, sf_dir, "orders").select(key.alias("step_id"), hour(key * 7).alias("start"), hour(key * 7 + 9).alias("end"))
    return g.attributed(load(spark, sf_dir, "events"), steps)


@query(
    """WITH d AS (SELECT event_id AS pos, 'u' || user_id || '.kt:' || (event_id % 90) AS location, event_type || ' ' || props AS message FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY message ORDER BY pos) AS k FROM d)
    SELECT message, count(*) AS n, min(pos) AS first, string_agg(location, ', ' ORDER BY pos) FILTER (k <= 2) AS sample, count(*) - count(*) FILTER (k <= 2) AS more FROM r GROUP BY message ORDER BY n DESC, first LIMIT 10"""
)
def grouped_diagnostics(spark, sf_dir):
    entry = F.concat(F.lit("u"), "user_id", F.lit(".kt:"), F.col("event_id") % 90, F.lit(" "), "event_type", F.lit(" "), "props")
    rows = load(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), g.split_diagnostic(entry).alias("d")).select("pos", "d.*")
    return g.grouped_diagnostics(rows).withColumn("sample", F.array_join("sample", ", ")).withColumn("more", F.col("more").cast("long"))


@query("SELECT role, text, min(conv_id * 1000 + turn) AS first FROM conversations GROUP BY role, text")
def distinct_first_seen(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").withColumn("pos", F.col("conv_id") * 1000 + F.col("turn"))
    return g.distinct_first(rows, ["role", "text"])


@query(
    """WITH p AS (SELECT o_orderpriority, count(*) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), r AS (SELECT o_orderpriority, count(*) AS done FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0 GROUP BY 1)
    SELECT o_orderpriority, done, total, CAST(least(99, floor(100 * done / total)) AS INTEGER) AS pct FROM r LEFT JOIN p USING (o_orderpriority)"""
)
def estimate_progress(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    count = lambda cond, name: orders.where(cond).groupBy("o_orderpriority").agg(F.count("*").alias(name))
    return g.progress(count("o_orderstatus = 'P' AND o_orderkey % 2 = 0", "done"), count("o_orderstatus = 'F'", "total"), ["o_orderpriority"])


@query("SELECT user_id, min(event_id) AS event_id FROM (SELECT *, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type = a AND a = b GROUP BY user_id")
def settle_detection(spark, sf_dir):
    return g.settled(load(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query(
    LOG_SQL
    + """SELECT pos, strftime(ts, '%H:%M:%S.%g') AS time, CAST(pid AS VARCHAR) AS pid, level, tag, CASE WHEN pos % 3 = 0 THEN '' ELSE msg END AS msg FROM log WHERE pos % 5 <> 4"""
)
def threadtime_parse(spark, sf_dir):
    """Events as lines of a log; every fifth line has another form, every third no message."""
    log = log_entries(spark, sf_dir)
    head = F.concat(F.date_format("ts", "MM-dd HH:mm:ss.SSS"), F.lit("  "), "pid", F.lit("   7 "), F.when(F.col("pos") % 5 == 4, "X").otherwise(F.col("level")), F.lit(" "), "tag")
    line = F.concat(head, F.when(F.col("pos") % 3 == 0, ":").otherwise(F.concat(F.lit(" : "), "msg")))
    rows = log.select("pos", g.parse_threadtime(line).alias("e"))
    return rows.where("e IS NOT NULL").select("pos", "e.*")