"""Streaming queries over event files, run to their end."""

from __future__ import annotations

from ..operators.storage import scratch
from ..sources.tables import LOG_SQL
from ..streaming import recorder as r
from .registry import query


def _folder(spark):
    return scratch(spark, "stream")


@query(LOG_SQL + "SELECT pos, pid, level, tag, msg FROM log WHERE contains(lower(tag || ' ' || msg), 'signup') OR contains(lower(tag || ' ' || msg), 'error')")
def stream_keyword_filter(spark, sf_dir):
    rows = r.recorded(r.read_events(spark, f"{sf_dir}/events.parquet"), ["Signup", "error"])
    return r.run_to(rows, _folder(spark)).select("pos", "pid", "level", "tag", "msg")


@query(
    LOG_SQL
    + """, w AS (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, count(*) FILTER (level = 'E') AS errors FROM log GROUP BY 1)
    SELECT strftime(start, '%Y-%m-%d') AS start, n, errors FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM log) - INTERVAL 1 HOUR"""
)
def stream_windows(spark, sf_dir):
    """Day windows that the watermark has closed by the end of the stream."""
    from pyspark.sql import functions as F

    rows = r.run_to(r.windows(r.read_events(spark, f"{sf_dir}/events.parquet", 1000), 86_400), _folder(spark))
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query(
    LOG_SQL
    + """, s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS st FROM log WINDOW w AS (PARTITION BY pid ORDER BY ts, pos)),
    r AS (SELECT *, sum(st) OVER (PARTITION BY pid ORDER BY ts, pos) AS k FROM s), g AS (SELECT pid, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM r GROUP BY pid, k)
    SELECT pid, epoch_us(start) // 1000000 AS start, epoch_us("end") // 1000000 AS "end", n FROM g WHERE "end" <= (SELECT max(ts) FROM log) - INTERVAL 1 HOUR"""
)
def stream_sessions(spark, sf_dir):
    """Idle sessions that the watermark has closed by the end of the stream, in whole seconds."""
    from pyspark.sql import functions as F

    rows = r.run_to(r.sessions(r.read_events(spark, f"{sf_dir}/events.parquet", 1000), 12 * 3600), _folder(spark))
    return rows.select("pid", F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"), "n")


#: Stages of the progress queries by event type; other events keep the stage before.
STAGES = {"signup": "setup", "purchase": "pay", "error": "failed"}


@query(
    LOG_SQL
    + """, s AS (SELECT *, CASE tag WHEN 'signup' THEN 'setup' WHEN 'purchase' THEN 'pay' WHEN 'error' THEN 'failed' END AS stage,
      CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS st FROM log WINDOW w AS (PARTITION BY pid ORDER BY ts, pos)),
    r AS (SELECT *, sum(st) OVER (PARTITION BY pid ORDER BY ts, pos) AS k, max(ts) OVER () AS latest FROM s),
    g AS (SELECT pid, k, min(ts) AS first, max(ts) AS last, count(*) AS entries, count(*) FILTER (level = 'E') AS errors, count(*) FILTER (level = 'W') AS warnings,
      coalesce(last(stage ORDER BY ts, pos) FILTER (stage IS NOT NULL), '') AS stage, any_value(latest) AS latest, max(k) OVER (PARTITION BY pid) AS final FROM r GROUP BY pid, k)
    SELECT pid, epoch_us(first) AS start, epoch_us(last) AS "end", entries, errors, warnings, stage FROM g
    WHERE k < final OR epoch_us(last) // 1000 + 6 * 3600000 < epoch_us(latest) // 1000 - 600000"""
)
def stream_progress(spark, sf_dir):
    """Episodes of users that have ended by the end of the stream: six hours without an event."""
    from pyspark.sql import functions as F

    events = r.read_events(spark, f"{sf_dir}/events.parquet", 1000)
    stage = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])[F.col("tag")]
    rows = r.run_to(r.progress(events.withColumn("stage", stage), 6 * 3600 * 1000), _folder(spark))
    return rows.select("pid", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "entries", "errors", "warnings", "stage")
