"""Logs as streams: the keyword recorder, windows, idle sessions and progress by key."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.logs import has_keyword


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files as a stream of log entries (S10). The path is a folder of files, or one file, which is its folder's only one
    by that name."""
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        path, _, name = path.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    rows = reader.parquet(path)
    level = F.when(F.col("event_type") == "error", "E").when(F.col("event_type") == "purchase", "W").otherwise("I")
    return rows.select(F.col("event_id").alias("pos"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("pid"), level.alias("level"), F.col("event_type").alias("tag"), F.col("props").alias("msg"))


def recorded(stream: DataFrame, keywords: list[str]) -> DataFrame:
    """Entries with a keyword (M1)."""
    return stream.where(has_keyword(keywords))


def run_to(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, into Parquet with a checkpoint beside it, and read the result. A later run goes on
    where this one ended (M5)."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def windows(stream: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """Entries and errors per fixed window (M2)."""
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds")).agg(F.count("*").alias("n"), F.count_if(F.col("level").isin("E", "F")).alias("errors"))
    return rows.select(F.col("window.start").alias("start"), "n", "errors")


def sessions(stream: DataFrame, gap_seconds: int, late: str = "1 hour") -> DataFrame:
    """Entries per key and idle session (M3)."""
    rows = stream.withWatermark("ts", late).groupBy("pid", F.session_window("ts", f"{gap_seconds} seconds")).agg(F.count("*").alias("n"))
    return rows.select("pid", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


#: Milliseconds of event time after which a silent key is idle (M3).
IDLE = 30 * 60 * 1000
EPISODE = "pid long, start timestamp, end timestamp, entries long, errors long, warnings long, stage string"


def _episode(key: tuple, state: tuple) -> tuple:
    first, last, entries, errors, warnings, stage = state
    return (*key, pd.Timestamp(first, unit="us", tz="UTC"), pd.Timestamp(last, unit="us", tz="UTC"), entries, errors, warnings, stage)


def _advance(idle: int, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ended: list[tuple] = []
    if state.hasTimedOut:
        ended.append(_episode(key, state.get))
        state.remove()
    else:
        held = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "pos"])
        times = rows["ts"].astype("datetime64[us, UTC]" if rows["ts"].dt.tz else "datetime64[us]").astype("int64")
        for at, level, stage in zip(times, rows["level"], rows["stage"], strict=True):
            if held is not None and at - held[1] > idle * 1000:
                ended.append(_episode(key, held))
                held = None
            first, last, entries, errors, warnings, named = held or (at, at, 0, 0, 0, "")
            held = (min(first, at), max(last, at), entries + 1, errors + (level == "E"), warnings + (level == "W"), named if pd.isna(stage) else stage)
        state.update(tuple(x if isinstance(x, str) else int(x) for x in held))
        # the first watermark past this time finds the key idle; one that is past it already does so in its next batch
        state.setTimeoutTimestamp(max(held[1] // 1000 + idle, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(ended, columns=[c.split()[0] for c in EPISODE.split(", ")])


def progress(stream: DataFrame, idle: int = IDLE, late: str = "10 minutes") -> DataFrame:
    """What each key did from its first entry until idle milliseconds of event time passed without one (M6): counts and the
    last stage, from rows (pid, pos, ts, level, stage). Entries without a stage keep the one before.

    A row comes when an episode has ended: when a later entry of the key shows it, or when the watermark passes, which also
    takes the key out of the state. So the state holds the keys of the last idle + late of event time, whatever the stream's
    length, and a run over what there is ends; keys that are not idle by its end stay for the next run. Entries that come
    behind the watermark are dropped, as in every operator with one. Null keys are one key.
    """
    rows = stream.withWatermark("ts", late)
    held = "first long, last long, entries long, errors long, warnings long, stage string"
    return rows.groupBy("pid").applyInPandasWithState(partial(_advance, idle), EPISODE, held, "append", GroupStateTimeout.EventTimeTimeout)
