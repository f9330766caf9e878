"""The driver's tables, and the views on them that the operators read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(df: DataFrame, text: str = "text", first: int = 1) -> DataFrame:
    """One row per line: the other columns, line (from 1) and line_text, without a carriage return at its end. The
    empty line after a final line feed is none."""
    parts = F.split(F.col(text), "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    rows = df.select(*[c for c in df.columns if c != text], F.posexplode(parts).alias("line", "line_text"))
    return rows.withColumn("line", F.col("line") + first).withColumn("line_text", F.regexp_replace("line_text", r"\r\z", ""))


def url_path(url: Column) -> Column:
    """A url as a relative path: host/segments, without query, fragment and the slash at the end."""
    return F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://([^?#]*)", 1), r"/+$", "")


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, path, size): pages as files of a tree."""
    return load(spark, sf_dir, "pages").select("page_id", url_path(F.col("url")).alias("path"), F.length("html").cast("long").alias("size"))


def document_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, size): documents as files source/lang/doc.txt."""
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id"), F.lit(".txt"))).alias("path"), F.col("n_chars").cast("long").alias("size"))


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines: (pos, ts, pid, level, tag, msg). Errors are E, purchases W, the rest I."""
    events = load(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "E").when(F.col("event_type") == "purchase", "W").otherwise("I")
    return events.select(F.col("event_id").alias("pos"), "ts", F.col("user_id").alias("pid"), level.alias("level"), F.col("event_type").alias("tag"), F.col("props").alias("msg"))


#: The same views as SQL, to start an oracle with.
LINES_SQL = r"""WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
kept AS (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM parts),
lines AS (SELECT doc_id, CAST(unnest(range(1, len(p) + 1)) AS INTEGER) AS line, rtrim(unnest(p), chr(13)) AS line_text FROM kept)
"""
PAGE_SQL = r"""WITH paths AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/+$', '') AS path, CAST(length(html) AS BIGINT) AS size FROM pages)
"""
DOC_PATH_SQL = r"""WITH paths AS (SELECT doc_id, source || '/' || lang || '/d' || doc_id || '.txt' AS path, CAST(n_chars AS BIGINT) AS size FROM documents)
"""
LOG_SQL = r"""WITH log AS (SELECT event_id AS pos, ts, user_id AS pid, CASE event_type WHEN 'error' THEN 'E' WHEN 'purchase' THEN 'W' ELSE 'I' END AS level, event_type AS tag, props AS msg FROM events)
"""
