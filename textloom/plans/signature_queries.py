"""Signatures, outlines and definition texts. Symbols are parts: brands are types, parts their methods, types their files;
texts are documents, whose lines are lines of code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import signatures as g
from ..sources.tables import LINES_SQL, lines, load
from .registry import query


def symbols(spark, sf_dir):
    """(id, path, name, kind, owner, start_line, end_line, detail, bases) from part: a class per type and brand, and its parts."""
    part = load(spark, sf_dir, "part")
    member = part.select(
        F.concat(F.lit("p:"), "p_partkey").alias("id"), F.concat(F.lit("lib/"), "p_type").alias("path"), F.col("p_name").alias("name"), F.lit("method").alias("kind"),
        F.col("p_brand").alias("owner"), F.col("p_partkey").cast("int").alias("start_line"),
    )
    types = part.groupBy("p_type", "p_brand").agg(F.min("p_partkey").cast("int").alias("n"))
    classes = types.select(F.concat("p_type", F.lit(":"), "p_brand").alias("id"), F.concat(F.lit("lib/"), "p_type").alias("path"), F.col("p_brand").alias("name"), F.lit("class").alias("kind"), F.lit(None).cast("string").alias("owner"), F.col("n").alias("start_line"))
    return member.unionByName(classes)


_SYMBOLS = """WITH s AS (SELECT 'p:' || p_partkey AS id, 'lib/' || p_type AS path, p_name AS name, 'method' AS kind, p_brand AS owner, CAST(p_partkey AS INTEGER) AS start_line FROM part
  UNION ALL SELECT p_type || ':' || p_brand, 'lib/' || p_type, p_brand, 'class', NULL, CAST(min(p_partkey) AS INTEGER) FROM part GROUP BY p_type, p_brand),
  r AS (SELECT *, CASE kind WHEN 'class' THEN 'type' ELSE 'method' END AS row_kind, CAST(row_number() OVER (PARTITION BY path ORDER BY kind <> 'class', start_line, name) - 1 AS INTEGER) AS ord FROM s) """


@query(_SYMBOLS + "SELECT path, ord, row_kind, name FROM r")
def signature_order(spark, sf_dir):
    return g.signature_rows(symbols(spark, sf_dir)).select("path", "ord", "row_kind", "name")


@query(_SYMBOLS + "SELECT path, count(*) FILTER (row_kind = 'type') AS types, string_agg(name, '|' ORDER BY ord) AS names FROM r WHERE path LIKE 'lib/%' GROUP BY path")
def file_outlines(spark, sf_dir):
    return g.outlines(g.signature_rows(symbols(spark, sf_dir)), "lib", "name").select("path", "types", F.array_join("rows", "|").alias("names"))


@query(_SYMBOLS + "SELECT DISTINCT path FROM r WHERE contains(lower(path), 'plate') OR contains(lower(name), 'plate')")
def overview_match(spark, sf_dir):
    return g.overview_match(g.signature_rows(symbols(spark, sf_dir)), "Plate")


@query(_SYMBOLS + "SELECT id, start_line FROM s WHERE path = 'lib/PROMO' AND owner = 'Brand#2'")
def members_of_owner(spark, sf_dir):
    return g.members(symbols(spark, sf_dir), "lib/PROMO", "Brand#2").select("id", "start_line")


@query(_SYMBOLS + "SELECT c.name AS class, count(m.id) AS members FROM (SELECT DISTINCT name FROM s WHERE kind = 'class') c LEFT JOIN s m ON m.owner = c.name GROUP BY c.name")
def members_per_class(spark, sf_dir):
    return g.member_counts(symbols(spark, sf_dir))


@query(
    """WITH s AS (SELECT DISTINCT p_brand AS class, p_type AS base FROM part) SELECT class, string_agg(base, ',' ORDER BY base) AS bases FROM s GROUP BY class"""
)
def merged_bases(spark, sf_dir):
    """Brands have the types of their parts as bases, in several declarations."""
    rows = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name"), "p_name").agg(F.collect_set("p_type").alias("bases")).withColumn("kind", F.lit("class"))
    return g.merged_bases(rows).select("class", F.array_join("bases", ",").alias("bases"))


@query(_SYMBOLS + """, n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start_line, name) AS k FROM s WHERE owner IS NULL)
    SELECT path, string_agg(name, ',' ORDER BY k) FILTER (k <= 8) AS names, count(*) - count(*) FILTER (k <= 8) AS more FROM n GROUP BY path""")
def top_level_names(spark, sf_dir):
    found = g.top_names(symbols(spark, sf_dir))
    return found.select("path", F.array_join("names", ",").alias("names"), F.col("more").cast("long").alias("more"))


def _spans(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    rows = lines(docs.select(F.col("doc_id").cast("string").alias("path"), "text"))
    last = F.least(x.line_count(F.col("text")), F.lit(200))
    return docs.where("text <> ''").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("start_line"), last.cast("int").alias("end_line")), rows


@query(
    LINES_SQL
    + """, e AS (SELECT doc_id, least(max(line), 200) AS e FROM lines GROUP BY doc_id)
    SELECT doc_id, string_agg(line_text, chr(10) ORDER BY line) AS text, CAST(max(e) - least(max(e), 150) AS INTEGER) AS more FROM lines JOIN e USING (doc_id) WHERE line <= least(e, 150) GROUP BY doc_id"""
)
def definition_text(spark, sf_dir):
    """The whole of each document as a definition that starts on its first line."""
    spans, rows = _spans(spark, sf_dir)
    return g.definition_text(spans, rows, "doc_id")


@query(LINES_SQL + "SELECT '7:2-4' AS spec, doc_id, line, line_text FROM lines WHERE doc_id = 7 AND line BETWEEN 2 AND 4 UNION ALL SELECT '12#L1', doc_id, line, line_text FROM lines WHERE doc_id = 12 AND line = 1")
def read_several_ranges(spark, sf_dir):
    rows = _spans(spark, sf_dir)[1]
    return g.read_specs(rows, ["7:2-4", "12#L1"]).select("spec", F.col("path").cast("long").alias("doc_id"), "line", "line_text")


@query("SELECT doc_id, CAST(length(substr(text, 1, 500)) - length(replace(substr(text, 1, 500), chr(10), '')) + 1 AS INTEGER) AS line FROM documents")
def line_of_offset(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", x.line_of(F.col("text"), F.lit(500)).alias("line"))


@query(
    LINES_SQL
    + r""", s AS (SELECT doc_id, line, CASE WHEN regexp_matches(line_text, '^[A-Z]\w+ \w+\.$') THEN 'short' ELSE 'long' END AS kind, regexp_extract(line_text, '^([A-Z]\w+)', 1) AS name FROM lines WHERE regexp_matches(line_text, '^[A-Z]\w+ '))
    SELECT doc_id, line, kind, name, CAST(least(coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line) - 1, line + 15), line + 15) AS INTEGER) AS end_line FROM s"""
)
def adapter_symbols(spark, sf_dir):
    """Lines that start with a capital word stand for declarations of two kinds. ASCII words only, as in the SQL."""
    rows = lines(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"))
    found = g.adapter_symbols(rows, {"short": r"^([A-Z]\w+) \w+\.$", "long": r"^([A-Z]\w+) "})
    return found.withColumnRenamed("path", "doc_id")
