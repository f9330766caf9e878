"""Hunks of documents, ignore files of hosts, includes of generated sources, and elements of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diffs, ignores, includes, markup
from ..sources.tables import LINES_SQL, PAGE_SQL, load, page_paths
from .registry import query


def _versions(spark, sf_dir):
    """Documents, and a version with a line in the middle, two at the end, a line break replaced by a mark, or nothing new."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = F.split("text", "\n")
    half = F.expr("size(split(text, '\n')) div 2")
    middle = F.array_join(F.concat(F.slice(parts, F.lit(1), half), F.array(F.concat(F.lit("\x01new "), "path")), F.slice(parts, half + 1, F.size(parts))), "\n")
    new = F.when(F.col("doc_id") % 4 == 0, middle).when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("\n\x01one\n\x01two"))).when(F.col("doc_id") % 4 == 2, F.replace("text", F.lit(".\n"), F.lit("!\x01\n"))).otherwise(F.col("text"))
    return docs.select("path", "text"), docs.select("path", new.alias("text"))


@query(
    """WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents WHERE coalesce(text, '') <> ''), n AS (SELECT doc_id, len(p) AS n, len(p) // 2 AS h, p FROM d)
    SELECT CAST(doc_id AS VARCHAR) AS path, CAST(greatest(h - 1, 1) AS INTEGER) AS old_start, CAST(least(h + 2, n) - greatest(h - 1, 1) + 1 AS INTEGER) AS old_lines, CAST(greatest(h - 1, 1) AS INTEGER) AS new_start,
      CAST(least(h + 2, n) - greatest(h - 1, 1) + 2 AS INTEGER) AS new_lines, 1 AS added, 0 AS removed,
      array_to_string(list_transform(list_slice(p, greatest(h - 1, 1), h), lambda x: ' ' || x) || ['+' || chr(1) || 'new ' || doc_id] || list_transform(list_slice(p, h + 1, h + 2), lambda x: ' ' || x), chr(10)) AS hunk
    FROM n WHERE doc_id % 4 = 0
    UNION ALL SELECT CAST(doc_id AS VARCHAR), CAST(greatest(n - 1, 1) AS INTEGER), CAST(least(n, 2) AS INTEGER), CAST(greatest(n - 1, 1) AS INTEGER), CAST(least(n, 2) + 2 AS INTEGER), 2, 0,
      array_to_string(list_transform(list_slice(p, greatest(n - 1, 1), n), lambda x: ' ' || x) || ['+' || chr(1) || 'one', '+' || chr(1) || 'two'], chr(10)) FROM n WHERE doc_id % 4 = 1"""
)
def diff_hunks(spark, sf_dir):
    """Hunks of lines that were put in, with two lines of context."""
    old, new = _versions(spark, sf_dir)
    found = diffs.line_hunks(old.where("text <> '' AND path % 4 < 2"), new)
    text = F.array_join(F.transform("rows", lambda r: F.concat(r["sign"], r["line"])), "\n")
    return found.select("path", "old_start", "old_lines", "new_start", "new_lines", "added", "removed", text.alias("hunk"))


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN array_to_string(string_split(t, chr(10))[:len(string_split(t, chr(10))) // 2] || [chr(1) || 'new ' || doc_id] || string_split(t, chr(10))[len(string_split(t, chr(10))) // 2 + 1:], chr(10))
    WHEN 1 THEN t || chr(10) || chr(1) || 'one' || chr(10) || chr(1) || 'two' WHEN 2 THEN replace(t, '.' || chr(10), '!' || chr(1) || chr(10)) ELSE t END AS text FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""
)
def diff_applied(spark, sf_dir):
    """The old texts with their hunks applied are the new texts."""
    old, new = _versions(spark, sf_dir)
    return diffs.apply_hunks(old, diffs.line_hunks(old, new)).select(F.col("path").cast("long").alias("doc_id"), "text")


@query(
    """WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS path, doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents), c AS (SELECT *, len(list_filter(p[:-2], lambda x: x LIKE '%.')) AS n FROM s)
    SELECT path, CAST(n AS BIGINT) AS added, CAST(n AS BIGINT) AS removed FROM c WHERE doc_id % 4 = 2 AND n > 0"""
)
def diff_counts(spark, sf_dir):
    """Changed lines over all hunks of a document in which lines were changed at their place."""
    old, new = _versions(spark, sf_dir)
    found = diffs.line_hunks(old.where("path % 4 = 2"), new)
    return found.groupBy("path").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))


#: The root ignores German pages, but hosts of even length keep them; hosts ignore French pages but those that end with 7, and
#: English ones as a whole, so that a later rule for some of them has no effect.
ROOT_RULES = "# pages\nde/\n"
HOST_RULES = "fr/*\n!fr/*7\nen/\n!en/3*\n"


@query(
    PAGE_SQL
    + """, p AS (SELECT page_id, path, length(string_split(path, '/')[1]) % 2 = 0 AS even, string_split(path, '/')[2] AS lang, string_split(path, '/')[3] AS name, len(string_split(path, '/')) AS n FROM paths)
    SELECT page_id, path FROM p WHERE NOT coalesce(n > 2 AND (lang = 'en' OR lang = 'de' AND NOT even OR lang = 'fr' AND name NOT LIKE '%7'), FALSE)"""
)
def not_ignored_pages(spark, sf_dir):
    """Pages as files, with an ignore file at the root and one for every host."""
    tree = page_paths(spark, sf_dir)
    hosts = tree.where(F.contains("path", F.lit("/"))).select(F.substring_index("path", "/", 1).alias("host")).distinct()
    text = F.concat(F.lit(HOST_RULES), F.when(F.length("host") % 2 == 0, "!de/\n").otherwise(""))
    files = hosts.select(F.concat("host", F.lit("/.gitignore")).alias("path"), text.alias("content"))
    files = files.unionByName(tree.limit(1).select(F.lit(".gitignore").alias("path"), F.lit(ROOT_RULES).alias("content")))
    return ignores.not_ignored(tree, files).select("page_id", "path")


def _headers(docs):
    """A header per document, in src, in a module or at the root, that includes the one of half its number; every tenth also at the root."""
    d = F.col("doc_id")
    place = F.when(d % 3 == 0, "src/").when(d % 3 == 1, F.concat(F.lit("src/m"), d % 5, F.lit("/"))).otherwise("")
    text = F.concat(F.lit('#include "h'), F.expr("doc_id div 2"), F.lit('.h"\n'), "text")
    rows = docs.select(F.concat(place, F.lit("h"), d, F.lit(".h")).alias("path"), text.alias("content"))
    return rows.unionByName(docs.where("doc_id % 10 = 0 AND doc_id % 3 <> 2").select(F.concat(F.lit("h"), d, F.lit(".h")).alias("path"), F.lit("far").alias("content")))


@query(
    """WITH RECURSIVE h AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'src/' WHEN 1 THEN 'src/m' || (doc_id % 5) || '/' ELSE '' END AS dir, strlen(text) + strlen('#include "h.h"') + 1 + length((doc_id // 2)::VARCHAR) AS bytes, doc_id // 2 AS next FROM documents
      UNION ALL SELECT doc_id, '', 3, NULL FROM documents WHERE doc_id % 10 = 0 AND doc_id % 3 <> 2),
    walk(source, id, dir, next, bytes, depth) AS (
      SELECT * FROM (SELECT doc_id, h.id, h.dir, h.next, h.bytes, 0 FROM documents d JOIN h ON h.id = d.doc_id AND starts_with('src/m' || (d.doc_id % 5) || '/', h.dir) WHERE h.bytes < 300000 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(h.dir) DESC) = 1)
      UNION ALL
      SELECT * FROM (SELECT w.source, h.id, h.dir, h.next, h.bytes, w.depth + 1 FROM walk w JOIN h ON h.id = w.next AND h.id <> w.id AND starts_with(w.dir, h.dir) WHERE w.depth < 2 AND h.bytes < 300000
        QUALIFY row_number() OVER (PARTITION BY w.source, w.id ORDER BY length(h.dir) DESC) = 1)),
    seen AS (SELECT source, dir || 'h' || id || '.h' AS header, min(depth) AS depth, any_value(bytes) AS bytes FROM walk GROUP BY ALL),
    capped AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY source ORDER BY depth, header ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM seen)
    SELECT source AS doc_id, header, CAST(depth AS INTEGER) AS depth, CAST(bytes AS INTEGER) AS bytes FROM capped WHERE before < 900000"""
)
def included_headers(spark, sf_dir):
    """A source per document that includes its header, which includes others."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    source = F.concat(F.lit("src/m"), F.col("doc_id") % 5, F.lit("/c"), "doc_id", F.lit(".cpp"))
    sources = docs.select(source.alias("path"), F.concat(F.lit('// x\n#include "h'), "doc_id", F.lit('.h"\nint f();\n')).alias("content"))
    found = includes.included(sources, _headers(docs).unionByName(sources))
    return found.select(F.regexp_extract("path", r"c(\d+)\.cpp$", 1).cast("long").alias("doc_id"), "header", "depth", F.col("bytes").cast("int").alias("bytes"))


_TAGS = r"""WITH RECURSIVE t AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)', '', 'g') AS t FROM pages),
all_tags AS (SELECT page_id, unnest(regexp_extract_all(t, '</?[A-Za-z][\w:-]*[^>"'']*(?:"[^"]*"[^>"'']*|''[^'']*''[^>"'']*){0,99}>')) AS tag, generate_subscripts(regexp_extract_all(t, '</?[A-Za-z][\w:-]*[^>"'']*(?:"[^"]*"[^>"'']*|''[^'']*''[^>"'']*){0,99}>'), 1) AS seq FROM t),
named AS (SELECT page_id, seq, starts_with(tag, '</') AS closes, lower(regexp_extract(tag, '^</?([A-Za-z][\w:-]*)', 1)) AS name, regexp_matches(tag, '/\s*>$') AS alone FROM all_tags),
paired AS (SELECT *, sum(CASE WHEN alone THEN 0 WHEN closes THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, name) = 0 AS paired FROM named),
steps AS (SELECT *, CASE WHEN closes THEN -1 WHEN paired AND NOT alone THEN 1 ELSE 0 END AS step FROM paired WHERE NOT closes OR paired),
run AS (SELECT *, sum(step) OVER w AS after, sum(CASE WHEN closes THEN 0 ELSE 1 END) OVER w - 1 AS pre FROM steps WINDOW w AS (PARTITION BY page_id ORDER BY seq)),
deep AS (SELECT *, CASE WHEN step = 1 THEN after - 1 ELSE after END AS depth FROM run),
ends AS (SELECT *, first_value(CASE WHEN step = -1 THEN pre + 1 END IGNORE NULLS) OVER (PARTITION BY page_id, depth ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closing, max(pre) OVER (PARTITION BY page_id) + 1 AS last FROM deep),
nodes AS (SELECT page_id, CAST(pre AS INTEGER) AS pre, CAST(CASE WHEN step = 1 THEN coalesce(closing, last) ELSE pre + 1 END AS INTEGER) AS "end", CAST(depth AS INTEGER) AS depth, name FROM ends WHERE NOT closes)
"""


@query(
    _TAGS
    + """SELECT n.page_id, n.pre, n."end", n.depth, n.name, (SELECT max(p.pre) FROM nodes p WHERE p.page_id = n.page_id AND p.pre < n.pre AND p."end" > n.pre) AS parent FROM nodes n"""
)
def page_nodes(spark, sf_dir):
    """Elements of pages with their intervals."""
    return markup.nodes(load(spark, sf_dir, "pages")).select("page_id", "pre", "end", "depth", "name", "parent")


@query(
    _TAGS
    + """, f AS (SELECT * FROM nodes WHERE name IN ('a', 'button', 'input'))
    SELECT n.page_id, n.pre, n.name, CASE WHEN n.name IN ('a', 'button', 'input') THEN n.pre ELSE coalesce((SELECT max(p.pre) FROM f p WHERE p.page_id = n.page_id AND p.pre < n.pre AND p."end" > n.pre),
      (SELECT min(d.pre) FROM f d WHERE d.page_id = n.page_id AND d.pre > n.pre AND d.pre < n."end")) END AS target FROM nodes n"""
)
def focus_targets(spark, sf_dir):
    """What a key press on each element would focus: links, buttons and inputs."""
    return markup.targets(markup.nodes(load(spark, sf_dir, "pages")), F.col("name").isin("a", "button", "input"))


@query(LINES_SQL + "SELECT 'all' AS part, count(*) AS n FROM lines")
def diff_of_equal_texts(spark, sf_dir):
    """Every line of every document is matched with itself after a first line was put before it."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.regexp_replace("text", "\n$", "").alias("text")).where("text <> ''")
    found = diffs.line_hunks(docs, docs.withColumn("text", F.concat(F.lit("\x01first\n"), "text")))
    lines_of = F.size(F.split("text", "\n"))
    kept = docs.join(found.where("added = 1 AND removed = 0 AND old_start = 1"), "path", "left_semi")
    return kept.agg(F.coalesce(F.sum(lines_of), F.lit(0)).cast("long").alias("n")).select(F.lit("all").alias("part"), "n")
