"""Search queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import ERRORS_PATTERN, FLAGS, search_pattern
from ..operators import search as s
from ..operators import text_index as ti
from ..operators.storage import kept, scratch
from ..sources.tables import LINES_SQL, load
from .registry import query

TERMS = ["worthless", "idiot", "license"]


def _docs(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "text")


def _hits(spark, sf_dir, *terms, **options):
    return s.hits(_docs(spark, sf_dir), search_pattern(list(terms), **options))


@query(LINES_SQL + r"SELECT doc_id, line, line_text FROM lines WHERE regexp_matches(line_text, 'licen[sc]ed.*under|idiot$', 'i')")
def search_lines(spark, sf_dir):
    return _hits(spark, sf_dir, "licen[sc]ed.*under|idiot$")


@query(LINES_SQL + r"SELECT doc_id, line, line_text FROM lines WHERE regexp_matches(line_text, 'worthless|idiot|license', 'i')")
def search_terms_or(spark, sf_dir):
    return _hits(spark, sf_dir, *TERMS)


@query(LINES_SQL + r"SELECT doc_id, line, line_text FROM lines WHERE regexp_matches(line_text, '\bclown\b', 'i')")
def search_identifier(spark, sf_dir):
    return _hits(spark, sf_dir, "clown")


@query(LINES_SQL + r"SELECT doc_id, line, line_text FROM lines WHERE regexp_matches(line_text, 'License')")
def search_case_sensitive(spark, sf_dir):
    return s.hits(_docs(spark, sf_dir), search_pattern(["License."], case_sensitive=True).replace(r"\.", ""))


@query(LINES_SQL + r"SELECT doc_id, count(*) AS n FROM lines WHERE regexp_matches(line_text, '\bthe\b', 'i') GROUP BY doc_id ORDER BY n DESC, doc_id LIMIT 60")
def search_count_per_doc(spark, sf_dir):
    return s.count_per_file(_hits(spark, sf_dir, "the"), "doc_id")


@query(
    LINES_SQL
    + r"""SELECT doc_id, line, line_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM (
      SELECT *, row_number() OVER (ORDER BY doc_id, line) AS rn FROM lines WHERE regexp_matches(line_text, '\bthe\b', 'i')) WHERE rn > 40)
      WHERE k <= 3 ORDER BY doc_id, line LIMIT 50"""
)
def search_page(spark, sf_dir):
    return s.page(_hits(spark, sf_dir, "the"), "doc_id", offset=40, per_file=3, most=50)


@query(
    LINES_SQL
    + r"""SELECT doc_id, line, line_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k
      FROM lines WHERE regexp_matches(line_text, '\bde\b', 'i')) WHERE k <= 2 ORDER BY doc_id, line LIMIT 500"""
)
def search_per_file_cap(spark, sf_dir):
    return s.page(_hits(spark, sf_dir, "de"), "doc_id", per_file=2, most=500)


@query(
    LINES_SQL
    + r"""SELECT doc_id, line, line_text, before_n, before_text, after_n, after_text FROM (SELECT *,
      count(*) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before_n,
      coalesce(string_agg(line_text, chr(10) ORDER BY line) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before_text,
      count(*) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS after_n,
      coalesce(string_agg(line_text, chr(10) ORDER BY line) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after_text
      FROM lines WHERE doc_id IN (SELECT doc_id FROM lines WHERE regexp_matches(line_text, 'license', 'i')))
      WHERE regexp_matches(line_text, 'license', 'i')"""
)
def search_context(spark, sf_dir):
    found = s.with_context(_docs(spark, sf_dir), search_pattern(["license"], regex=True), "doc_id", 2)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["line_text"]), "\n")
    return found.select("doc_id", "line", "line_text", F.size("before").cast("long").alias("before_n"), joined("before").alias("before_text"), F.size("after").cast("long").alias("after_n"), joined("after").alias("after_text"))


@query(
    LINES_SQL
    + r"""SELECT doc_id, min(line) AS first, max(line) AS last, count(*) AS rows, CAST(sum(hit) AS BIGINT) AS hits FROM (
      SELECT doc_id, line, hit, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM (
        SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near
        FROM (SELECT *, CAST(regexp_matches(line_text, 'licen|worthless', 'i') AS BIGINT) AS hit FROM lines)) WHERE near = 1)
      GROUP BY doc_id, island"""
)
def search_context_blocks(spark, sf_dir):
    from ..sources.tables import lines

    pattern = search_pattern(["licen|worthless"])
    rows = lines(_docs(spark, sf_dir).where(F.col("text").rlike(pattern)))
    return s.context_blocks(rows, F.col("line_text").rlike(pattern), ["doc_id"], "line")


@query(LINES_SQL + r"SELECT doc_id, line, line_text FROM lines WHERE regexp_matches(line_text, 'worthle.*|clown', 'i')")
def search_indexed(spark, sf_dir):
    """Filters of all documents are built first, and texts that they rule out are not searched."""
    docs = _docs(spark, sf_dir)
    return ti.indexed_hits(docs, kept(ti.learn(keyed(docs))), search_pattern(["worthle.*|clown"]), "doc_id")


def keyed(docs):
    """Documents as files that are named by their id and never change."""
    return docs.select(F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("mtime"), F.length("text").alias("size"), F.col("text").alias("content"))


def files_of(docs, changed=0):
    """Documents as files; with changed, every so many-th has a new first line and a later mtime."""
    touched = (F.col("doc_id") % changed == 0) if changed else F.lit(False)
    text = F.when(touched, F.concat(F.lit("clown\n"), "text")).otherwise(F.col("text"))
    return docs.select(F.concat(F.lit("d/"), "doc_id").alias("path"), F.when(touched, 2).otherwise(1).cast("long").alias("mtime"), F.length(text).cast("long").alias("size"), text.alias("content"))


@query(
    LINES_SQL.replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'clown' || chr(10) || text ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3)")
    + r"SELECT 'd/' || doc_id AS path, line, line_text FROM lines WHERE regexp_matches(line_text, 'worthle.*|clown', 'i')"
)
def search_after_changes(spark, sf_dir):
    """An index of all documents, after which every tenth changed and every seventh went: a search reads what the index does not know."""
    docs = _docs(spark, sf_dir)
    folder = scratch(spark, "index")
    ti.add(spark, folder, ti.learn(files_of(docs)))
    now = files_of(docs.where("doc_id % 7 <> 3"), 10)
    return ti.search(ti.open_index(spark, folder), now, search_pattern(["worthle.*|clown"]))


@query("SELECT CASE WHEN doc_id % 7 = 3 THEN 'gone' WHEN doc_id % 10 = 0 THEN 'stale' ELSE 'fresh' END AS state, count(*) AS n FROM documents GROUP BY 1")
def text_index_plan(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    known = files_of(docs).select("path", "mtime", "size", F.array().cast("array<long>").alias("bits"))
    return ti.plan(known, files_of(docs.where("doc_id % 7 <> 3"), 10)).groupBy("state").agg(F.count("*").alias("n"))


@query(
    """SELECT 'refreshed' AS step, CASE WHEN doc_id % 7 = 3 THEN 'gone' ELSE 'fresh' END AS state, count(*) AS n FROM documents GROUP BY 2
    UNION ALL SELECT 'compacted' AS step, 'fresh' AS state, count(*) AS n FROM documents WHERE doc_id % 7 <> 3"""
)
def text_index_refresh(spark, sf_dir):
    """A version that learns what changed, and one without the rows of files and states that are gone."""
    docs, folder = _docs(spark, sf_dir), scratch(spark, "index")
    ti.add(spark, folder, ti.learn(files_of(docs)))
    now = files_of(docs.where("doc_id % 7 <> 3"), 10)
    ti.refresh(spark, folder, now)
    states = lambda step: ti.plan(ti.open_index(spark, folder), now).groupBy("state").agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), "state", "n")
    refreshed = kept(states("refreshed"))
    ti.compact(spark, folder, now)
    return refreshed.unionByName(states("compacted"))


_GRAMS = r"""WITH g AS (SELECT DISTINCT doc_id, substr(lower(text), i, 3) AS gram FROM (
  SELECT doc_id, text, unnest(range(1, length(text) - 1)) AS i FROM documents)), ok AS (SELECT * FROM g WHERE NOT regexp_matches(gram, '[\n\r]')) """


@query(
    _GRAMS
    + """, n AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS grams FROM ok GROUP BY doc_id)
    SELECT d.doc_id, coalesce(grams, 0) AS grams, greatest(256, CAST(2 ** ceil(log2(6 * coalesce(grams, 1))) AS BIGINT)) AS n_bits FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""
)
def text_filters(spark, sf_dir):
    """The filter of every document: how many distinct trigrams it holds, and its bits."""
    rows = ti.learn(keyed(_docs(spark, sf_dir)))
    return rows.select(F.col("path").cast("long").alias("doc_id"), "grams", (F.size("bits").cast("long") * 64).alias("n_bits"))


@query(_GRAMS + "SELECT gram, count(*) AS n FROM ok GROUP BY gram")
def gram_index(spark, sf_dir):
    return s.gram_index(_docs(spark, sf_dir), "doc_id").groupBy("gram").agg(F.count("*").alias("n"))


@query(_GRAMS + "SELECT doc_id FROM ok WHERE gram IN ('tio', 'ion') GROUP BY doc_id HAVING count(*) = 2 UNION SELECT doc_id FROM ok WHERE gram IN ('nth', 'the') GROUP BY doc_id HAVING count(*) = 2")
def gram_candidates(spark, sf_dir):
    return s.candidates(s.gram_index(_docs(spark, sf_dir), "doc_id"), ["tion", "nthe"], "doc_id")


@query(r"SELECT conv_id, turn, role, text FROM conversations WHERE regexp_matches(text, 'tion', 'i') AND NOT regexp_matches(text, 'The')")
def grep_keep_drop(spark, sf_dir):
    return s.line_filter(load(spark, sf_dir, "conversations"), "text", "tion", "The")


@query(
    r"""SELECT * FROM (SELECT 'head' AS part, conv_id, turn FROM conversations ORDER BY conv_id, turn LIMIT 7)
    UNION ALL SELECT * FROM (SELECT 'tail' AS part, conv_id, turn FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 5)"""
)
def grep_head_tail(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn")
    part = lambda df, name: df.select(F.lit(name).alias("part"), "conv_id", "turn")
    return part(s.head(rows, 7, ["conv_id", "turn"]), "head").union(part(s.tail(rows, 5, ["conv_id", "turn"]), "tail"))


@query(
    r"""SELECT event_id, entry FROM (SELECT event_id, event_type || ': ' || props AS entry FROM events)
    WHERE regexp_matches(entry, '\berror\b|\bfatal\b|\bLNK\d+|undefined reference|cannot (open|find)|\bfailed\b|exception|warning C\d+|^\[(exit|timed out)', 'i')"""
)
def errors_preset(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", F.concat_ws(": ", "event_type", "props").alias("entry"))
    return rows.where(F.col("entry").rlike(FLAGS + ERRORS_PATTERN))
