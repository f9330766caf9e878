"""Queries on texts: line facts, edits, outlines, links."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import edits as e
from ..operators import links as ln
from ..operators.outline import fence_parity as fences
from ..operators.outline import outline
from ..sources.tables import LINES_SQL, lines, load
from .registry import query


def _docs(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "text")


@query(LINES_SQL + "SELECT d.doc_id, count(line) AS n_lines, CAST(coalesce(max(length(line_text)), 0) AS BIGINT) AS longest FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id GROUP BY d.doc_id")
def line_stats(spark, sf_dir):
    t = F.col("text")
    longest = F.array_max(F.transform(F.split(t, "\n"), lambda s: F.length(s)))
    return _docs(spark, sf_dir).select("doc_id", x.line_count(t).cast("long").alias("n_lines"), longest.cast("long").alias("longest"))


@query("SELECT doc_id, doc_id % 2 = 0 AS equal, doc_id % 3 = 0 AND contains(text, chr(10)) AS crlf FROM documents")
def eol_normalised_equal(spark, sf_dir):
    """Each document against a copy: even ones with carriage returns added, odd ones with a mark as well."""
    docs = _docs(spark, sf_dir)
    crlf = F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))
    copy = F.when(F.col("doc_id") % 2 == 0, crlf).otherwise(F.concat(crlf, F.lit("!")))
    return docs.select("doc_id", (x.without_returns(F.col("text")) == x.without_returns(copy)).alias("equal"), x.is_crlf(F.when(F.col("doc_id") % 3 == 0, crlf).otherwise(F.col("text"))).alias("crlf"))


@query(LINES_SQL + "SELECT doc_id, line, CASE WHEN length(line_text) > 240 THEN substr(line_text, 1, 240) || '...' ELSE line_text END AS clipped FROM lines")
def clip_lines(spark, sf_dir):
    return lines(_docs(spark, sf_dir)).select("doc_id", "line", x.clip(F.col("line_text")).alias("clipped"))


@query(LINES_SQL + "SELECT doc_id, line, line_text FROM lines WHERE line BETWEEN 5 AND 9")
def read_range(spark, sf_dir):
    _, first, last = e.range_spec("any#L5-9")
    return e.read_range(lines(_docs(spark, sf_dir)), first, last)


@query(
    r"""WITH h AS (SELECT page_id, pos, CAST(substr(m, 3, 1) AS INTEGER) AS level, substr(m, 5) AS title FROM (
      SELECT page_id, unnest(regexp_extract_all(html, '<h[1-6]>[^<]*')) AS m, unnest(range(1, len(regexp_extract_all(html, '<h[1-6]>[^<]*')) + 1)) AS pos FROM pages))
    SELECT page_id, CAST(pos AS INTEGER) AS pos, level, title, CAST((SELECT max(p.pos) FROM h p WHERE p.page_id = h.page_id AND p.pos < h.pos AND p.level < h.level) AS INTEGER) AS parent FROM h"""
)
def heading_outline(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit("(<h[1-6]>[^<]*)"), 1)
    heads = load(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("pos", "m"))
    heads = heads.select("page_id", (F.col("pos") + 1).alias("pos"), F.substring("m", 3, 1).cast("int").alias("level"), F.substring("m", 5, 1 << 20).alias("title"))
    return outline(heads, "page_id", "pos")


@query(LINES_SQL + "SELECT doc_id, line, sum(CASE WHEN line_text LIKE '%|%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) % 2 = 1 AS inside FROM lines")
def fence_parity(spark, sf_dir):
    """Lines inside fences; lines with a bar stand for fences here."""
    rows = lines(_docs(spark, sf_dir))
    return fences(rows, "doc_id", F.contains("line_text", F.lit("|"))).select("doc_id", "line", "inside")


@query("SELECT doc_id, CAST((length(text) - length(replace(text, ' the ', ''))) / 5 AS INTEGER) AS n FROM documents WHERE contains(text, ' the ')")
def replace_counts(spark, sf_dir):
    return e.replace_all(_docs(spark, sf_dir), " the ", " THE ", "text").select("doc_id", "n")


@query("SELECT doc_id, replace(text, ' of ', ' OF ') AS result FROM documents WHERE contains(text, ' of ')")
def replace_all_text(spark, sf_dir):
    return e.replace_all(_docs(spark, sf_dir), " of ", " OF ", "text").select("doc_id", "result")


_OLD = "License.\n"


@query(
    r"""WITH p AS (SELECT doc_id, (length(text) - length(replace(text, 'License.' || chr(10), ''))) // 9 AS a, (length(text) - length(replace(text, 'License.', ''))) // 8 AS b FROM documents)
    SELECT doc_id, CASE WHEN a > 0 THEN 'exact_match' WHEN b > 0 THEN 'trimmed_match' END AS strategy, CAST(CASE WHEN a > 0 THEN a ELSE b END AS INTEGER) AS matches,
    CASE WHEN a = 0 AND b = 0 THEN 'not_found' WHEN (CASE WHEN a > 0 THEN a ELSE b END) > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM p"""
)
def patch_strategy(spark, sf_dir):
    return e.patch(_docs(spark, sf_dir), _OLD, "Licence.\n", text="text").select("doc_id", "strategy", "matches", "status")


@query(
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN m = 0 THEN 'not_found' WHEN m > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM (SELECT CASE WHEN k > 0 THEN k ELSE w END AS m FROM (
    SELECT (length(text) - length(replace(text, ' with ', ''))) // 6 AS k, (length(text) - length(replace(text, 'with', ''))) // 4 AS w FROM documents))) GROUP BY status"""
)
def ambiguity_status(spark, sf_dir):
    return e.patch(_docs(spark, sf_dir), " with ", " WITH ", text="text").groupBy("status").agg(F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT doc_id, string_split(text, chr(10)) AS r FROM documents)
    SELECT doc_id, CASE WHEN len(r) >= 2 THEN array_to_string(r[1:1] || ['new line'] || r[3:], chr(10)) END AS replaced, CASE WHEN len(r) >= 2 THEN array_to_string(r[1:1] || r[3:], chr(10)) END AS deleted,
    CASE WHEN len(r) >= 2 THEN array_to_string(r[1:2] || ['new line'] || r[3:], chr(10)) END AS inserted FROM r"""
)
def line_edit(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", e.edit_line(t, 2, "replace", "new line").alias("replaced"), e.edit_line(t, 2, "delete").alias("deleted"), e.edit_line(t, 2, "after", "new line").alias("inserted"))


@query("SELECT doc_id, 'start: ' || text || chr(10) || 'end' AS result, CAST(0 AS INTEGER) AS failed FROM documents UNION ALL SELECT -1 - doc_id, 'begin' || doc_id || ' ' || text, CAST(CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS INTEGER) FROM documents")
def apply_blocks(spark, sf_dir):
    """Three blocks per document of which each needs the one before; and the same with every ninth document without one of the texts, so
    that no file changes."""
    docs = load(spark, sf_dir, "documents")
    mark = F.concat(F.lit("begin"), "doc_id", F.lit(" "))
    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.concat(mark, "text").alias("content"))
    block = lambda n, old, new: F.struct(F.lit(n).alias("ord"), old.alias("old"), new.alias("new"))
    steps = [block(1, mark, F.lit("\x01middle: ")), block(2, F.lit("\x01middle: "), F.lit("start: ")), block(3, F.concat(F.lit("start: "), "text"), F.concat(F.lit("start: "), "text", F.lit("\nend")))]
    blocks = docs.select(F.col("doc_id").cast("string").alias("path"), F.explode(F.array(*steps)).alias("x")).select("path", "x.*")
    done = e.apply_blocks(files, blocks).select(F.col("path").cast("long").alias("doc_id"), "result", "failed")
    refused = e.apply_blocks(files, blocks.where("ord = 1 AND path % 9 <> 0").unionByName(blocks.where("ord = 2 AND path % 9 = 0")))
    return done.unionByName(refused.select((-1 - F.col("path").cast("long")).alias("doc_id"), "result", "failed"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '://', '://user:secret@'), '://[^/@]*@', '://***@') AS masked FROM pages")
def mask_urls(spark, sf_dir):
    url = F.regexp_replace("url", "://", "://user:secret@")
    return load(spark, sf_dir, "pages").select("page_id", x.mask_credentials(url).alias("masked"))


@query("SELECT doc_id, CASE WHEN n_chars >= 1024 THEN printf('%.1f KB', n_chars / 1024.0) ELSE n_chars || ' B' END AS size FROM documents")
def human_size(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", x.human_size(F.col("n_chars")).alias("size"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(html, '\b([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1), lambda n: n NOT IN ('if', 'for', 'function')))), ',') AS calls FROM pages""")
def link_extract_calls(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(ln.called(F.col("html"))), ",").alias("calls"))


@query(
    """WITH used AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS package FROM pages), declared AS (SELECT DISTINCT '/' || unnest(string_split(text, ' ')) AS package FROM benchmark)
    SELECT package, 'missing' AS status FROM used WHERE package NOT IN (SELECT package FROM declared) UNION ALL SELECT package, 'unused' FROM declared WHERE package NOT IN (SELECT package FROM used)"""
)
def link_used_vs_declared(spark, sf_dir):
    """Links of menus against the words of benchmark items as declared targets."""
    used = load(spark, sf_dir, "pages").select(F.explode(ln.hrefs(F.col("html"))).alias("package"))
    declared = load(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).select(F.concat(F.lit("/"), "word").alias("package"))
    return ln.used_and_declared(used, declared)


@query(
    """SELECT page_id, CASE page_id % 7 WHEN 0 THEN '@s' || page_id || '/pkg' WHEN 1 THEN 'lodash' || page_id END AS package FROM pages"""
)
def package_names(spark, sf_dir):
    """Specifiers that the numbers and urls of pages make."""
    n = F.col("page_id")
    forms = [F.concat(F.lit("@s"), n, F.lit("/pkg/sub")), F.concat(F.lit("lodash"), n, F.lit("/fp")), F.concat(F.lit("./local"), n), F.lit("fs"), F.col("url"), F.concat(F.lit("@/alias"), n), F.concat(F.lit("a b"), n)]
    return load(spark, sf_dir, "pages").select("page_id", ln.package_of(F.get(F.array(*forms), (n % 7).cast("int"))).alias("package"))


@query("SELECT l_orderkey, l_linenumber, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last_line, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS end_line FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def bounded_by_next(spark, sf_dir):
    """A symbol ends where the next one starts."""
    w = Window.partitionBy("l_orderkey")
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return rows.withColumn("last_line", F.max("l_linenumber").over(w)).withColumn("end_line", F.lead("l_linenumber").over(w.orderBy("l_linenumber")) - 1)


@query(
    LINES_SQL.replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN contains(text, ' the ') THEN text END AS text FROM documents)")
    + """, n AS (SELECT doc_id, line, (length(line_text) - length(replace(line_text, ' the ', ''))) // 5 AS k FROM lines)
    SELECT doc_id, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM (SELECT doc_id, line, unnest(range(0, k)) FROM n WHERE k > 0) GROUP BY doc_id"""
)
def match_lines(spark, sf_dir):
    """The line of every occurrence of a word in documents that have it."""
    docs = _docs(spark, sf_dir).where(F.contains("text", F.lit(" the ")))
    return docs.select("doc_id", F.array_join(e.match_lines(F.col("text"), " the "), ",").alias("lines"))


@query(
    """WITH w AS (SELECT doc_id, text, CASE WHEN contains(text, ' the ') THEN ' the ' ELSE 'the' END AS old FROM documents WHERE contains(text, 'the')),
    p AS (SELECT doc_id, old, string_split(text, chr(10)) AS r, string_split(replace(text, old, upper(old)), chr(10)) AS q FROM w),
    f AS (SELECT *, list_position(list_transform(r, lambda x: contains(x, old)), TRUE) AS k FROM p)
    SELECT doc_id, array_to_string(list_slice(r, greatest(k - 1, 1), k + 1), chr(10)) AS before, array_to_string(list_slice(q, greatest(k - 1, 1), k + 1), chr(10)) AS after FROM f"""
)
def edit_preview(spark, sf_dir):
    """Texts without the words between blanks match trimmed."""
    return e.preview(_docs(spark, sf_dir), " the ", " THE ", "text").select("doc_id", "before", "after")


@query(
    """WITH d AS (SELECT doc_id, text, contains(text, ' and ') AND (length(text) - length(replace(text, ' and ', ''))) = 5 AS one, contains(text, '.') AND length(text) - length(replace(text, '.', '')) = 1 AS dot FROM documents)
    SELECT doc_id, CAST(CASE WHEN one AND dot THEN 2 WHEN one THEN 1 ELSE 0 END AS INTEGER) AS applied, CASE WHEN one AND dot THEN NULL WHEN one THEN 2 ELSE 1 END AS failed_at,
    CASE WHEN one AND dot THEN replace(replace(text, ' and ', ' AND '), '.', '!') WHEN one THEN replace(text, ' and ', ' AND ') ELSE text END AS result FROM d"""
)
def edits_in_turn(spark, sf_dir):
    """Two edits of each document; what comes behind one that fails is left out."""
    files = _docs(spark, sf_dir).select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    blocks = files.select("path", F.explode(F.array(F.struct(F.lit(1).alias("ord"), F.lit(" and ").alias("old"), F.lit(" AND ").alias("new")), F.struct(F.lit(2).alias("ord"), F.lit(".").alias("old"), F.lit("!").alias("new")))).alias("b")).select("path", "b.*")
    return e.apply_in_turn(files, blocks).withColumnRenamed("path", "doc_id")


@query(
    LINES_SQL
    + """, rows AS (SELECT doc_id, 1 AS line, 'the quick brown f' || CASE WHEN doc_id % 3 = 0 THEN 'ox' ELSE '' END AS line_text FROM documents WHERE doc_id % 3 <> 2
      UNION ALL SELECT doc_id, line + CASE WHEN doc_id % 3 = 2 THEN 0 ELSE 1 END, line_text FROM lines),
    near AS (SELECT * FROM rows WHERE length(line_text) BETWEEN 9 AND 38),
    grams AS (SELECT doc_id, line, line_text, lower(regexp_replace(line_text, '\\s', '', 'g')) AS s FROM near),
    g AS (SELECT doc_id, line, line_text, length(s) - 1 AS n, unnest(range(1, length(s))) AS i, s FROM grams WHERE length(s) > 1),
    c AS (SELECT doc_id, line, line_text, n, substr(s, i, 2) AS gram, count(*) AS k FROM g GROUP BY ALL),
    w AS (SELECT substr('thequickbrownfax', i, 2) AS gram, count(*) AS k FROM range(1, 16) r(i) GROUP BY 1),
    d AS (SELECT doc_id, line, line_text, 2.0 * sum(least(c.k, w.k)) / (n + 15) AS dice FROM c JOIN w USING (gram) GROUP BY doc_id, line, line_text, n)
    SELECT doc_id, line, line_text FROM d WHERE dice >= 0.6 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, line) = 1"""
)
def edit_hints(spark, sf_dir):
    """Two thirds of the documents begin with a line that resembles the one looked for."""
    docs = load(spark, sf_dir, "documents")
    head = F.when(F.col("doc_id") % 3 == 0, "the quick brown fox\n").when(F.col("doc_id") % 3 == 1, "the quick brown f\n").otherwise("")
    files = docs.select(F.col("doc_id").alias("path"), F.concat(head, "text").alias("content"))
    return e.hints(files, "the quick brown fax\nnext").select(F.col("path").alias("doc_id"), "line", "line_text")


@query(
    """SELECT 'c/' || doc_id AS path, text AS content FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'd/' || doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN text || CASE WHEN text = '' OR suffix(text, chr(10)) THEN '' ELSE chr(10) END || 'end' ELSE text END
    FROM documents WHERE doc_id % 3 <> 0"""
)
def file_catalogue(spark, sf_dir):
    """Documents as files: a third moves to another folder, every fifth is written anew, every seventh of the rest gets a line more."""
    docs = _docs(spark, sf_dir)
    name = lambda folder: F.concat(F.lit(folder + "/"), "doc_id").alias("path")
    files = docs.select(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a/"), "doc_id")).otherwise(name("d")).alias("path"), F.col("text").alias("content"))
    files = e.moved_to(files, "a", "c")
    files = e.put(files, docs.where("doc_id % 3 <> 0 AND doc_id % 5 = 0").select(name("d"), F.lit("new").alias("content")))
    files = e.appended(files, docs.where("doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 = 0").select(name("d"), F.lit("end").alias("content")))
    files = e.put(files, docs.limit(0).select(name("d"), F.col("text").alias("content")), only_new=True)
    return e.without(files.unionByName(spark.createDataFrame([("gone/x", "y")], "path string, content string")), "gone")


@query("SELECT doc_id, (length(text) - length(replace(text, chr(10), ''))) AS crlf, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS lf FROM documents")
def break_counts(spark, sf_dir):
    """Documents with carriage returns added, even ones with one more line feed alone."""
    text = F.concat(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), F.when(F.col("doc_id") % 2 == 0, "\n").otherwise(""))
    counts = x.break_counts(text)
    return _docs(spark, sf_dir).select("doc_id", counts["crlf"].cast("long").alias("crlf"), counts["lf"].cast("int").alias("lf"))


@query(
    LINES_SQL
    + r""", h AS (SELECT doc_id, line, CASE WHEN line_text LIKE 'T%' THEN 1 ELSE 2 END AS level, trim(line_text) AS title FROM lines WHERE regexp_matches(line_text, '^[TA][a-z]')),
    n AS (SELECT doc_id, max(line) AS n FROM lines GROUP BY doc_id)
    SELECT doc_id, line, level, title, CAST(CASE WHEN level = 2 THEN max(CASE WHEN level = 1 THEN line END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS INTEGER) AS parent,
    CAST(coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line) - 1, n) AS INTEGER) AS end_line FROM h JOIN n USING (doc_id)"""
)
def markdown_outline(spark, sf_dir):
    """Lines that start with T and a small letter as headings of the first level, those with A of the second."""
    from ..operators.outline import markdown

    rows = lines(_docs(spark, sf_dir))
    mark = F.when(F.col("line_text").rlike("^T[a-z]"), F.concat(F.lit("# "), "line_text")).when(F.col("line_text").rlike("^A[a-z]"), F.concat(F.lit("## "), "line_text")).otherwise(F.lit("x"))
    return markdown(rows.select("doc_id", "line", mark.alias("line_text")), "doc_id")


@query(
    LINES_SQL
    + """, m AS (SELECT doc_id, line, line_text AS t, position(' the ' IN line_text) - 1 AS p, length(line_text) AS n FROM lines WHERE contains(line_text, ' the ')), w AS (SELECT *, least(greatest(p - 60, 0), n - 240) AS s FROM m)
    SELECT doc_id, line, CASE WHEN n <= 260 THEN trim(t) ELSE CASE WHEN s > 0 THEN '...(' || s || ' chars) ' ELSE '' END || trim(substr(t, s + 1, 240)) || CASE WHEN n - s - 240 > 0 THEN ' ...(+' || (n - s - 240) || ' chars)' ELSE '' END END AS shown FROM w"""
)
def clip_window(spark, sf_dir):
    """Lines with a word, long ones as a window around it."""
    rows = lines(_docs(spark, sf_dir)).where(F.contains("line_text", F.lit(" the ")))
    return rows.select("doc_id", "line", x.clip_at(F.col("line_text"), F.instr("line_text", " the ") - 1).alias("shown"))


@query("SELECT p_partkey, contains(p_name, '_') OR contains(p_brand, '#2') AS found FROM part")
def like_escaped(spark, sf_dir):
    """Terms with the wildcards of LIKE are found as they are."""
    found = F.col("p_name").like(f"%{x.like_literal('_')}%") | F.col("p_brand").like(f"%{x.like_literal('#2')}%")
    return load(spark, sf_dir, "part").select("p_partkey", found.alias("found"))
