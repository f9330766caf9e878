"""Folder-tree queries: pages and documents as files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import trees as t
from ..sources.tables import DOC_PATH_SQL, PAGE_SQL, document_paths, load, page_paths
from .registry import query

_ANCESTORS = "anc AS (SELECT path, size, unnest([array_to_string(string_split(path, '/')[1:i], '/') for i in range(1, len(string_split(path, '/')))]) AS folder FROM paths) "


@query(DOC_PATH_SQL + "SELECT split_part(path, '/', 1) AS folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM paths GROUP BY 1")
def folder_rollup(spark, sf_dir):
    return t.folder_rollup(document_paths(spark, sf_dir))


@query(PAGE_SQL + ", " + _ANCESTORS + "SELECT folder, count(*) AS files FROM anc WHERE len(string_split(folder, '/')) <= 2 GROUP BY folder")
def ancestor_counts(spark, sf_dir):
    return t.subtree_sizes(page_paths(spark, sf_dir), 2).drop("bytes")


@query(DOC_PATH_SQL + ", " + _ANCESTORS + "SELECT folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM anc GROUP BY folder")
def subtree_sizes(spark, sf_dir):
    return t.subtree_sizes(document_paths(spark, sf_dir))


@query(
    PAGE_SQL
    + """, n AS (SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) || '/' ELSE '(root files)' END AS top, string_split(path, '/')[-1] AS name FROM paths)
    SELECT top, CASE WHEN contains(name, '.') THEN lower(string_split(name, '.')[-1]) ELSE '' END AS ext, count(*) AS files FROM n GROUP BY ALL"""
)
def ext_histogram(spark, sf_dir):
    return t.extension_histogram(page_paths(spark, sf_dir))


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang)
    SELECT source, lang, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang DESC) AS r FROM c) WHERE r = 1""")
def dominant_language(spark, sf_dir):
    return t.dominant(load(spark, sf_dir, "documents"), "source", "lang")


@query(DOC_PATH_SQL + "SELECT path, size FROM paths ORDER BY size DESC, path LIMIT 20")
def top_k_files(spark, sf_dir):
    return t.largest(document_paths(spark, sf_dir), 20, "path", "size")


@query(DOC_PATH_SQL + ", " + _ANCESTORS + "SELECT folder, files, bytes FROM (SELECT folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM anc GROUP BY folder) ORDER BY bytes DESC, folder LIMIT 10")
def top_k_folders(spark, sf_dir):
    return t.subtree_sizes(document_paths(spark, sf_dir)).orderBy(F.desc("bytes"), "folder").limit(10)


@query("SELECT source, CAST(sum(n_chars) AS BIGINT) AS bytes, CAST(round(100.0 * sum(n_chars) / sum(sum(n_chars)) OVER ()) AS BIGINT) AS pct FROM documents GROUP BY source")
def percent_of_total(spark, sf_dir):
    sums = load(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("bytes"))
    total = F.sum("bytes").over(Window.partitionBy())  # over one row per source
    return sums.select("source", "bytes", x.percent(F.col("bytes").cast("double"), total).alias("pct"))


@query(
    PAGE_SQL
    + """, u AS (SELECT DISTINCT path FROM paths), s AS (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS n FROM u),
    f AS (SELECT path, n, array_to_string(string_split(path, '/')[-n:], '/') AS suffix FROM s),
    k AS (SELECT suffix, count(*) AS k FROM f GROUP BY suffix)
    SELECT path, coalesce(min_by(suffix, n), any_value(path)) AS suffix FROM f JOIN k USING (suffix) WHERE k = 1 GROUP BY path"""
)
def shortest_unique_suffix(spark, sf_dir):
    return t.shortest_suffix(page_paths(spark, sf_dir))


@query(PAGE_SQL + "SELECT path FROM paths WHERE path = '25' OR path LIKE '%/25'")
def find_by_name(spark, sf_dir):
    return t.find_by_name(page_paths(spark, sf_dir).select("path"), "25")




_SECRET_NAMES = ["id_rsa", ".env", ".env.local", ".env.example", "key.PEM", "pem", "release.jks", "readme.md", "credentials.json.bak"]


@query(PAGE_SQL + "SELECT page_id FROM paths WHERE page_id % 9 IN (0, 1, 2, 4, 6)")
def secret_paths(spark, sf_dir):
    """Files of nine names in the folders that pages are."""
    name = F.get(F.array(*map(F.lit, _SECRET_NAMES)), (F.col("page_id") % 9).cast("int"))
    return page_paths(spark, sf_dir).where(t.is_secret(F.concat("path", F.lit("/"), name))).select("page_id")


@query(DOC_PATH_SQL + "SELECT path FROM paths WHERE NOT list_contains(string_split(path, '/'), 'src3') AND NOT list_contains(string_split(path, '/'), 'vendor')")
def skip_dirs(spark, sf_dir):
    return document_paths(spark, sf_dir).where(~t.is_skipped(F.col("path"), [*t.SKIP_DIRS, "src3"])).select("path")


# Two versions of documents: a lacks every 11th, b lacks every 13th; b changes every 7th text, and every 17th moves.


def versions(spark, sf_dir):
    docs = document_paths(spark, sf_dir).join(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    n = F.col("doc_id")
    a = docs.where(n % 11 != 0).select("path", "size", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.timestamp_seconds(n * 10).alias("mtime"))
    new_path = F.when(n % 17 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    text = F.when(n % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    b = docs.where(n % 13 != 0).select(new_path.alias("path"), F.length(text).cast("long").alias("size"), F.sha2(text.cast("binary"), 256).alias("hash"), F.timestamp_seconds(n * 10 + n % 5 - 2).alias("mtime"))
    return a, b


_VERSIONS = (
    DOC_PATH_SQL
    + """, d AS (SELECT p.doc_id AS n, path, size, text FROM paths p JOIN documents USING (doc_id)),
    a AS (SELECT path, size, sha256(text) AS hash, n * 10 AS mtime FROM d WHERE n % 11 <> 0),
    b AS (SELECT CASE WHEN n % 17 = 0 THEN 'moved/' || path ELSE path END AS path, length(CASE WHEN n % 7 = 0 THEN text || '!' ELSE text END) AS size,
          sha256(CASE WHEN n % 7 = 0 THEN text || '!' ELSE text END) AS hash, n * 10 + n % 5 - 2 AS mtime FROM d WHERE n % 13 <> 0),
    pairs AS (SELECT path, a.size AS size_a, b.size AS size_b, a.hash AS hash_a, b.hash AS hash_b, a.mtime AS mtime_a, b.mtime AS mtime_b,
      CASE WHEN b.hash IS NULL THEN 'only_a' WHEN a.hash IS NULL THEN 'only_b' WHEN a.hash = b.hash THEN 'same' ELSE 'changed' END AS kind
      FROM a FULL JOIN b USING (path)) """
)


def pairs(spark, sf_dir):
    return t.compared(*versions(spark, sf_dir))


@query(_VERSIONS + "SELECT path, kind FROM pairs")
def compare_trees(spark, sf_dir):
    return pairs(spark, sf_dir).select("path", "kind")


@query(
    _VERSIONS
    + """, oa AS (SELECT path, hash_a AS hash, row_number() OVER (PARTITION BY hash_a ORDER BY path) AS k FROM pairs WHERE kind = 'only_a' AND size_a > 0),
    ob AS (SELECT path, hash_b AS hash, row_number() OVER (PARTITION BY hash_b ORDER BY path) AS k FROM pairs WHERE kind = 'only_b' AND size_b > 0)
    SELECT oa.path AS path_a, ob.path AS path_b FROM oa JOIN ob USING (hash, k)"""
)
def moved_files(spark, sf_dir):
    return t.moved(pairs(spark, sf_dir))


@query(
    _VERSIONS
    + """SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) || '/' ELSE '(root files)' END AS top,
    count(*) FILTER (kind <> 'only_b') AS in_a, count(*) FILTER (kind <> 'only_a') AS in_b, count(*) FILTER (kind = 'same') AS same, count(*) FILTER (kind = 'changed') AS differ,
    count(*) FILTER (kind = 'only_a') AS only_a, count(*) FILTER (kind = 'only_b') AS only_b FROM pairs GROUP BY 1"""
)
def compare_by_top(spark, sf_dir):
    return t.by_top(pairs(spark, sf_dir))


@query(
    _VERSIONS
    + """SELECT newer, count(*) AS files FROM (SELECT CASE WHEN mtime_b - mtime_a > 1 THEN 'B' WHEN mtime_a - mtime_b > 1 THEN 'A' ELSE 'same time' END AS newer
    FROM pairs WHERE kind = 'changed') GROUP BY newer"""
)
def newer_counts(spark, sf_dir):
    by = F.coalesce(t.newer(F.col("mtime_a"), F.col("mtime_b"), 1), F.lit("same time"))
    return pairs(spark, sf_dir).where("kind = 'changed'").groupBy(by.alias("newer")).agg(F.count("*").alias("files"))


@query(
    _VERSIONS
    + """SELECT only_a, newer_a, newer_b, changed, CASE WHEN only_a > 0 THEN 'NOT SAFE' WHEN newer_a > 0 THEN 'CHECK' ELSE 'SAFE' END AS verdict FROM (
    SELECT count(*) FILTER (kind = 'only_a') AS only_a, count(*) FILTER (kind = 'changed' AND mtime_a - mtime_b > 2) AS newer_a, count(*) FILTER (kind = 'changed' AND mtime_b - mtime_a > 2) AS newer_b,
    count(*) FILTER (kind = 'changed') AS changed FROM pairs)"""
)
def verdict(spark, sf_dir):
    return t.verdict(pairs(spark, sf_dir))


@query(
    _VERSIONS
    + """, common AS (SELECT DISTINCT unnest([array_to_string(string_split(path, '/')[1:i], '/') for i in range(1, len(string_split(path, '/')))]) AS folder FROM pairs WHERE kind NOT IN ('only_a', 'only_b')),
    up AS (SELECT path, size_b, unnest(range(1, len(string_split(path, '/')))) AS i FROM pairs WHERE kind = 'only_b'),
    hi AS (SELECT path, min(i) AS i FROM up WHERE array_to_string(string_split(path, '/')[1:i], '/') NOT IN (SELECT folder FROM common) GROUP BY path)
    SELECT CASE WHEN i IS NULL THEN path ELSE array_to_string(string_split(path, '/')[1:i], '/') || '/' END AS key, count(*) AS files, CAST(sum(size_b) AS BIGINT) AS bytes
    FROM pairs LEFT JOIN hi USING (path) WHERE kind = 'only_b' GROUP BY 1"""
)
def one_sided_collapse(spark, sf_dir):
    return t.one_sided(pairs(spark, sf_dir), "b")


_CHANGES = (
    _VERSIONS
    + """, c AS (SELECT path, CASE WHEN size_a IS NULL THEN 'added' WHEN size_b IS NULL THEN 'removed' WHEN size_a = size_b AND mtime_a = mtime_b THEN 'unchanged' ELSE 'updated' END AS change FROM pairs) """
)


@query(_CHANGES + "SELECT path, change FROM c")
def change_detection(spark, sf_dir):
    return t.changes(*versions(spark, sf_dir))


@query(_CHANGES + "SELECT change, count(*) AS files FROM c GROUP BY change")
def refresh_stats(spark, sf_dir):
    return t.changes(*versions(spark, sf_dir)).groupBy("change").agg(F.count("*").alias("files"))


@query(_VERSIONS + "SELECT path FROM a EXCEPT SELECT path FROM b")
def removed_antijoin(spark, sf_dir):
    a, b = versions(spark, sf_dir)
    return a.select("path").join(b.select("path"), "path", "left_anti")


@query(_VERSIONS + "SELECT path, hash_b AS hash, CASE kind WHEN 'only_b' THEN 'A' WHEN 'only_a' THEN 'D' ELSE 'M' END AS status FROM pairs WHERE kind <> 'same'")
def snapshot_diff(spark, sf_dir):
    from ..operators.snapshots import diff

    return diff(*versions(spark, sf_dir)).select("path", "hash", "status")


@query(DOC_PATH_SQL + "SELECT path, sha256(text) AS hash, strlen(text) AS size FROM paths JOIN documents USING (doc_id)")
def snapshot_manifest(spark, sf_dir):
    from ..operators.snapshots import manifest

    docs = document_paths(spark, sf_dir).drop("size").join(load(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content")), "doc_id")
    return manifest(docs)


@query(
    PAGE_SQL
    + "SELECT path, CASE WHEN path LIKE '%7' THEN 'secret' WHEN size > 2000 THEN 'size' END AS reason FROM paths WHERE path LIKE '%7' OR size > 2000"
)
def snapshot_left_out(spark, sf_dir):
    """Pages whose number ends in 7 get the name of a key file; pages of over 2,000 bytes are too large here."""
    from ..operators.snapshots import left_out

    pages = page_paths(spark, sf_dir)
    name = F.when(F.endswith("path", F.lit("7")), F.concat("path", F.lit("/key.pem"))).otherwise(F.col("path"))
    found = left_out(pages.select(name.alias("path"), F.repeat(F.lit("x"), F.col("size").cast("int")).alias("content")), 2000)
    return found.select(F.regexp_replace("path", "/key[.]pem$", "").alias("path"), "reason")


@query(
    """WITH o AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS r FROM documents), n AS (SELECT doc_id, unnest(string_split(replace(text, '.' || chr(10), '!' || chr(10)) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'end' ELSE '' END, chr(10))) AS r FROM documents),
    c AS (SELECT doc_id, r, sum(d) AS d FROM (SELECT doc_id, r, -1 AS d FROM o UNION ALL SELECT doc_id, r, 1 FROM n) GROUP BY ALL),
    s AS (SELECT doc_id, CAST(sum(greatest(d, 0)) AS BIGINT) AS added, CAST(sum(greatest(-d, 0)) AS BIGINT) AS removed FROM c GROUP BY doc_id) SELECT doc_id, added, removed FROM s WHERE added + removed > 0"""
)
def snapshot_line_changes(spark, sf_dir):
    """Documents against copies with other line ends, even ones with a line more."""
    from ..operators.snapshots import line_changes

    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    more = F.when(F.col("path") % 2 == 0, "\nend").otherwise("")
    return line_changes(docs, docs.select("path", F.concat(F.replace("text", F.lit(".\n"), F.lit("!\n")), more).alias("text"))).withColumnRenamed("path", "doc_id")


@query("SELECT doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN 'create' WHEN doc_id % 4 = 1 THEN 'overwrite' ELSE 'keep' END AS action FROM documents WHERE doc_id % 4 < 3")
def restore_preview(spark, sf_dir):
    """Of documents a quarter is gone, a quarter changed, a quarter is new since the snapshot."""
    from ..operators.snapshots import manifest
    from ..operators.snapshots import restore_preview as preview

    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    now = docs.where("path % 4 <> 0").withColumn("content", F.when(F.col("path") % 4 == 1, F.concat("content", F.lit(b"!"))).otherwise(F.col("content")))
    return preview(now, manifest(docs.where("path % 4 <> 2")))


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 1 AND doc_id % 8 = 1")
def restore_verify(spark, sf_dir):
    """A restored tree in which every eighth document was damaged afterwards."""
    from ..operators import snapshots as sn

    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    snapshot = sn.manifest(docs)
    stored = docs.select(F.sha2("content", 256).alias("hash"), "content").dropDuplicates(["hash"])
    restored = sn.restore(docs.where("path % 4 <> 1"), snapshot, stored)
    damaged = restored.withColumn("content", F.when(F.col("path") % 8 == 1, F.concat("content", F.lit(b"!"))).otherwise(F.col("content")))
    return sn.unlike(damaged, snapshot).withColumnRenamed("path", "doc_id")
