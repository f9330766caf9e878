"""Queries on project folders and build output. Pages are files by their urls, events lines of a build log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as d
from ..operators import projects as p
from ..operators.trees import compared
from ..sources.tables import PAGE_SQL, load, page_paths
from .registry import query


@query(
    PAGE_SQL
    + """, f AS (SELECT DISTINCT path FROM paths WHERE path LIKE 'm.%' AND path NOT LIKE '%/.%'), d AS (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS k FROM f)
    SELECT path, FALSE AS is_dir FROM f UNION ALL SELECT DISTINCT array_to_string(string_split(path, '/')[1:k], '/'), TRUE FROM d"""
)
def entries_below(spark, sf_dir):
    """Files and folders of the mobile hosts."""
    tree = page_paths(spark, sf_dir).select("path").distinct().where("path LIKE 'm.%'")
    return p.entries_below(tree)


@query(PAGE_SQL + "SELECT regexp_extract(path, '^(.*?/(?:de|fr))/', 1) AS folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM paths WHERE regexp_matches(path, '/(de|fr)/') GROUP BY 1")
def folded_generated(spark, sf_dir):
    """German and French folders stand for what a build makes."""
    return p.folded_generated(page_paths(spark, sf_dir), ["de", "fr"])


@query(
    PAGE_SQL
    + """, t AS (SELECT regexp_extract(path, '/(de|fr|es)/', 1) AS name, page_id, size FROM paths WHERE regexp_matches(path, '/(de|fr|es)/'))
    SELECT name, CAST(coalesce(sum(size) FILTER (page_id % 2 = 0 AND name <> 'es'), 0) AS BIGINT) AS bytes_a, CAST(coalesce(sum(size) FILTER (page_id % 2 = 1 AND name <> 'de'), 0) AS BIGINT) AS bytes_b FROM t GROUP BY name"""
)
def skipped_by_name(spark, sf_dir):
    """Even pages without Spanish against odd pages without German."""
    tree = page_paths(spark, sf_dir)
    return p.skipped_by_name(tree.where("page_id % 2 = 0 AND path NOT LIKE '%/es/%'"), tree.where("page_id % 2 = 1 AND path NOT LIKE '%/de/%'"), ["de", "fr", "es"])


@query(PAGE_SQL + """, f AS (SELECT regexp_extract(path, '^([^/]*)', 1) AS project, path, coalesce(list_position(['1', '10', '100', '200', '300'], regexp_extract(path, '([^/]*)$', 1)), 0) AS a, len(string_split(path, '/')) AS d FROM paths)
    SELECT project, path FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY a, d, path) AS r FROM f WHERE a > 0 AND d <= 6) WHERE r = 1""")
def entry_point(spark, sf_dir):
    """Hosts are projects, pages of some numbers their entry points."""
    tree = page_paths(spark, sf_dir).withColumn("project", F.substring_index("path", "/", 1))
    return p.entry_point(tree, names=["1", "10", "100", "200", "300"])


MARKER_FILES = ["package.json", "api/pyproject.toml", "Cargo.toml", "readme", "settings.gradle", "go.mod", "pubspec.yaml", "x/pom.xml", "docs/a.md"]


@query(
    """WITH r AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS project, CASE page_id % 9 WHEN 4 THEN 0 WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 7 THEN 3 WHEN 1 THEN 4 WHEN 5 THEN 5 WHEN 6 THEN 6 END AS rank FROM pages)
    SELECT project, ['android', 'web', 'rust', 'java', 'python', 'go', 'dart'][min(rank) + 1] AS stack FROM r GROUP BY project"""
)
def project_stack(spark, sf_dir):
    """Hosts as projects, each page a file of it."""
    pages = load(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("project"), F.get(F.array(*map(F.lit, MARKER_FILES)), (F.col("page_id") % 9).cast("int")).alias("path"))
    return p.stack(pages)


@query(
    """WITH i AS (SELECT DISTINCT 'd' || doc_id || '.ts' AS path, regexp_extract(text, '^(\\w+)', 1) AS package FROM documents WHERE regexp_matches(text, '^[a-zA-Z]+ '))
    SELECT package, count(DISTINCT path) AS files, string_agg(path, ',' ORDER BY path) AS names FROM i GROUP BY package"""
)
def importing_files(spark, sf_dir):
    """Each document imports its first word, if that is ASCII letters and a blank behind them."""
    first = F.regexp_extract("text", r"^(\w+)", 1)
    docs = load(spark, sf_dir, "documents").where(F.col("text").rlike("^[a-zA-Z]+ "))
    files = docs.select(F.concat(F.lit("d"), "doc_id", F.lit(".ts")).alias("path"), F.concat(F.lit("// from 'no'\nimport { x } from '"), first, F.lit("/sub'\nimport './local'\n")).alias("content"))
    return p.importing_files(p.imports(files, ["@"])).select("package", "files", F.array_join("names", ",").alias("names"))


@query("SELECT doc_id, '@' || doc_id || ',~' || lang || ',lib' AS aliases FROM documents")
def path_aliases(spark, sf_dir):
    """A configuration with comments per document."""
    head = '{\n  // "paths": { "no/*": [] }\n  "compilerOptions": { /* "paths": more */\n    "paths": {\n      "@'
    config = F.concat(F.lit(head), "doc_id", F.lit('/*": ["./src/*"],\n      // "not": []\n      "~'), "lang", F.lit('/*": ["./app/*"],\n      "lib": ["./lib"]\n    }\n  }\n}'))
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(p.path_aliases(config), ",").alias("aliases"))


@query("SELECT o_custkey AS project, max(o_orderdate) AS mtime, min(path) AS path FROM (SELECT *, 'o' || o_orderkey AS path, max(o_orderdate) OVER (PARTITION BY o_custkey) AS newest FROM orders WHERE o_orderstatus = 'F') WHERE o_orderdate = newest GROUP BY o_custkey")
def newest_artifact(spark, sf_dir):
    """The last filled order of each customer."""
    tree = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.concat(F.lit("o"), "o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"), "o_orderstatus")
    return p.newest(tree, F.col("o_orderstatus") == "F")


@query("SELECT max(CAST(json_extract(props, '$.k') AS BIGINT)) + 1 AS next FROM events")
def next_version(spark, sf_dir):
    """The k of events stands for versions in build files."""
    files = load(spark, sf_dir, "events").select(F.concat(F.lit("x\n versionCode = "), F.get_json_object("props", "$.k"), F.lit("\n versionCode 7")).alias("content"))
    return p.next_version(files)


@query("SELECT event_id, 'a versionCode ' || (CAST(json_extract(props, '$.k') AS BIGINT) + 1) || ' versionCode 7' AS text FROM events")
def bumped_version(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", F.concat(F.lit("a versionCode "), F.get_json_object("props", "$.k"), F.lit(" versionCode 7")).alias("text"))
    return rows.withColumn("text", p.with_version(F.col("text"), p.version_of(F.col("text")) + 1))


@query("SELECT count(*) FILTER (l_returnflag <> 'N' AND l_linestatus <> 'O') AS staged, count(*) FILTER (l_returnflag <> 'N') AS unstaged, count(*) FILTER (l_returnflag = 'N') AS untracked FROM lineitem")
def status_counters(spark, sf_dir):
    """Line items as files: new ones are untracked, filled ones staged."""
    code = F.when(F.col("l_returnflag") == "N", "??").when(F.col("l_linestatus") == "O", F.concat(F.lit(" "), "l_returnflag")).otherwise(F.concat("l_linestatus", "l_returnflag"))
    return p.status_counts(load(spark, sf_dir, "lineitem").select(code.alias("code")))


@query("SELECT o_orderkey AS path, added, deleted FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS added, CAST(sum(l_linenumber) AS BIGINT) AS deleted FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def changed_with_numstat(spark, sf_dir):
    stats = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("path")).agg(F.count("*").alias("added"), F.sum("l_linenumber").alias("deleted"))
    return p.with_numstat(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path")), stats)


@query(
    PAGE_SQL
    + """, a AS (SELECT path, sum(size) AS size FROM paths GROUP BY path), b AS (SELECT path, sum(size) FILTER (page_id % 2 = 0) AS size FROM paths GROUP BY path)
    SELECT path, CAST(coalesce(b.size, 0) - a.size AS BIGINT) AS change FROM a LEFT JOIN b USING (path) ORDER BY abs(change) DESC, path LIMIT 20"""
)
def by_size_change(spark, sf_dir):
    """The twenty paths whose size changes most between all pages and even ones."""
    tree = page_paths(spark, sf_dir)
    side = lambda t: t.groupBy("path").agg(F.sum("size").alias("size")).withColumn("hash", F.col("size"))
    return p.by_size_change(compared(side(tree), side(tree.where("page_id % 2 = 0")))).select("path", "change").limit(20)


@query(
    """SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'build output' WHEN 2 THEN 'git history: keep' WHEN 3 THEN 'IDE settings' WHEN 4 THEN 'dependencies' WHEN 6 THEN 'dependencies' ELSE '' END AS tag FROM pages"""
)
def folder_kinds(spark, sf_dir):
    """Folders below the hosts of pages."""
    names = ["build", "src/a/build", ".git", "x/.idea", "node_modules", "docs", "ios/Pods"]
    path = F.concat(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1), F.lit("/"), F.get(F.array(*map(F.lit, names)), (F.col("page_id") % 7).cast("int")))
    return load(spark, sf_dir, "pages").select("page_id", p.kind_tag(path).alias("tag"))


@query(
    """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://github.com/o.x/p-' || page_id ELSE 'https://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '/o/p-' || page_id END AS url FROM pages"""
)
def remote_urls(spark, sf_dir):
    """Remotes of four forms on the hosts of pages."""
    host, name = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1), F.concat(F.lit("p-"), "page_id")
    n = F.col("page_id") % 4
    remote = F.when(n == 0, F.concat(F.lit("o.x/"), name)).when(n == 1, F.concat(F.lit("git@"), host, F.lit(":o/"), name, F.lit(".git")))
    remote = remote.when(n == 2, F.concat(F.lit("ssh://git@"), host, F.lit("/o/"), name)).otherwise(F.concat(F.lit(" https://"), host, F.lit("/o/"), name, F.lit(".git/ ")))
    return load(spark, sf_dir, "pages").select("page_id", p.remote_url(remote).alias("url"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&') AS text FROM pages")
def xml_text(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", p.xml_text(F.col("html")).alias("text"))


@query(
    r"""WITH known AS (SELECT DISTINCT string_split(text, ' ')[1] AS path FROM benchmark), w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(1, len(string_split(text, ' ')) + 1)) AS n FROM documents WHERE text <> '')
    SELECT doc_id, string_agg(CASE WHEN path IS NOT NULL THEN replace(word, path, '<' || path || '>') ELSE word END, ' ' ORDER BY n) AS text
    FROM w LEFT JOIN known ON path = regexp_extract(word, '^["''(\[`]*(.*?)["'')\]`.,;:]*$', 1) AND regexp_matches(path, '^[A-Za-z]+$') GROUP BY doc_id"""
)
def shortened_paths(spark, sf_dir):
    """First words of benchmark items stand for paths, in brackets for their short form; only words of ASCII letters."""
    known = load(spark, sf_dir, "benchmark").select(F.substring_index("text", " ", 1).alias("path")).distinct().where(F.col("path").rlike("^[A-Za-z]+$"))
    docs = load(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.col("text"))
    return p.shortened(docs, known.withColumn("short", F.concat(F.lit("<"), "path", F.lit(">"))), "doc_id")


@query("SELECT doc_id, 'A' || doc_id || '_KEY,HOME_' || upper(lang) AS names, 'c:/dev/' || source || '/d' || doc_id AS folder, doc_id % 3 = 0 AS zip FROM documents")
def build_file_facts(spark, sf_dir):
    """A build file, a cache and an archive's first bytes per document."""
    build = F.concat(F.lit('key = System.getenv("A'), "doc_id", F.lit('_KEY"); lower = getenv("none"); x = process.env.HOME_'), F.upper("lang"))
    cache = F.concat(F.lit("A=1\nCMAKE_HOME_DIRECTORY:INTERNAL=C:\\Dev\\"), "source", F.lit("\\D"), "doc_id", F.lit("\\\nB=2\n"))
    content = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit(b"PK\x03\x04")).otherwise(F.lit(b"PK\x03")), F.col("text").cast("binary"))
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(p.environment_names(build), ",").alias("names"), p.cache_dir(cache).alias("folder"), p.is_zip(content).alias("zip"))


# Build output


_LOG = """WITH log AS (SELECT event_id AS pos, user_id AS pid, CASE event_type WHEN 'error' THEN 'error[E' || (event_id % 3) || ']: bad thing' WHEN 'purchase' THEN 'warning: unused ' || (event_id % 2)
  WHEN 'click' THEN '  --> src/f' || (event_id % 5) || '.rs:1:2' WHEN 'signup' THEN 'error: could not compile x' ELSE 'note ' || event_type END AS line FROM events) """


def build_log(spark, sf_dir):
    """Events as lines of a compiler: errors and purchases are headers, clicks places, signups sum up."""
    n = F.col("event_id")
    kind = F.col("event_type")
    line = (
        F.when(kind == "error", F.concat(F.lit("error[E"), n % 3, F.lit("]: bad thing"))).when(kind == "purchase", F.concat(F.lit("warning: unused "), n % 2))
        .when(kind == "click", F.concat(F.lit("  --> src/f"), n % 5, F.lit(".rs:1:2"))).when(kind == "signup", "error: could not compile x").otherwise(F.concat(F.lit("note "), kind))
    )
    return load(spark, sf_dir, "events").select(n.alias("pos"), F.col("user_id").alias("pid"), line.alias("line"))


@query(_LOG + "SELECT severity, count(*) AS n FROM (SELECT CASE WHEN line LIKE 'error: could%' THEN NULL WHEN line LIKE 'error%' THEN 'error' WHEN line LIKE 'warning%' THEN 'warning' END AS severity FROM log) GROUP BY severity")
def diagnostic_severity(spark, sf_dir):
    return build_log(spark, sf_dir).groupBy(d.severity(F.col("line")).alias("severity")).agg(F.count("*").alias("n"))


@query(
    _LOG
    + """, m AS (SELECT *, line LIKE '%-->%' AS arrow, CASE WHEN line LIKE 'error: could%' THEN NULL WHEN line LIKE 'error%' THEN 'error' WHEN line LIKE 'warning%' THEN 'warning' END AS severity FROM log),
    h AS (SELECT *, lead(arrow) OVER w AS hit, lead(line) OVER w AS place FROM m WHERE arrow OR severity IS NOT NULL WINDOW w AS (PARTITION BY pid ORDER BY pos))
    SELECT pid, severity, CASE WHEN hit THEN trim(replace(place, '-->', '')) ELSE '' END AS location, line AS message, min(pos) AS pos FROM h WHERE severity IS NOT NULL GROUP BY ALL"""
)
def paired_headers(spark, sf_dir):
    return d.paired_headers(build_log(spark, sf_dir), ["pid"])


@query(
    _LOG
    + """, b AS (SELECT *, sum(CASE WHEN line LIKE 'error[%' THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY pos) AS b FROM log),
    c AS (SELECT *, max(CASE WHEN line LIKE 'error: could%' THEN 1 ELSE 0 END) OVER (PARTITION BY pid, b ORDER BY pos) AS c FROM b)
    SELECT pid, min(pos) AS first, max(pos) AS last, min_by(line, pos) AS head, count(*) AS rows FROM c WHERE b > 0 AND c = 0 GROUP BY pid, b"""
)
def failure_blocks(spark, sf_dir):
    line = F.col("line")
    return d.failure_blocks(build_log(spark, sf_dir), ["pid"], F.startswith(line, F.lit("error[")), F.startswith(line, F.lit("error: could")))


@query(
    _LOG
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY pos) AS rn FROM log), x AS (SELECT a.pos AS crash, b.pos, b.line AS msg, row_number() OVER (PARTITION BY a.pos ORDER BY b.pos) AS r
    FROM n a JOIN n b ON a.pid = b.pid AND b.rn > a.rn AND b.rn <= a.rn + 7 WHERE a.line LIKE 'error[%' AND b.line LIKE '%-->%') SELECT crash, pos, msg FROM x WHERE r = 1"""
)
def crash_reason(spark, sf_dir):
    """The first place named within seven lines of the same process behind an error."""
    log = build_log(spark, sf_dir).withColumnRenamed("line", "msg")
    return d.reasons(log, F.startswith("msg", F.lit("error[")), F.contains("msg", F.lit("-->")), 7)


@query(
    """SELECT doc_id, 'src\\' || lang || '.kt:' || doc_id || ' and lib/x.c' AS rel, CASE WHEN doc_id % 2 = 0 THEN 'http://localhost:' || (3000 + doc_id % 5000) || '/' ELSE 'http://10.0.0.2:' || (3000 + doc_id % 5000) || '/' END AS url,
    CAST(3000 + doc_id % 5000 AS INTEGER) AS port, 'https://' || source || '.example/' || doc_id AS deployed, CAST(n_chars AS INTEGER) AS frames, CAST(doc_id % 100 AS INTEGER) AS janky, CAST(doc_id % 10 AS DOUBLE) + 0.5 AS share, CAST(doc_id AS INTEGER) AS cold FROM documents"""
)
def output_scalars(spark, sf_dir):
    """Output of tools per document, with its paths, addresses and numbers."""
    n, port = F.col("doc_id"), 3000 + F.col("doc_id") % 5000
    text = F.concat(F.lit("C:\\Dev\\App\\src\\"), "lang", F.lit(".kt:"), n, F.lit(" and c:/dev/app/lib/x.c"))
    server = F.concat(F.lit("  \x1b[32mNetwork\x1b[0m: http://10.0.0.2:"), port, F.lit("/\n"), F.when(n % 2 == 0, F.concat(F.lit("  Local: \x1b[36mhttp://localhost:"), port, F.lit("/\x1b[0m\n"))).otherwise(""))
    address = F.concat(F.lit("https://"), "source", F.lit(".example/"), n)
    report = F.when(n % 2 == 0, F.concat(F.lit('{"url": "'), address, F.lit('"}'))).otherwise(F.concat(F.lit("see https://first.example, now at "), address))
    stats = d.frame_stats(F.concat(F.lit("Total frames rendered: "), "n_chars", F.lit("\nJanky frames: "), n % 100, F.lit(" ("), n % 10, F.lit(".5%)\n")))
    url = d.served_url(server)
    return load(spark, sf_dir, "documents").select(
        "doc_id", d.relative(text, "C:/Dev/App").alias("rel"), url.alias("url"), d.port(url).alias("port"), d.deploy_url(report).alias("deployed"), stats["frames"].cast("int").alias("frames"),
        stats["janky"].cast("int").alias("janky"), stats["janky_percent"].alias("share"), d.number_after(F.concat(F.lit("TotalTime: "), n, F.lit("\n")), "TotalTime").cast("int").alias("cold"),
    )


@query("SELECT conv_id, turn, contains(text, 'tion') AS named FROM conversations")
def of_package(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations")
    named = d.of_package(rows, "tion", "text").select("conv_id", "turn", "text", F.lit(True).alias("n")).distinct()
    return rows.join(named, ["conv_id", "turn", "text"], "left").select("conv_id", "turn", F.coalesce("n", F.lit(False)).alias("named"))


@query("SELECT page_id, list_sort(list_distinct(list_transform(string_split(url, '/'), lambda w: lower(w)))) = list_sort(list_distinct(list_transform(list_reverse(string_split(url, '/')), lambda w: lower(upper(w))))) AS same FROM pages")
def same_keywords(spark, sf_dir):
    parts = F.split("url", "/")
    return load(spark, sf_dir, "pages").select("page_id", d.same_keywords(parts, F.transform(F.reverse(parts), F.upper)).alias("same"))
