"""A Merkle manifest of a table: leaves per row, a tree per group, a root over the groups, and proofs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import cut, small, workspace

#: Nodes of a run that become one node, and levels that a block spans: a task's group has at most FAN ** LEVELS nodes.
FAN, LEVELS = 8, 4
BLOCK = FAN**LEVELS
#: Hex digits of a digest.
HEX = 64


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; null as a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def levels(n: int) -> int:
    """How many levels are above n leaves."""
    up = 0
    while n > 1:
        n, up = -(-n // FAN), up + 1
    return up


def traverse(nodes: list[str], level: int, paths: list[list[str]] | None = None) -> str:
    """The digest of a subtree of that level over its leaves. While it unwinds, a run's other digests are appended to the
    path of every leaf below each of its nodes."""
    if level == 0:
        return nodes[0]
    span = FAN ** (level - 1)
    kids = [traverse(nodes[i : i + span], level - 1, paths and paths[i : i + span]) for i in range(0, len(nodes), span)]
    if paths and len(kids) > 1:
        for k in range(len(kids)):
            others = "".join(kids[:k] + kids[k + 1 :])
            for path in paths[k * span : (k + 1) * span]:
                path.append(others)
    return digest("".join(kids))


def fold(node: str, place: int, n: int, path: str) -> str:
    """The root that a leaf at a place of n leaves gives with its path."""
    at = 0
    while n > 1:
        first = place // FAN * FAN
        others = (min(FAN, n - first) - 1) * HEX
        cut_at = at + (place - first) * HEX
        node = digest(path[at:cut_at] + node + path[cut_at : at + others])
        at, place, n = at + others, place // FAN, -(-n // FAN)
    return node


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with place (from 0, per tree, in that order) and n (nodes of the tree): sorted by ranges and numbered by what the
    parts before hold of the tree. Of the parts, one row each per tree is shuffled."""
    shards = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("tree").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    parts = nodes.repartitionByRange(shards, *by).sortWithinPartitions(*by)
    rows = cut(parts.withColumns({"part": F.spark_partition_id(), "spot": F.monotonically_increasing_id()}))
    held = rows.groupBy("tree", "part").agg(F.count("*").alias("held"), F.min("spot").alias("first"))
    before = Window.partitionBy("tree").orderBy("part")
    offsets = held.select(
        F.col("tree").alias("tree_"),
        F.col("part").alias("part_"),
        (F.sum("held").over(before) - F.col("held") - F.col("first")).alias("shift"),
        F.sum("held").over(Window.partitionBy("tree")).alias("n"),
    )
    joined = rows.join(small(cut(offsets)), F.col("tree").eqNullSafe(F.col("tree_")) & (F.col("part") == F.col("part_")))
    return joined.withColumn("place", F.col("spot") + F.col("shift")).drop("tree_", "part_", "part", "spot", "shift")


def in_blocks(nodes: DataFrame, schema: str, finish, above: DataFrame | None = None) -> DataFrame:
    """finish(rows in order, level of the block's root, row of above) of every aligned block of nodes (tree, place, n, digest,
    ...). above (tree, place, ...) has one row per block, which meets it in the task."""

    def block(table: pa.Table) -> pa.Table:
        return under_path(table, None)

    def under_path(table: pa.Table, over: pa.Table | None) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        root = over.to_pylist()[0] if over is not None else None
        return pa.Table.from_pylist(finish(rows, min(LEVELS, levels(rows[0]["n"])), root), target)

    target = to_arrow_schema(StructType.fromDDL(schema))
    blocks = nodes.withColumn("block", F.expr(f"place div {BLOCK}")).groupBy("tree", "block")
    if above is None:
        return blocks.applyInArrow(block, schema)
    return blocks.cogroup(above.withColumnRenamed("place", "block").groupBy("tree", "block")).applyInArrow(under_path, schema)


def block_roots(nodes: DataFrame, kind: str) -> DataFrame:
    """(tree, place, n, digest) of the roots of aligned blocks, nodes of a tree LEVELS higher."""

    def finish(rows: list[dict], level: int, _) -> list[dict]:
        root = traverse([r["digest"] for r in rows], level)
        return [{"tree": rows[0]["tree"], "place": rows[0]["place"] // BLOCK, "n": -(-rows[0]["n"] // BLOCK), "digest": root}]

    return cut(in_blocks(nodes.select("tree", "place", "n", "digest"), f"tree {kind}, place long, n long, digest string", finish))


def paths_of(rows: list[dict], level: int) -> list[str]:
    """The siblings that the own block appends to each of its nodes."""
    paths: list[list[str]] = [[] for _ in rows]
    traverse([r["digest"] for r in rows], level, paths)
    return ["".join(p) for p in paths]


def with_paths(nodes: DataFrame, kind: str, above: DataFrame | None) -> DataFrame:
    """(tree, place, n, digest, path): what the own block appends, then the path of its root from above."""

    def finish(rows: list[dict], level: int, over: dict | None) -> list[dict]:
        return [{**r, "path": p + (over["path"] if over else "")} for r, p in zip(rows, paths_of(rows, level), strict=True)]

    schema = f"tree {kind}, place long, n long, digest string, path string"
    return cut(in_blocks(nodes.select("tree", "place", "n", "digest"), schema, finish, above and above.select("tree", "place", "path")))


def climb(nodes: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(roots, above) of nodes (tree, place, n, digest): a root per tree, and the block roots of nodes with their paths. Block
    roots are nodes of the next traversal, until every tree has one."""
    stories = [block_roots(nodes, kind)]
    while not stories[-1].where("n > 1").isEmpty():
        stories.append(block_roots(stories[-1], kind))
    above = None
    for story in reversed(stories):
        above = with_paths(story, kind, above)
    return stories[-1].select("tree", F.col("digest").alias("root")), above


def manifest(docs: DataFrame, key: str, group: str, leaf_: Column, tampered: Column | None = None) -> DataFrame:
    """One row per row of docs: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    A tree per value of group holds its leaves by ascending key; every FAN consecutive nodes, the last run fewer, become the
    digest of their digests until one remains, and the trees' roots, ordered by group, likewise give root. proof_sha256 is
    the digest of a leaf's siblings from below to above. folded_root is what tampered (a digest, null where nothing was
    tampered with) or else the leaf gives with the original siblings, and verified whether that is root.

    Rows are numbered by a range sort; aligned blocks of 4,096 leaves are traversed in postorder, and their roots are
    the leaves of a further distributed traversal, so a task holds one block. A block is traversed again once the path above
    it is known; siblings of leaves are never written. Null keys come first, null groups form a tree that comes first, and
    rows of one key follow each other by their leaves; such order can only change proofs of equal keys. Null and empty texts
    differ in their leaves; long ones are digested whole. Repeated rows are leaves each. No rows give no rows. Other
    columns, whatever their names, are ignored unless leaf_ names them.
    """
    kind, key_kind = (docs.schema[c].dataType.simpleString() for c in (group, key))
    made = docs.select(F.col(group).alias("tree"), F.col(key).alias("key"), leaf_.alias("digest"), (F.lit(None).cast("string") if tampered is None else tampered).alias("tampered"))
    with workspace(docs.sparkSession) as keep:
        leaves = cut(made.withColumn("row", F.monotonically_increasing_id()))
        nodes = keep(cut(ranked(leaves, ["key", "digest", "row"]).drop("row")))
        roots, above = climb(nodes, kind)
        tops = cut(ranked(roots.select(F.lit(0).alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")), ["name"]))
        root, over_tops = climb(tops, "int")
        top_paths = with_paths(tops, "int", over_tops).select("tree", "place", F.col("path").alias("top_path"))
        ends = tops.join(top_paths, ["tree", "place"]).join(root, "tree")
        ends = cut(ends.select("name", F.col("digest").alias("subroot"), "root", F.col("place").alias("top_place"), F.col("n").alias("top_n"), "top_path"))
        given = above.join(small(ends), above.tree.eqNullSafe(ends.name))
        given = keep(cut(given.select("tree", "place", "path", "subroot", "root", "top_place", "top_n", "top_path")))

    def finish(rows: list[dict], level: int, over: dict) -> list[dict]:
        found = []
        for r, own in zip(rows, paths_of(rows, level), strict=True):
            path = own + over["path"]
            folded = fold(r["tampered"] or r["digest"], r["place"], r["n"], path)
            folded = fold(folded, over["top_place"], over["top_n"], over["top_path"])
            ends = {"subroot": over["subroot"], "root": over["root"], "proof_sha256": digest(path + over["top_path"])}
            found.append({"key": r["key"], "leaf": r["digest"], **ends, "folded_root": folded, "verified": folded == over["root"]})
        return found

    schema = f"key {key_kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return in_blocks(nodes, schema, finish, given).withColumnRenamed("key", key)


CAPITALS, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(*fields, F.translate("text", CAPITALS, LOWER)))
    return manifest(docs, "doc_id", "lang", leaf(*fields, F.col("text")), lowered)


#: The same rows by a recursive query. crc32 is computed from its polynomial, bit by bit.
SQL = r"""
WITH RECURSIVE
crc(doc_id, rest, c) AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), CAST(4294967295 AS UBIGINT) FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, rest[2:], list_reduce(list_prepend(xor(c, CAST(ascii(rest) AS UBIGINT)), range(8)::UBIGINT[]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS UBIGINT) ELSE CAST(0 AS UBIGINT) END))
  FROM crc WHERE rest <> ''),
marked AS (SELECT doc_id, xor(c, CAST(4294967295 AS UBIGINT)) % 3 = 0 AS hit FROM crc WHERE rest = ''),
fields AS (
  SELECT d.doc_id, lang, text, coalesce(hit, false) AND text IS NOT NULL AS hit,
    CASE WHEN d.doc_id IS NULL THEN '-' ELSE strlen(d.doc_id::VARCHAR) || ':' || d.doc_id END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
    || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head
  FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id),
hashed AS (
  SELECT doc_id, lang, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    CASE WHEN hit THEN sha256(head || strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) END AS tampered
  FROM fields),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed),
nodes(tree, lvl, place, node) AS (
  SELECT lang, 0, place, leaf FROM leaves
  UNION ALL
  SELECT tree, any_value(lvl) + 1, place // 8, sha256(string_agg(node, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes) WHERE n > 1 GROUP BY tree, place // 8),
sizes AS (SELECT tree, lvl, count(*) AS n FROM nodes GROUP BY tree, lvl),
subroots AS (
  SELECT nodes.tree, node AS subroot, row_number() OVER (ORDER BY nodes.tree NULLS FIRST) - 1 AS top
  FROM nodes JOIN sizes ON sizes.tree IS NOT DISTINCT FROM nodes.tree AND sizes.lvl = nodes.lvl WHERE n = 1),
tops(lvl, place, node) AS (
  SELECT 0, top, subroot FROM subroots
  UNION ALL
  SELECT any_value(lvl) + 1, place // 8, sha256(string_agg(node, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY place // 8),
root AS (SELECT node AS root FROM tops ORDER BY lvl DESC LIMIT 1),
steps AS (
  SELECT l.lang, l.place, x.lvl, string_agg(s.node, '' ORDER BY s.place) FILTER (s.place < l.place // CAST(8 ** x.lvl AS BIGINT)) AS lefts,
    string_agg(s.node, '' ORDER BY s.place) FILTER (s.place > l.place // CAST(8 ** x.lvl AS BIGINT)) AS rights
  FROM leaves l JOIN sizes x ON x.tree IS NOT DISTINCT FROM l.lang AND x.n > 1
  JOIN nodes s ON s.tree IS NOT DISTINCT FROM l.lang AND s.lvl = x.lvl AND s.place // 8 = l.place // CAST(8 ** (x.lvl + 1) AS BIGINT)
  GROUP BY ALL),
top_steps AS (
  SELECT r.tree, x.lvl, string_agg(s.node, '' ORDER BY s.place) FILTER (s.place < r.top // CAST(8 ** x.lvl AS BIGINT)) AS lefts,
    string_agg(s.node, '' ORDER BY s.place) FILTER (s.place > r.top // CAST(8 ** x.lvl AS BIGINT)) AS rights
  FROM subroots r JOIN (SELECT lvl, count(*) AS n FROM tops GROUP BY lvl) x ON x.n > 1
  JOIN tops s ON s.lvl = x.lvl AND s.place // 8 = r.top // CAST(8 ** (x.lvl + 1) AS BIGINT)
  GROUP BY ALL),
walk AS (
  SELECT l.doc_id, l.lang, l.place, leaf, tampered, subroot, root,
    coalesce((SELECT list({'a': coalesce(lefts, ''), 'b': coalesce(rights, '')} ORDER BY lvl) FROM steps s WHERE s.lang IS NOT DISTINCT FROM l.lang AND s.place = l.place), [])
    || coalesce((SELECT list({'a': coalesce(lefts, ''), 'b': coalesce(rights, '')} ORDER BY lvl) FROM top_steps t WHERE t.tree IS NOT DISTINCT FROM l.lang), []) AS path
  FROM leaves l JOIN subroots r ON r.tree IS NOT DISTINCT FROM l.lang CROSS JOIN root),
folded AS (
  SELECT *, list_reduce(list_prepend(coalesce(tampered, leaf), list_transform(path, lambda x: x.a || '|' || x.b)), lambda node, x: sha256(replace(x, '|', node))) AS folded_root FROM walk)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.a || x.b), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded
"""
