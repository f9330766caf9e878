"""Lookup and graph queries. Symbols are parts, suppliers and customers; edges run supplier -> part -> order -> customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import lookup as k
from ..operators.storage import kept
from ..sources.tables import load
from .registry import query


def named(spark, sf_dir):
    """(id, name, owner, path): suppliers, customers (owner their nation) and parts (owner their brand)."""
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = load(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    customer = load(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = lambda df, kind, key, name, owner: df.select(F.concat(F.lit(kind + ":"), key).alias("id"), F.col(name).alias("name"), F.col(owner).alias("owner"), F.concat(F.lit(kind + "/"), F.col(owner), F.lit("/x")).alias("path"))
    part = load(spark, sf_dir, "part")
    return rows(supplier, "s", "s_suppkey", "s_name", "n_name").union(rows(customer, "c", "c_custkey", "c_name", "n_name")).union(rows(part, "p", "p_partkey", "p_name", "p_brand"))


_NAMED = """WITH named AS (
  SELECT 's:' || s_suppkey AS id, s_name AS name, n_name AS owner, 's/' || n_name || '/x' AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'c:' || c_custkey, c_name, n_name, 'c/' || n_name || '/x' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'p:' || p_partkey, p_name, p_brand, 'p/' || p_brand || '/x' FROM part) """


@query(_NAMED + "SELECT id, name FROM named WHERE lower(name) = 'red plate'")
def exact_name_any_case(spark, sf_dir):
    return k.candidates(named(spark, sf_dir), "Red PLATE").select("id", "name")


@query(_NAMED + "SELECT id, name FROM named WHERE lower(owner) = 'brand#2' AND lower(name) = 'red plate'")
def owner_name(spark, sf_dir):
    return k.candidates(named(spark, sf_dir), "Brand#2::red plate").select("id", "name")


@query(_NAMED + "SELECT id, name FROM named WHERE lower(name) = 'red plate' AND lower(path) LIKE '%/brand#2/x'")
def path_suffix_name(spark, sf_dir):
    return k.candidates(named(spark, sf_dir), "Brand#2/x:red plate").select("id", "name")


@query(_NAMED + "SELECT id, name FROM named WHERE contains(lower(name), '#00000001') ORDER BY path, name, id LIMIT 8")
def fuzzy_name(spark, sf_dir):
    return k.candidates(named(spark, sf_dir), "#00000001", order=("path", "name", "id")).select("id", "name")


@query(_NAMED + """, q AS (SELECT 'supplier#000000003' AS q UNION ALL SELECT 'no such name'),
  t AS (SELECT q, id, CASE WHEN lower(name) = q THEN 1 WHEN contains(lower(name), q) THEN 4 END AS tier FROM named, q)
  SELECT q, id, tier FROM (SELECT *, min(tier) OVER (PARTITION BY q) AS best FROM t WHERE tier IS NOT NULL) WHERE tier = best""")
def candidate_cascade(spark, sf_dir):
    rows = named(spark, sf_dir)
    one = lambda q: k.candidates(rows, q).select(F.lit(q.lower()).alias("q"), "id", "tier")
    return one("Supplier#000000003").union(one("no such name"))


@query("SELECT p_name, distance FROM (SELECT DISTINCT p_name, levenshtein(lower(p_name), 'rde plate') AS distance FROM part) WHERE distance = (SELECT min(levenshtein(lower(p_name), 'rde plate')) FROM part) AND distance <= 2 ORDER BY p_name LIMIT 3")
def closest_name_levenshtein(spark, sf_dir):
    return k.closest_names(load(spark, sf_dir, "part"), "p_name", "rde plate")


@query(
    r"""WITH c AS (SELECT item_id, lower(regexp_replace(text, '\s', '', 'g')) AS t, length(text) AS n FROM benchmark),
    g AS (SELECT item_id, n, length(t) - 1 AS m, substr(t, i, 2) AS gram FROM (SELECT *, unnest(range(1, length(t))) AS i FROM c)),
    k AS (SELECT item_id, n, m, gram, count(*) AS k FROM g GROUP BY ALL),
    s AS (SELECT a.item_id AS probe_id, b.item_id AS line_id, 2.0 * sum(least(a.k, b.k)) / (a.m + b.m) AS dice FROM k a JOIN k b ON a.gram = b.gram AND a.item_id <> b.item_id
      WHERE b.n >= 0.5 * a.n AND b.n <= 2 * a.n GROUP BY a.item_id, b.item_id, a.m, b.m)
    SELECT probe_id, line_id, dice FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY dice DESC, line_id) AS r FROM s WHERE dice >= 0.6) WHERE r = 1"""
)
def closest_line_dice(spark, sf_dir):
    """Of each benchmark item the other item that resembles it most."""
    items = load(spark, sf_dir, "benchmark")
    probes = items.select(F.col("item_id").alias("probe_id"), F.col("text").alias("probe"))
    return k.closest_line(probes, items.select(F.col("item_id").alias("line_id"), F.col("text").alias("line")), others=True)


def edges(spark, sf_dir):
    """supplier -> part and part -> order from lineitem, order -> customer; kind CALLS, or DISPATCH for returned lines."""
    line, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    kind = F.when(F.col("l_returnflag") == "R", "DISPATCH").otherwise("CALLS").alias("kind")
    node = lambda mark, key: F.concat(F.lit(mark + ":"), F.col(key))
    rows = line.select(node("s", "l_suppkey").alias("from_id"), node("p", "l_partkey").alias("to_id"), kind)
    rows = rows.union(line.select(node("p", "l_partkey"), node("o", "l_orderkey"), kind))
    return g.distinct_edges(rows.union(orders.select(node("o", "o_orderkey"), node("c", "o_custkey"), F.lit("CALLS"))))


_EDGES = """WITH RECURSIVE raw AS (
  SELECT 's:' || l_suppkey AS from_id, 'p:' || l_partkey AS to_id, CASE l_returnflag WHEN 'R' THEN 'DISPATCH' ELSE 'CALLS' END AS kind FROM lineitem
  UNION ALL SELECT 'p:' || l_partkey, 'o:' || l_orderkey, CASE l_returnflag WHEN 'R' THEN 'DISPATCH' ELSE 'CALLS' END FROM lineitem
  UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 'CALLS' FROM orders),
  edges AS (SELECT from_id, to_id, min(kind) AS kind FROM raw GROUP BY from_id, to_id)"""


@query(_EDGES + " SELECT from_id, to_id, kind FROM edges")
def call_edges(spark, sf_dir):
    return edges(spark, sf_dir)


def _seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


@query(_EDGES + " SELECT DISTINCT from_id AS id FROM edges WHERE to_id IN ('p:3', 'p:5')")
def callers_of(spark, sf_dir):
    return g.callers(edges(spark, sf_dir), _seed(spark, "p:3", "p:5"))


@query(_EDGES + " SELECT DISTINCT to_id AS id FROM edges WHERE from_id IN ('p:3', 'p:5')")
def callees_of(spark, sf_dir):
    return g.callees(edges(spark, sf_dir), _seed(spark, "p:3", "p:5"))


_WALK = """, down AS (SELECT 'p:3' AS id, 0 AS hop UNION SELECT to_id, hop + 1 FROM down JOIN edges ON from_id = id WHERE hop < 2),
  up AS (SELECT 'p:3' AS id, 0 AS hop UNION SELECT from_id, hop + 1 FROM up JOIN edges ON to_id = id WHERE hop < 2) """


@query(_EDGES + _WALK + "SELECT from_id, to_id, kind FROM edges WHERE from_id IN (SELECT id FROM down WHERE hop < 2) OR to_id IN (SELECT id FROM up WHERE hop < 2)")
def khop_neighbourhood(spark, sf_dir):
    return g.neighbourhood(kept(edges(spark, sf_dir)), _seed(spark, "p:3"), 2)


@query(_EDGES + ", down AS (SELECT 's:1' AS id, 0 AS hop UNION SELECT to_id, hop + 1 FROM down JOIN edges ON from_id = id WHERE hop < 3) SELECT id, min(hop) AS hop FROM down GROUP BY id")
def min_hop(spark, sf_dir):
    return g.reached(kept(edges(spark, sf_dir)), _seed(spark, "s:1"), 3)


@query("SELECT 'Brand#2' AS node UNION ALL SELECT p_brand || '.' || p_partkey FROM part WHERE p_brand = 'Brand#2'")
def class_extent(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    nodes = part.select(F.col("p_brand").alias("node")).distinct().union(part.select(F.concat_ws(".", "p_brand", "p_partkey")))
    return g.extent(nodes, "Brand#2")


@query("SELECT p_brand AS folder, count(DISTINCT p_type) AS files, count(*) AS symbols FROM part GROUP BY p_brand")
def map_symbols_per_folder(spark, sf_dir):
    return load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("folder")).agg(F.count_distinct("p_type").alias("files"), F.count("*").alias("symbols"))


@query(
    _EDGES
    + """, f AS (SELECT 's:' || s_suppkey AS id, 'nation' || s_nationkey AS file, s_name AS name FROM supplier UNION ALL SELECT 'p:' || p_partkey, p_brand, p_name FROM part),
    c AS (SELECT a.file AS ff, a.name AS fn, b.file AS tf, b.name AS tn FROM edges e JOIN f a ON e.from_id = a.id JOIN f b ON e.to_id = b.id WHERE a.file <> b.file AND (a.file = 'Brand#2' OR b.file = 'Brand#2'))
    SELECT CASE WHEN ff = 'Brand#2' THEN tf ELSE ff END AS other, CASE WHEN ff = 'Brand#2' THEN 'out' ELSE 'in' END AS direction, count(*) AS calls,
    array_to_string(list_sort(list_distinct(list(CASE WHEN ff = 'Brand#2' THEN tn ELSE fn END))), ',') AS names FROM c GROUP BY 1, 2"""
)
def file_card_sets(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("id"), F.concat(F.lit("nation"), "s_nationkey").alias("file"), F.col("s_name").alias("name"))
    p = load(spark, sf_dir, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.col("p_brand").alias("file"), F.col("p_name").alias("name"))
    return g.file_card(edges(spark, sf_dir), s.union(p), "Brand#2").withColumn("names", F.array_join("names", ","))


@query(
    """WITH e AS (SELECT DISTINCT l_suppkey AS from_id, l_partkey AS to_id FROM lineitem), c AS (SELECT DISTINCT l_suppkey AS from_id, 'class ' || p_brand AS class FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 48),
    used AS (SELECT DISTINCT from_id, 'class ' || p_brand AS class FROM e JOIN part ON to_id = p_partkey WHERE p_type = 'PROMO')
    SELECT from_id, class AS to_name FROM c WHERE NOT EXISTS (SELECT 1 FROM used WHERE used.from_id = c.from_id AND used.class = c.class)"""
)
def class_edge_suppression(spark, sf_dir):
    """Suppliers call brands (classes) and parts; promo parts are members of their brand."""
    line, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    brand = F.concat(F.lit("class "), "p_brand")
    members = part.select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("method").alias("kind"), F.when(F.col("p_type") == "PROMO", brand).alias("owner"))
    classes = part.select(brand.alias("id"), brand.alias("name"), F.lit("class").alias("kind"), F.lit(None).cast("string").alias("owner")).distinct()
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    calls = rows.select("l_suppkey", F.concat(F.lit("p:"), "l_partkey")).union(rows.where("l_quantity > 48").select("l_suppkey", brand)).distinct().toDF("from_id", "to_id").withColumn("kind", F.lit("CALLS"))
    left = g.without_class_edges(calls, members.union(classes))
    return left.where(F.startswith("to_id", F.lit("class "))).select("from_id", F.col("to_id").alias("to_name"))


@query("SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey HAVING min(l_returnflag) = max(l_returnflag) AND count(l_returnflag) = count(*)")
def unanimous_value(spark, sf_dir):
    return k.unanimous(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query(
    """WITH u AS (SELECT p_brand || ' ' || p_name AS callee, min(p_partkey) AS target FROM part GROUP BY 1 HAVING count(*) = 1)
    SELECT l_orderkey, l_linenumber, callee, target FROM lineitem JOIN part ON l_partkey = p_partkey JOIN u ON u.callee = p_brand || ' ' || p_name"""
)
def unique_name_link(spark, sf_dir):
    """A call by brand and name links to a part if one part alone has them."""
    part = load(spark, sf_dir, "part").withColumn("callee", F.concat_ws(" ", "p_brand", "p_name"))
    unique = part.groupBy("callee").agg(F.min("p_partkey").alias("target"), F.count("*").alias("n")).where("n = 1").drop("n")
    calls = load(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return calls.join(unique, "callee").select("l_orderkey", "l_linenumber", "callee", "target")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE (CASE p_type WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 ELSE 3 END) = 1 AND p_name LIKE 'red%'")
def tiered_pick(spark, sf_dir):
    rank = F.when(F.col("p_type") == "PROMO", 1).when(F.col("p_type") == "SMALL", 2).otherwise(3)
    parts = load(spark, sf_dir, "part").where(F.startswith("p_name", F.lit("red")))
    return k.ranked_pick(parts, rank, ["p_partkey"]).select("p_partkey", "p_name", "p_type")


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM (SELECT *, max(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS any_r FROM lineitem) WHERE l_returnflag = 'R' OR NOT any_r")
def definition_over_declaration(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem").withColumn("has_body", F.col("l_returnflag") == "R")
    return k.definitions(line, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_wins_dedup(spark, sf_dir):
    return k.first_wins(load(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")




def _part_classes(spark, sf_dir):
    """Parts as classes: three of them have one base, and every fifth a second one."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    base = part.select("k", F.expr("k div 3").alias("b")).unionByName(part.where("k % 5 = 0").select("k", F.expr("k div 4").alias("b")))
    return base.select(F.concat(F.lit("P"), "k").alias("class"), F.concat(F.lit("P"), "b").alias("base"))


_PART_CLASSES = """WITH RECURSIVE bases AS (SELECT p_partkey AS k, p_partkey // 3 AS b FROM part UNION SELECT p_partkey, p_partkey // 4 FROM part WHERE p_partkey % 5 = 0),
up(k, a, depth) AS (SELECT k, b, 1 FROM bases WHERE k <> b UNION SELECT up.k, b, depth + 1 FROM up JOIN bases ON bases.k = up.a WHERE b <> up.k AND depth < 12),
near AS (SELECT k, a, min(depth) AS depth FROM up GROUP BY k, a)
"""


@query(_PART_CLASSES + "SELECT 'P' || k AS class, 'P' || a AS ancestor, depth FROM near")
def nearest_ancestor(spark, sf_dir):
    return g.ancestors(_part_classes(spark, sf_dir))


@query(
    _PART_CLASSES
    + """, met AS (SELECT n.k AS id, n.a, n.depth FROM near n JOIN part c ON c.p_partkey = n.k JOIN part b ON b.p_partkey = n.a AND b.p_size % 4 = c.p_size % 4),
    links AS (SELECT id, arg_min(a, [depth, rank]) AS a FROM (SELECT *, row_number() OVER (ORDER BY 'P' || a) AS rank FROM met) GROUP BY id)
    SELECT a AS from_id, id AS to_id FROM links QUALIFY count(*) OVER (PARTITION BY a) <= 4"""
)
def override_fanout(spark, sf_dir):
    """A part has one method, named by its size."""
    part = load(spark, sf_dir, "part")
    methods = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("P"), "p_partkey").alias("owner"), F.concat(F.lit("m"), F.col("p_size") % 4).alias("name"), (F.col("p_size") > 25).alias("has_body"))
    return g.override_links(_part_classes(spark, sf_dir), methods)


@query("SELECT s_suppkey AS native_id, CASE WHEN s_suppkey % 3 = 0 THEN 1000000 ELSE 2000000 END + s_suppkey AS function_id FROM supplier WHERE s_suppkey % 7 <> 2")
def suffix_theta_join(spark, sf_dir):
    """Suppliers as native methods; every seventh has no function, every third only a declared one, every second one's has a signature."""
    rows = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    natives = rows.select("id", F.concat(F.lit("Usb_"), F.col("id") % 4).alias("owner"), F.concat(F.lit("read_"), "id").alias("name"))
    name = F.concat(F.lit("Java_org_x_Usb_1"), F.col("id") % 4, F.lit("_read_1"), "id", F.when(F.col("id") % 2 == 0, "__I").otherwise(""))
    declared = rows.where("id % 7 <> 2").select((F.col("id") + 1_000_000).alias("id"), name.alias("name"), F.lit(False).alias("has_body"))
    return k.suffix_join(natives, declared.unionByName(rows.where("id % 7 <> 2 AND id % 3 <> 0").select((F.col("id") + 2_000_000).alias("id"), name.alias("name"), F.lit(True).alias("has_body"))))


@query(_EDGES + " SELECT to_id AS id, from_id AS other, 'caller' AS role FROM edges WHERE to_id IN ('p:3', 'o:7') UNION SELECT from_id, to_id, 'callee' FROM edges WHERE from_id IN ('p:3', 'o:7')")
def symbol_card(spark, sf_dir):
    return g.card(edges(spark, sf_dir), _seed(spark, "p:3", "o:7"))


@query(
    _EDGES
    + """ SELECT to_id AS id, from_id AS other, 'caller' AS role FROM edges WHERE to_id = 'p:3' UNION SELECT from_id, to_id, 'callee' FROM edges WHERE from_id = 'p:3'
    UNION SELECT 'b:' || p_brand, 'p:' || p_partkey, 'member' FROM part WHERE p_brand = 'Brand#2'"""
)
def class_card(spark, sf_dir):
    """A brand as a class with its parts, beside one of the parts."""
    members = load(spark, sf_dir, "part").select(F.concat(F.lit("b:"), "p_brand").alias("class_id"), F.concat(F.lit("p:"), "p_partkey").alias("id"))
    return g.card(edges(spark, sf_dir), _seed(spark, "p:3", "b:Brand#2"), members)


@query(_EDGES + " SELECT id FROM (SELECT from_id AS id FROM edges WHERE to_id IN ('p:3', 's:1') UNION SELECT to_id FROM edges WHERE from_id IN ('p:3', 's:1')) WHERE id NOT IN ('p:3', 's:1')")
def neighbours_without_self(spark, sf_dir):
    return g.neighbours(edges(spark, sf_dir), _seed(spark, "p:3", "s:1"))


@query(
    _EDGES
    + """, e AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY to_id) AS n FROM edges), k AS (SELECT from_id, to_id FROM e WHERE n <= 8),
    l1 AS (SELECT to_id AS id, from_id AS parent, 1 AS level, FALSE AS seen FROM k WHERE from_id = 's:1'),
    l2 AS (SELECT to_id AS id, from_id AS parent, 2 AS level, row_number() OVER (PARTITION BY to_id ORDER BY from_id) > 1 AS seen FROM k WHERE from_id IN (SELECT id FROM l1)),
    l3 AS (SELECT to_id AS id, from_id AS parent, 3 AS level, row_number() OVER (PARTITION BY to_id ORDER BY from_id) > 1 AS seen FROM k WHERE from_id IN (SELECT id FROM l2 WHERE NOT seen))
    SELECT 's:1' AS id, NULL AS parent, 0 AS level, FALSE AS seen UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3"""
)
def call_flow(spark, sf_dir):
    """Supplier 1, its parts, their orders and customers, at most eight of each."""
    return g.flow(kept(edges(spark, sf_dir)), _seed(spark, "s:1"), 3)


@query(_NAMED + """, q AS (SELECT id, CASE WHEN name = 'red plate' THEN 1 WHEN lower(name) = 'red plate' THEN 2 END AS t FROM named)
    SELECT 'red plate' AS q, id, 'many' AS answer FROM q WHERE t = (SELECT min(t) FROM q) UNION ALL
    SELECT 'Supplier#000000003', id, 'one' FROM named WHERE name = 'Supplier#000000003' UNION ALL
    SELECT 'p/brand#2', id, 'path' FROM named WHERE starts_with(lower(path), 'p/brand#2/') UNION ALL
    SELECT * FROM (SELECT '#00000001', id, 'similar' FROM named WHERE contains(lower(name), '#00000001') ORDER BY length(name), name, id LIMIT 8)""")
def lookup_switch(spark, sf_dir):
    """Four questions: several of one name, one of it, a folder, and a part of a name."""
    rows = named(spark, sf_dir)
    found = [k.switched(rows, q).select(F.lit(q).alias("q"), "id", "answer") for q in ("red plate", "Supplier#000000003", "p/brand#2", "#00000001")]
    return found[0].union(found[1]).union(found[2]).union(found[3])


@query(_NAMED + "SELECT id, owner || '.' || name || ' (x)' AS label FROM named")
def symbol_label(spark, sf_dir):
    return named(spark, sf_dir).select("id", g.label().alias("label"))
