"""Graphs as edge tables (from_id, to_id, kind): neighbours, hops, extents and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import kept


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Edges once per pair, the smallest kind kept."""
    return edges.groupBy("from_id", "to_id").agg(F.min("kind").alias("kind"))


def reached(edges: DataFrame, seeds: DataFrame, depth: int, forward: bool = True) -> DataFrame:
    """(id, hop): nodes within `depth` steps (1 to 5) of the seeds (id), with the fewest steps (G-1, G-2, W10).

    Each step joins the last frontier with the edges and drops what was met; frontiers are written, so a step reads
    one step back and no deeper.
    """
    depth = min(max(depth, 1), 5)
    a, b = ("from_id", "to_id") if forward else ("to_id", "from_id")
    met = kept(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
    frontier = met
    for hop in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("id").alias(a)), a).select(F.col(b).alias("id")).distinct()
        frontier = kept(step.join(met, "id", "left_anti").withColumn("hop", F.lit(hop)))
        met = met.unionByName(frontier)
    return met


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """The edges within `depth` steps in either direction, the two directions walked apart; kinds as in distinct_edges."""
    depth = min(max(depth, 1), 5)
    both = edges.select(F.col("from_id").alias("at"), F.col("to_id").alias("id"), F.lit(True).alias("down")).unionByName(edges.select(F.col("to_id").alias("at"), F.col("from_id").alias("id"), F.lit(False).alias("down")))
    seed = seeds.select("id").distinct()
    met = kept(seed.withColumn("down", F.lit(True)).unionByName(seed.withColumn("down", F.lit(False))))
    frontier = met
    for _ in range(1, depth):  # both directions step together; what is met on the way down tells nothing of the way up
        step = both.join(frontier.withColumnRenamed("id", "at"), ["at", "down"]).select("id", "down").distinct()
        frontier = kept(step.join(met, ["id", "down"], "left_anti"))
        met = met.unionByName(frontier)
    down, up = met.where("down").select(F.col("id").alias("from_id")), met.where("NOT down").select(F.col("id").alias("to_id"))
    return distinct_edges(edges.join(down, "from_id", "left_semi").unionByName(edges.join(up, "to_id", "left_semi").select(edges.columns)))


def callers(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id) of what calls any of ids."""
    return edges.join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct()


def callees(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()


def extent(symbols: DataFrame, root: str, key: str = "node") -> DataFrame:
    """A class and its members: the node and those whose id starts with it and a dot."""
    return symbols.where((F.col(key) == root) | F.startswith(key, F.lit(root + ".")))


def without_class_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges to a class go if the caller also calls a member of that class (J13). symbols: (id, name, kind, owner)."""
    classes = symbols.where("kind = 'class'").select(F.col("id").alias("to_id"), F.col("name").alias("class"))
    members = symbols.where("owner IS NOT NULL").select(F.col("id").alias("to_id"), F.col("owner").alias("class"))
    used = edges.join(members, "to_id").select("from_id", "class").distinct()
    covered = edges.join(classes, "to_id").join(used, ["from_id", "class"], "left_semi").select("from_id", "to_id", "kind")
    return edges.join(covered, ["from_id", "to_id", "kind"], "left_anti")


def file_card(edges: DataFrame, files: DataFrame, file: str) -> DataFrame:
    """(other, direction, calls, names): what the symbols of a file call in other files, and what calls them.
    files: (id, file, name)."""
    a = files.select(F.col("id").alias("from_id"), F.col("file").alias("from_file"), F.col("name").alias("from_name"))
    b = files.select(F.col("id").alias("to_id"), F.col("file").alias("to_file"), F.col("name").alias("to_name"))
    rows = edges.join(a, "from_id").join(b, "to_id").where("from_file <> to_file").where((F.col("from_file") == file) | (F.col("to_file") == file))
    out = F.col("from_file") == file
    rows = rows.select(F.when(out, F.col("to_file")).otherwise(F.col("from_file")).alias("other"), F.when(out, "out").otherwise("in").alias("direction"), F.when(out, F.col("to_name")).otherwise(F.col("from_name")).alias("name"))
    return rows.groupBy("other", "direction").agg(F.count("*").alias("calls"), F.array_sort(F.collect_set("name")).alias("names"))


def defines(symbols: DataFrame) -> DataFrame:
    """(parent, node): a member's class node in its file if there is one, else the file (J14). symbols: (node, path, name,
    owner, kind)."""
    classes = symbols.where("kind = 'class'").select("path", F.col("name").alias("owner"), F.col("node").alias("class_node")).dropDuplicates(["path", "owner"])
    rows = symbols.join(classes, ["path", "owner"], "left")
    return rows.select(F.coalesce("class_node", F.concat(F.lit("file:"), "path")).alias("parent"), "node")


def ancestors(bases: DataFrame, most: int = 12) -> DataFrame:
    """(class, ancestor, depth) from (class, base): every ancestor at its nearest depth, at most `most` levels up."""
    known = bases.select("class", F.col("base").alias("ancestor")).where("class <> base").distinct().withColumn("depth", F.lit(1))
    known = kept(known)
    frontier = known
    for depth in range(2, most + 1):
        step = frontier.join(bases.select(F.col("class").alias("ancestor"), "base"), "ancestor").select("class", F.col("base").alias("ancestor"))
        step = step.where("class <> ancestor").distinct().join(known, ["class", "ancestor"], "left_anti")
        frontier = kept(step.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def override_links(bases: DataFrame, methods: DataFrame, fanout: int = 4) -> DataFrame:
    """(from_id, to_id): a base method to the methods that override it, of the nearest ancestor that has it, if they are at
    most `fanout` (J9). methods: (id, owner, name, has_body); a definition goes before a declaration."""
    # of pairs whose ancestor has no method here nothing is overridden; only what is left needs its methods
    above = kept(ancestors(bases).join(methods.select(F.col("owner").alias("ancestor")).distinct(), "ancestor", "left_semi"))
    owners = above.select(F.col("class").alias("owner")).union(above.select("ancestor")).distinct()
    one = methods.join(owners, "owner", "left_semi").groupBy("owner", "name").agg(F.min_by("id", F.struct(~F.col("has_body"), "id")).alias("id"))
    own = one.where(~F.startswith("name", F.lit("~")) & (F.col("name") != "constructor") & (F.col("name") != F.col("owner")))
    up = own.withColumnRenamed("owner", "class").join(above, "class").select("id", "name", F.col("ancestor").alias("owner"), "depth")
    met = up.join(one.withColumnRenamed("id", "base_id"), ["owner", "name"]).where("base_id <> id")
    near = met.groupBy("id").agg(F.min_by("base_id", F.struct("depth", "owner")).alias("from_id"))
    pairs = near.select("from_id", F.col("id").alias("to_id")).distinct()
    return pairs.withColumn("n", F.count("*").over(Window.partitionBy("from_id"))).where(F.col("n") <= fanout).drop("n")


def full_graph(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """All edges with DEFINES edges from files and classes to what they hold (G-9). symbols: as in defines()."""
    return edges.select("from_id", "to_id", "kind").unionByName(defines(symbols).select(F.col("parent").alias("from_id"), F.col("node").alias("to_id"), F.lit("DEFINES").alias("kind")))


def card(edges: DataFrame, ids: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(id, other, role) of each of the ids: its callers and callees, and of a class its members (class_id, id) (G-4)."""
    up = edges.join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), F.lit("caller").alias("role"))
    down = edges.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), F.lit("callee").alias("role"))
    found = up.unionByName(down)
    if members is not None:
        held = members.select(F.col("class_id").alias("id"), F.col("id").alias("other"), F.lit("member").alias("role"))
        found = found.unionByName(held.join(ids, "id", "left_semi"))
    return found.distinct()


def flow(edges: DataFrame, seeds: DataFrame, depth: int, children: int = 8) -> DataFrame:
    """(id, parent, level, seen): calls from the seeds as a tree, level by level (G-5). Of each node at most `children` callees are
    followed, the first by id; one that a level before had, or another parent of its level has first, is marked as seen and not
    followed again."""
    met = kept(seeds.select("id").distinct().withColumn("parent", F.lit(None).cast("string")).withColumn("level", F.lit(0)).withColumn("seen", F.lit(False)))
    frontier, found = met, met
    for level in range(1, min(max(depth, 1), 5) + 1):
        step = edges.join(frontier.where("NOT seen").select(F.col("id").alias("from_id")), "from_id").select(F.col("from_id").alias("parent"), F.col("to_id").alias("id")).distinct()
        step = step.withColumn("n", F.row_number().over(Window.partitionBy("parent").orderBy("id"))).where(F.col("n") <= children).drop("n")
        known = found.select("id").distinct().withColumn("known", F.lit(True))
        again = F.coalesce("known", F.lit(False)) | (F.row_number().over(Window.partitionBy("id").orderBy("parent")) > 1)
        frontier = kept(step.join(known, "id", "left").select("id", "parent", F.lit(level).alias("level"), again.alias("seen")))
        found = found.unionByName(frontier)
    return found


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id) of what is linked to any of the ids in either direction, without the ids themselves."""
    return callers(edges, ids).union(callees(edges, ids)).distinct().join(ids, "id", "left_anti")


def label(symbol: str = "name", owner: str = "owner", path: str = "path"):
    """Owner.name and the file it is in, as views print a symbol."""
    return F.concat(F.coalesce(F.concat(F.col(owner), F.lit(".")), F.lit("")), F.col(symbol), F.lit(" ("), F.substring_index(path, "/", -1), F.lit(")"))
