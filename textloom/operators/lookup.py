"""Lookups of named things in tiers, ranked picks, and spelling. Rows have name, owner and path as the caller says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import kept


def tiers(rows: DataFrame, tests: list[Column]) -> DataFrame:
    """The rows of the first test that any row passes, with tier (from 1). One pass: each row has its first tier, the best
    of all is one value."""
    tier = F.coalesce(*[F.when(test, F.lit(i)) for i, test in enumerate(tests, 1)])
    found = rows.withColumn("tier", tier).where("tier IS NOT NULL")
    best = found.agg(F.min("tier").alias("best"))
    return found.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best")


def candidates(rows: DataFrame, asked: str, name: str = "name", owner: str = "owner", path: str = "path", fuzzy: int = 8, order: tuple = ("path", "name")) -> DataFrame:
    """The cascade of a symbol lookup (F5): exact name, Owner.name, path:name, name that contains; the next tier only if
    the one before is empty. :: counts as a dot; case does not count. The last tier has at most `fuzzy` rows."""
    q = asked.strip().replace("::", ".").lower()
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    tests = [low(name) == q]
    tests.append(F.concat(low(owner), F.lit("."), low(name)) == q if "." in q else F.lit(False))
    if ":" in q:
        where, _, what = q.rpartition(":")
        tests.append((low(name) == what) & ((low(path) == where) | F.endswith(low(path), F.lit("/" + where))))
    else:
        tests.append(F.lit(False))
    tests.append(F.contains(low(name), F.lit(q)))
    found = tiers(rows, tests)
    first = found.where("tier < 4")
    return first.unionByName(found.where("tier = 4").orderBy(*order).limit(fuzzy))


def definitions(rows: DataFrame, keys: list[str], body: str = "has_body") -> DataFrame:
    """Rows with a body, and those without if none of their key has one."""
    return rows.withColumn("_any", F.max(body).over(Window.partitionBy(*keys))).where(F.col(body) | ~F.col("_any")).drop("_any")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def unanimous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the keys whose rows all have one value and none lacks it (A4)."""
    facts = rows.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_most"), F.count(value).alias("_k"), F.count("*").alias("_n"))
    return facts.where((F.col(value) == F.col("_most")) & (F.col("_k") == F.col("_n"))).select(key, value)


def ranked_pick(rows: DataFrame, rank: Column, order: list[str]) -> DataFrame:
    """The rows of the best rank; one is a pick, more are a list (T5)."""
    found = rows.withColumn("rank", rank)
    best = found.agg(F.min("rank").alias("best"))
    return found.join(F.broadcast(best), F.col("rank") == F.col("best")).drop("best").orderBy(*order)


def closest_names(rows: DataFrame, name: str, asked: str, most: int = 3) -> DataFrame:
    """Spellings close to what was asked (T10): a name that starts with it is at 0, else by edit distance up to 2; only
    the best distance, at most three."""
    low = F.lower(F.col(name))
    distance = F.when(F.startswith(low, F.lit(asked.lower())), 0).otherwise(F.levenshtein(low, F.lit(asked.lower())))
    found = rows.select(name).distinct().withColumn("distance", distance).where("distance <= 2")
    best = found.agg(F.min("distance").alias("best"))
    return found.join(F.broadcast(best), F.col("distance") == F.col("best")).drop("best").orderBy(name).limit(most)


def suffix_join(natives: DataFrame, functions: DataFrame) -> DataFrame:
    """Native methods (id, owner, name) to the functions (id, name, has_body) whose mangled name ends with theirs.

    A name Java_a_b_Owner_method meets by its endings at underscores, so the match is a join on equal strings; what
    follows a double underscore is the signature of an overload. A definition goes before a declaration, then the
    smallest id.
    """
    from ..functions.text import jni_mangle

    owner, name = jni_mangle(F.coalesce("owner", F.lit(""))), jni_mangle(F.col("name"))
    wanted = natives.select(F.col("id").alias("native_id"), F.when(owner == "", F.concat(F.lit("_"), name)).otherwise(F.concat(F.lit("_"), owner, F.lit("_"), name)).alias("suffix"))
    plain = functions.select("id", "has_body", F.explode(F.array_distinct(F.array("name", F.regexp_replace("name", "__.*$", "")))).alias("n"))
    parts = F.split("n", "_")
    endings = plain.where(F.contains("n", F.lit("_"))).select("id", "has_body", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.lit("_"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "_")))).alias("suffix"))
    met = wanted.join(endings, "suffix").groupBy("native_id").agg(F.min_by("id", F.struct(~F.col("has_body"), "id")).alias("function_id"))
    return met


def closest_line(probes: DataFrame, lines: DataFrame, least: float = 0.6, others: bool = False) -> DataFrame:
    """For each probe (probe_id, probe) the line (line_id, line) that resembles it most (A29, T11): Dice of the bigrams, of
    lines from half to twice its length, at least `least`; the first among equals. With others, a line of the probe's id is not its own.

    Of n bigrams two texts that are so similar share least * n / (2 - least) at least, so of each text's bigrams, ordered by how
    rare they are, those that can all be missing and one more are enough to meet by. Only pairs that share one of these rare
    ones are scored, exactly, and common bigrams meet nobody.
    """
    from ..functions.text import bigrams, numbered

    def prepared(df: DataFrame, key: str, text: str, mark: str) -> DataFrame:
        rows = df.select(key, F.length(text).alias(f"len_{mark}"), F.array_sort(bigrams(F.col(text))).alias("_g"))
        return rows.select(key, f"len_{mark}", numbered("_g").alias(f"grams_{mark}")).where(F.size(f"grams_{mark}") > 0)

    a, b = kept(prepared(probes, "probe_id", "probe", "p")), kept(prepared(lines, "line_id", "line", "l"))
    spread = a.select(F.explode("grams_p").alias("gram")).unionByName(b.select(F.explode("grams_l").alias("gram"))).groupBy("gram").agg(F.count("*").alias("n"))
    spread = kept(spread)

    def rare(df: DataFrame, key: str, mark: str) -> DataFrame:
        ranked = df.select(key, f"len_{mark}", F.explode(f"grams_{mark}").alias("gram")).join(spread, "gram")
        ranked = ranked.groupBy(key, f"len_{mark}").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("g"))
        needed = F.ceil(F.size("g") * F.lit(least / (2 - least)) - 1e-9).cast("int")
        return ranked.select(key, f"len_{mark}", F.explode(F.slice("g", F.lit(1), F.size("g") - F.greatest(needed, F.lit(1)) + 1)).alias("x")).select(key, f"len_{mark}", "x.gram")

    met = rare(a, "probe_id", "p").join(rare(b, "line_id", "l"), "gram").where("len_l >= 0.5 * len_p AND len_l <= 2 * len_p")
    met = met.where("probe_id <> line_id") if others else met
    pairs = met.select("probe_id", "line_id").distinct().join(a, "probe_id").join(b, "line_id")
    score = pairs.select("probe_id", "line_id", (2.0 * F.size(F.array_intersect("grams_p", "grams_l")) / (F.size("grams_p") + F.size("grams_l"))).alias("dice")).where(F.col("dice") >= least)
    return score.groupBy("probe_id").agg(F.max(F.struct("dice", (-F.col("line_id")).alias("m"))).alias("x")).select("probe_id", (-F.col("x.m")).alias("line_id"), "x.dice")


def switched(rows: DataFrame, asked: str, name: str = "name", owner: str = "owner", path: str = "path", key: str = "id", most: int = 8) -> DataFrame:
    """(key, answer) of what was asked (F25, G-8): answer is one or many for rows of that name, the name as written before any case;
    path for rows of a file or folder of that name; similar for at most eight names that hold it. No row is not found. A
    class and its own constructor count as one. One pass gives each row its tier."""
    q = asked.strip()
    low = q.lower()
    same = (F.col(name) == q) | F.endswith(F.concat_ws("/", path, name), F.lit("/" + q)) | (F.concat_ws(".", owner, name) == q)
    there = (F.lower(path) == low) | F.endswith(F.lower(path), F.lit("/" + low)) | F.startswith(F.lower(path), F.lit(low.rstrip("/") + "/"))
    found = tiers(rows, [same, F.lower(name) == low, there, F.contains(F.lower(name), F.lit(low))])
    exact = found.where("tier <= 2")
    things = exact.withColumn("_thing", F.when(F.col(owner) == F.col(name), F.col(owner)).otherwise(F.concat_ws(".", owner, name)))
    n = things.agg(F.count_distinct("_thing", path).alias("_n"), F.lit(1).alias("_one"))
    exact = exact.withColumn("_one", F.lit(1)).join(F.broadcast(n), "_one").select(key, F.when(F.col("_n") > 1, "many").otherwise("one").alias("answer"))  # one row
    rest = found.where("tier = 3").select(key, F.lit("path").alias("answer"))
    similar = found.where("tier = 4").orderBy(F.length(name), name, key).limit(most).select(key, F.lit("similar").alias("answer"))
    return exact.unionByName(rest).unionByName(similar)
