"""URL filters: fixed host/path rules, then association rules mined by FP-growth (DataFrame functions only)."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, workspace

#: (host, path, verdict): a rule fits its host and all subdomains, if the url's path starts with its path.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: What a mined rule needs: bad urls that it fits, their share of all labelled urls that it fits, and a lower limit of that share
#: (Wilson's) above the share of bad urls among all. CHANCE is that of any rule by chance, however many combinations are tested.
MIN_COUNT, MIN_CONFIDENCE, CHANCE = 3, 0.5, 0.025
#: Tokens of a url up to which FP-growth combines them; urls of more go to grown(), which combines all of theirs, too.
MOST_COMBINED = 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z in lower case; empty if there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty if there is no ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and the domains above it: a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def matched_rule(host: Column, path: Column, rules: tuple) -> Column:
    """The longest rule that fits, as struct<size, host_size, rule, verdict>; null if none does.

    The rules are an index by host, a literal of the plan, so their number is what a plan can hold.
    """
    kind = "array<struct<path:string,verdict:string>>"
    index: dict[str, list] = {}
    for h, p, v in rules:
        index.setdefault(h, []).append(F.struct(F.lit(p).alias("path"), F.lit(v).alias("verdict")))
    if not index:
        return F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")
    posted = F.create_map(*[x for h, found in index.items() for x in (F.lit(h), F.array(*found))])

    def of(h: Column) -> Column:
        fits = F.filter(F.coalesce(F.try_element_at(posted, h), F.array().cast(kind)), lambda r: F.startswith(path, r["path"]))
        return F.transform(fits, lambda r: F.struct((F.length(h) + F.length(r["path"])).alias("size"), F.length(h).alias("host_size"), F.concat(h, r["path"]).alias("rule"), r["verdict"].alias("verdict")))

    return F.array_max(F.flatten(F.transform(suffixes(host), of)))


def tokens(url: Column) -> Column:
    """The distinct tokens of a url: scheme, domains, path segments (numbers as one token), extension, query keys,
    fragment."""
    u = F.coalesce(url, F.lit(""))
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    query = F.filter(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda s: s != "")
    extension = F.regexp_extract(path_of(url), r"\.([A-Za-z0-9]+)\z", 1)
    return F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("scheme="), F.regexp_extract(u, r"(?s)\A(.*?)://", 1))),
            F.transform(F.filter(suffixes(host_of(url)), lambda h: h != ""), lambda h: F.concat(F.lit("host="), h)),
            F.transform(segments, lambda s: F.when(s.rlike(r"^[0-9]+(\.[a-z]+)?$"), F.lit("path=#")).otherwise(F.concat(F.lit("path="), s))),
            F.transform(query, lambda s: F.concat(F.lit("query="), F.regexp_extract(s, r"^([^=]*)", 1))),
            F.when(extension != "", F.array(F.concat(F.lit("extension="), extension))).otherwise(F.array().cast("array<string>")),
            F.when(F.contains(u, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
        )
    )


def wilson(share: Column, n: Column, z: float) -> Column:
    """The lower limit of a share that was seen in n cases."""
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def classed(posts: DataFrame, min_count: int) -> DataFrame:
    """(token, bad, total, members): of tokens that the same bad urls have the one that fits fewest urls, with all of them. Sets of urls
    are compared by two hashes of 64 bits, gathered with reduction in the map. posts: (url, token, bad, n)."""
    print_ = lambda seed: F.bit_xor(F.when(F.col("bad"), F.xxhash64("url", F.lit(seed)))).alias(f"h{seed}")
    per_token = posts.groupBy("token").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("total"), print_(1), print_(2))
    alike = per_token.where(F.col("bad") >= min_count).groupBy("bad", "h1", "h2")
    return alike.agg(F.min(F.struct("total", "token")).alias("x"), F.collect_list("token").alias("members")).select("x.token", "bad", "x.total", "members")


def one_host(tokens_: Column) -> Column:
    """Tokens with the longest of their domains only, sorted: they fit the same urls."""
    hosts = F.filter(tokens_, lambda t: F.startswith(t, F.lit("host=")))
    longest = F.array_max(F.transform(hosts, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    return F.array_sort(F.filter(tokens_, lambda t: ~F.startswith(t, F.lit("host=")) | t.eqNullSafe(longest)))


def mine(labelled: DataFrame, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, chance: float = CHANCE, most_combined: int = MOST_COMBINED) -> DataFrame:
    """(id, antecedent, bad, total, confidence, support, lift) of rules that say block, from rows of (url, bad).

    FP-growth finds the token combinations that at least min_count bad urls of up to most_combined tokens share, the same number at
    every size; it reads bad urls only, which loses no rule. What bad urls of more tokens have is found by grown(), whole as well.
    Tokens that the same bad urls have count as one, that which fits fewest urls of all, so what copies of a url share is not
    combined in all ways; all of such tokens together are a candidate of their own, and every token is one alone. How many urls, bad
    and of all, each candidate fits is counted exactly by an inverted index. Of combinations with several domains of one host the
    longest alone is taken, as it fits the same urls. The limit of a rule's confidence is corrected for the number of candidates, so
    that labels which say nothing about urls give no rules. A rule goes if a rule of fewer of its tokens is as confident, which is
    looked up among combinations of one token less, size by size. No labels give no rules.
    """
    spark = labelled.sparkSession
    with workspace(spark) as keep:
        baskets = cut(labelled.groupBy("url", "bad").agg(F.count("*").alias("n")).select("url", "n", "bad", tokens(F.col("url")).alias("items")))
        bad, every = baskets.agg(F.sum(F.when(F.col("bad"), F.col("n"))), F.sum("n")).first()
        kind = "id long, antecedent array<string>, bad long, total long, confidence double, support double, lift double"
        if not bad or bad < min_count:
            return spark.createDataFrame([], kind)
        posts = baskets.select("url", "n", "bad", F.explode("items").alias("token"))
        alike = cut(classed(posts, min_count))
        order = Window.partitionBy("url").orderBy("k", "token")  # the tokens of one url
        told = posts.where("bad").join(small(alike.select("token", F.col("bad").alias("k"))), "token").withColumn("at", F.row_number().over(order))
        wide = cut(told.where(F.col("at") > most_combined).select("url").distinct())
        copies = told.join(wide, "url", "left_anti").groupBy("url", "n").agg(F.collect_list("token").alias("items"))
        copies = copies.select("items", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))))
        model = FPGrowth(itemsCol="items", minSupport=(min_count - 0.5) / bad).fit(copies.select("items"))
        found = model.freqItemsets.where(F.size(F.filter("items", lambda t: F.startswith(t, F.lit("host=")))) <= 1).select(F.array_sort("items").alias("antecedent"))
        found = found.unionByName(alike.select(F.array("token").alias("antecedent"))).distinct().withColumn("together", F.lit(False))
        whole = alike.where(F.size("members") > 1).select(one_host(F.col("members")).alias("antecedent"), F.lit(True).alias("together")).where(F.size("antecedent") > 1)
        sets = cut(found.unionByName(whole).groupBy("antecedent").agg(F.min("together").alias("together")).withColumn("id", F.monotonically_increasing_id()))
        fits = held(baskets.select("n", "bad", F.col("items").alias("have")), posted(sets, posts.select("token", "n")))
        counted = fits.groupBy("id").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("total"))
        sets = cut(sets.join(counted, "id").where(F.col("bad") >= min_count).withColumn("confidence", F.col("bad") / F.col("total")))
        base, tested = bad / every, sets.count()
        if bad < every and not wide.isEmpty():
            more, tested = grown(posts, told, wide, base, tested, min_count, chance)
            more = more.join(sets.select("antecedent"), "antecedent", "left_anti").withColumn("id", -1 - F.monotonically_increasing_id())
            sets = cut(sets.unionByName(more.withColumn("together", F.lit(False)).withColumn("confidence", F.col("bad") / F.col("total"))))
        errors = limit(tested, chance)
        sound = (F.col("confidence") >= min_confidence) & (wilson(F.col("confidence"), F.col("total").cast("double"), errors) > base)
        rules = cut(best_of(below(cut(sets.withColumn("sound", sound)))).where("sound AND (best IS NULL OR best < confidence)").drop("sound", "best", "together"))
        return keep(cut(rules.withColumn("support", F.col("bad") / F.lit(every)).withColumn("lift", F.col("confidence") / base)))


def limit(tested: int, chance: float) -> float:
    """The normal quantile of a test at chance among so many."""
    return NormalDist().inv_cdf(1 - chance / max(1, tested))


def grown(posts: DataFrame, told: DataFrame, wide: DataFrame, base: float, tested: int, min_count: int, chance: float) -> tuple[DataFrame, int]:
    """(antecedent, bad, total) of combinations of two or more tokens of the bad urls in wide, whatever their number, and how many
    candidates are tested with them, after the tested ones before.

    Patterns grow by one token at a time. What is not grown cannot become a rule or lose one: fewer bad urls than a combination
    without good urls would need to be sound among the candidates so far (their number only rises, and with it the limit), or a
    token that keeps no good url away, without which the rest is as confident. Tokens come in order of the good urls that have them,
    so such pairs end at once. posts: (url, n, bad, token), told: the tokens of bad urls that are combined, wide: urls.

    The urls that have a combination are bits, 64 labelled urls of one kind (good 0, bad 1, bad and wide 2) and one binary digit of
    their count to a slot, so counts are exact and a step moves a 64th of the urls.
    """
    spark = posts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a small table of covers can give many combinations

    def least() -> int:
        return max(min_count, int(max(0.0, limit(tested, chance)) ** 2 * base / (1 - base) * (1 - 1e-9)) + 1)

    with workspace(spark) as keep:
        used = told.join(small(wide), "url", "left_semi").select("token").distinct()
        both = posts.join(small(cut(used)), "token").groupBy("token").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("k"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("good"))
        names = cut(both.where(F.col("k") >= least()).orderBy("good", "token").select("token", "good", F.monotonically_increasing_id().alias("no")))
        rows = posts.join(small(names.select("token", "no")), "token").join(small(wide.select("url", F.lit(2).alias("kind"))), "url", "left")
        rows = rows.groupBy("url", "n", F.when(F.col("bad"), F.coalesce("kind", F.lit(1))).otherwise(0).alias("kind")).agg(F.array_sort(F.collect_list("no")).alias("items"))
        rows = rows.groupBy("kind", "items").agg(F.sum("n").alias("n")).withColumn("digit", F.explode(F.expr("filter(sequence(0, 62), p -> shiftright(n, p) & 1 = 1)")))
        rows = rows.sortWithinPartitions("kind", "digit", "items").withColumn("row", F.monotonically_increasing_id())
        rows = cut(rows.selectExpr("items", "shiftleft(shiftright(row, 6), 8) + digit * 4 + kind AS slot", "shiftleft(1L, cast(row & 63 AS int)) AS bits"))
        ones = cut(rows.select(F.explode("items").alias("no"), "slot", "bits").groupBy("no", "slot").agg(F.bit_or("bits").alias("bits")))
        pairs = rows.select("slot", "bits", F.posexplode("items").alias("at", "id"), "items").selectExpr("id", "slot", "bits", "explode(slice(items, at + 2, size(items))) AS no")
        pairs = pairs.groupBy("id", "no", "slot").agg(F.bit_or("bits").alias("bits"))
        longer = pairs.join(small(names.select(F.col("no").alias("id"), F.col("good").alias("before"))), "id")
        sets = names.select(F.col("no").alias("id"), F.array("token").alias("antecedent"))
        own, token, out = small(ones.withColumnRenamed("bits", "own")), small(names.select("no", "token")), []
        while True:
            n = F.expr("shiftleft(1L, cast(shiftright(slot, 2) & 63 AS int)) * bit_count(bits)")
            sums = (F.sum(F.when(fits, n).otherwise(0)).alias(name) for name, fits in (("bad", F.expr("slot & 3 > 0")), ("good", F.expr("slot & 3 = 0")), ("wide", F.expr("slot & 3 = 2"))))
            counted = cut(longer.groupBy("id", "no", "before").agg(*sums).where("wide > 0").withColumn("next", F.monotonically_increasing_id()))
            tested += counted.count()
            counted = cut(counted.where((F.col("bad") >= least()) & (F.col("good") < F.col("before"))))
            if counted.isEmpty():
                break
            named = counted.join(sets, "id").join(token, "no")
            sets = cut(named.select(F.col("next").alias("id"), F.array_append("antecedent", F.col("token")).alias("antecedent"), "bad", (F.col("bad") + F.col("good")).alias("total")))
            out.append(sets.select(F.array_sort("antecedent").alias("antecedent"), "bad", "total"))
            sets = sets.select("id", "antecedent")
            # a set is grown by the tokens that its prefix was grown by
            known = counted.select("id", "no", "next", F.col("good").alias("now"))
            after = counted.alias("a").join(counted.alias("b"), "id").where("a.no < b.no").select(F.col("a.next").alias("id"), F.col("b.no").alias("no"))
            cover = cut(longer.join(known, ["id", "no"]).select(F.col("next").alias("id"), F.col("now").alias("before"), "slot", "bits"))
            longer = cover.repartition(parts, "id").join(after, "id").join(own, ["no", "slot"])
            longer = longer.select("id", "no", "before", "slot", F.col("bits").bitwiseAND(F.col("own")).alias("bits")).where("bits <> 0")
        found = out[0] if out else spark.createDataFrame([], "antecedent array<string>, bad long, total long")
        for level in out[1:]:
            found = found.unionByName(level)
        return keep(cut(found)), tested


def below(sets: DataFrame) -> DataFrame:
    """The sets that are sound or part of a sound one: what best_of needs."""
    some, size = sets.where("sound AND NOT together"), sets.where("sound AND NOT together").agg(F.max(F.size("antecedent"))).first()[0] or 1
    needed, out = some.where(F.size("antecedent") == size), sets.where("together AND sound OR size(antecedent) = 1")
    while size > 1:
        needed = cut(needed)
        out, size = out.unionByName(needed), size - 1
        less = needed.select(F.explode(F.transform("antecedent", lambda t: F.array_remove("antecedent", t))).alias("antecedent")).unionByName(some.where(F.size("antecedent") == size).select("antecedent"))
        needed = sets.where((~F.col("together")) & (F.size("antecedent") == size)).join(small(cut(less.distinct())), "antecedent", "left_semi")
    return out


def best_of(sets: DataFrame) -> DataFrame:
    """sets (antecedent, together, confidence, sound) with best, the largest confidence of sound ones that have fewer of its tokens. Combinations
    look up those of one token less, which know their own best; tokens that come together look up each of them alone."""
    value = F.greatest(F.when(F.col("sound"), F.col("confidence")), F.col("best"))  # nulls are passed over
    level = sets.where("NOT together AND size(antecedent) = 1").withColumn("best", F.lit(None).cast("double"))
    single = level.select(F.col("antecedent").alias("less"), value.alias("v"))
    out, below, size = level, single, 2
    while True:
        level = sets.where((~F.col("together")) & (F.size("antecedent") == size))
        if level.isEmpty():
            break
        less = level.select("id", F.explode(F.transform("antecedent", lambda t: F.array_remove("antecedent", t))).alias("less"))
        level = cut(level.join(less.join(below, "less").groupBy("id").agg(F.max("v").alias("best")), "id", "left"))
        out, below, size = out.unionByName(level), level.select(F.col("antecedent").alias("less"), value.alias("v")), size + 1
    whole = sets.where("together")
    alone = whole.select("id", F.explode(F.transform("antecedent", lambda t: F.array(t))).alias("less"))
    return out.unionByName(whole.join(alone.join(single, "less").groupBy("id").agg(F.max("v").alias("best")), "id", "left"))


def posted(rules: DataFrame, spread: DataFrame) -> DataFrame:
    """The inverted index: each rule (id, antecedent) under one token, the rarest by the numbers of spread (token, n)."""
    posts = rules.select("id", "antecedent", F.explode("antecedent").alias("token"))
    count = spread.groupBy("token").agg(F.sum("n").alias("n"))
    return posts.join(count, "token", "left").groupBy("id").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.first("antecedent").alias("antecedent"))


def held(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows (have, ...) with every rule (id) whose tokens they have: tokens are looked up in the index and the rule's others
    compared."""
    looked = rows.withColumn("token", F.explode("have"))
    return looked.join(small(cut(index)), "token").where(F.size(F.array_except("antecedent", "have")) == 0)


def fired(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence) of the urls that a mined rule fits."""
    have = urls.select("url", tokens(F.col("url")).alias("have"))
    index = posted(rules, rules.select(F.explode("antecedent").alias("token"), F.lit(1).alias("n")))
    hits = held(have, index.join(rules.select("id", "confidence"), "id"))
    return hits.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame, key: str = "page_id", url: str = "url", rules: tuple = RULES, **options) -> DataFrame:
    """One row per row of pages: key, host, path, rule, verdict, confidence (of the mined rule that blocks).

    The longest fixed rule that fits decides; of rules of one length the one with the longer host. Else a url is blocked
    if a mined rule fits it, and allowed if none does. Null urls and urls without :// have an empty host and path. Very
    long urls are judged whole. Repeated rows and null keys are judged each; no rows give no rows; other columns,
    whatever their names, are ignored. labelled has url and bad; rows with null bad are left out.
    """
    mined = mine(labelled.where("bad IS NOT NULL"), **options)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("fixed", matched_rule(F.col("host"), F.col("path"), rules))
    if mined.isEmpty():
        rows = rows.withColumn("confidence", F.lit(None).cast("double"))
    else:
        blocked = cut(fired(rows.where("fixed IS NULL AND url IS NOT NULL").select("url").distinct(), mined))
        rows = rows.join(small(blocked), "url", "left")
    verdict = F.when(F.col("fixed").isNotNull(), F.col("fixed.verdict")).when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return rows.select(F.col("key").alias(key), "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), "confidence")


def url_rules(spark, sf_dir: str) -> DataFrame:
    """The fixed part of op6_url_filter: page_id, host, path, rule."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return rows.select("page_id", "host", "path", matched_rule(F.col("host"), F.col("path"), RULES)["rule"].alias("rule"))


SQL_RULES = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, p) AS (VALUES ('org', '/'), ('example.org', '/es/'), ('example.org', '/en/1'), ('com', '/fr/'), ('com', '/de/'))
SELECT page_id, host, path, (SELECT arg_max(r.h || r.p, length(r.h || r.p)) FROM r WHERE (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)) AS rule FROM p
"""


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Labels of urls: the quality of the label whose doc_id is the page's page_id; 0 counts as bad."""
    pages, labels = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").alias("d")).agg((F.min("quality") == 0).alias("bad"))
    return judge(pages, pages.join(bad, F.col("page_id") == F.col("d")).select("url", "bad"))
