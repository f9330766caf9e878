"""Quality classifier: an ensemble of sparse rules, compiled into Spark columns."""

from __future__ import annotations

from functools import reduce
from math import log
from operator import add, and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, words

#: Most labelled rows that the fit reads: the first in the order of a hash of their key.
FIT_ROWS = 20_000
TREES, DEPTH, LASSO, SEED, ACCEPT = 24, 3, 0.001, 7, 0.3

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, at most?, threshold), all of which hold


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text by name; all are 0 for a text without characters. Uses the column ws, its
    words, which the caller adds."""
    t, ws = F.coalesce(text, F.lit("")), F.col("ws")
    chars, n = F.length(t), F.size(ws)
    share = lambda part, whole: F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    ends = F.size(F.filter(ws, lambda w: w.rlike(r"[!#$%&*|<>=+~^_]$")))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    return {
        "log_chars": F.log1p(chars.cast("double")),
        "log_words": F.log1p(n.cast("double")),
        "word_length": share(F.aggregate(ws, F.lit(0), lambda s, w: s + F.length(w)), n),
        "upper": share(count(r"\p{Lu}"), chars),
        "symbols": share(count(r"[#$%&*|<>{}=_~^@\\/+!]"), chars),
        "marks": share(count(r"[.,;:?]"), chars),
        "digits": share(count(r"[0-9]"), chars),
        "bars": share(F.size(F.filter(ws, lambda w: w == "|")), n),
        "odd_ends": share(ends, n),
        "distinct_words": share(F.size(F.array_distinct(ws)), n),
        "short_words": share(F.size(F.filter(ws, lambda w: F.length(w) <= 3)), n),
        "same_next": share(count(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)(?=\x20\1(?![^\x20\x09-\x0D]))"), n),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": share(n, F.size(lines)),
    }


def with_statistics(rows: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    rows = rows.withColumn("ws", words(F.col(text)))
    stats = statistics(F.col(text))
    return rows.withColumns({f"s_{k}": v.cast("double") for k, v in stats.items()}).drop("ws"), [f"s_{k}" for k in stats]


def tree_rules(node, names: list[str], path: Rule = ()) -> list[Rule]:
    """The path to every node of a tree but its root, as a conjunction."""
    found = [path] if path else []
    if node.subtreeDepth() > 0:
        split = node.split()
        name, at = names[split.featureIndex()], float(split.threshold())
        found += tree_rules(node.leftChild(), names, (*path, (name, True, at)))
        found += tree_rules(node.rightChild(), names, (*path, (name, False, at)))
    return found


def holds(rule: Rule) -> Column:
    return reduce(and_, [F.col(name) <= at if most else F.col(name) > at for name, most, at in rule])


class RuleModel:
    """Weighted rules; score() is a column expression over the statistics."""

    def __init__(self, weights: dict[Rule, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self) -> Column:
        terms = [F.when(holds(rule), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.weights.items()]
        logit = reduce(add, terms, F.lit(self.intercept))
        return 1 / (1 + F.exp(-logit))


def fit(rows: DataFrame, names: list[str], label: str = "label") -> RuleModel:
    """Fit on rows of statistics with a 0/1 label: a random forest of shallow trees gives the rules, a lasso
    logistic regression their weights. Labels of one kind give a constant score, no labels 0.5."""
    counts = {int(r[0]): r[1] for r in rows.groupBy(label).count().collect()}
    if len(counts) < 2:
        return RuleModel({}, {(): 0.0, (1,): 6.0, (0,): -6.0}[tuple(counts)])
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(rows).withColumn("label", F.col(label).cast("double"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="0.5", seed=SEED, cacheNodeIds=False).fit(assembled.select("features", "label"))
    rules = list(dict.fromkeys(r for tree in forest.trees for r in tree_rules(tree._call_java("rootNode"), names)))
    if not rules:
        share = counts[1] / sum(counts.values())
        return RuleModel({}, log(share / (1 - share)))
    fired = cut(rows.select(F.col(label).cast("double").alias("label"), F.array(*[holds(r).cast("double") for r in rules]).alias("fired")))
    fired = fired.select("label", array_to_vector("fired").alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=True, tol=1e-5).fit(fired)
    return RuleModel({r: float(w) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w}, float(lasso.intercept))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> tuple[RuleModel, list[str]]:
    """Fit on labelled documents that are not held out (see held_out). At most fit_rows keys, by hash order."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).where(~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("k")).agg(F.min(label).alias("label")).orderBy(F.xxhash64("k"), "k").limit(fit_rows)
    rows, names = with_statistics(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(known), F.col("key") == F.col("k")), "text")
    return fit(cut(rows.select("label", *names)), names), names


def held_out(key: Column) -> Column:
    """Keys whose labels are not learnt: those whose crc32, as text, is divisible by 5. A null key is not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of docs: key, held_out, score (0 to 1), predicted (1 if score >= 0.3).

    Only statistics of the text enter the score: not the labels, language, source or key of a row. Null
    counts as empty; empty texts are scored by the rules that hold for statistics of 0; very long texts are scored whole. A
    key with several labels is learnt with the lowest, and with every text it has; labels that are null or neither 0 nor
    1, and labels of null keys, are left out. Repeated rows and null keys are scored each. No rows give no rows, no labels the
    score 0.5; other columns of docs and labels, whatever their names, are ignored.
    """
    model, _ = train(docs, labels, key, text, **options)
    rows, _ = with_statistics(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text")
    rows = rows.select("key", model.score().alias("score"))
    return rows.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns. Cases as in score()."""
    model, _ = train(docs, labels, key, text)
    rows, _ = with_statistics(docs.select(F.struct("*").alias("row"), F.col(text).alias("text")), "text")
    return rows.where(model.score() >= ACCEPT).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
