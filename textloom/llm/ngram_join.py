"""N-gram Jaccard self-join: MinHash bands find candidates, full n-gram sets verify them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, small, workspace
from .shingles import mix, shingle_sets

N, THRESHOLD, RECALL = 5, 0.8, 0.99999
#: Sets in one side of a verification block: a bound on memory, not on partners. Larger groups are cut into blocks that
#: together hold every pair.
BLOCK = 512
#: Bytes of text in a verification block and in a bundle of small blocks, about; one text that is longer is a side of its own.
BLOCK_BYTES = 8 << 20
#: Share of a block's pairs from which all are counted by matrix products, and not one by one.
DENSE = 0.05


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 128) -> tuple[int, int]:
    """(bands, rows): of the choices of at most `most` hashes that find a pair at the threshold with at least
    this chance, the one that makes fewest candidates of the pairs below it. A threshold so low that `most` hashes
    cannot meet the recall (about 0.09 at the defaults) is refused."""
    grid = np.linspace(0, threshold, 101)
    choices = []
    for rows in range(1, most + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= most:
            choices.append(((1 - (1 - grid**rows) ** bands).mean(), bands, rows))
    if not choices:
        raise ValueError(f"{most} hashes cannot find pairs at {threshold} with a chance of {recall}")
    return min(choices)[1:]


def signatures(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(key, th, text) to (key, th, bytes, node, grams, bands). node: a digest of the whole n-gram set."""
    a = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    b = mix(np.arange(1001, bands * rows + 1001, dtype=np.uint64))
    fold = mix(np.arange(2001, rows + 2001, dtype=np.uint64)) | np.uint64(1)
    for batch in batches:
        nodes, sizes, keys = [], [], []
        for grams in shingle_sets(batch.column("text").to_pylist(), n):
            nodes.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
            sizes.append(len(grams))
            if not len(grams):
                keys.append([])
                continue
            least = np.full(bands * rows, np.iinfo(np.uint64).max)
            for part in np.array_split(grams, -(-len(grams) // 2048)):
                np.minimum(least, (part[:, None] * a + b).min(axis=0), out=least)
            keys.append(mix((least.reshape(bands, rows) * fold).sum(axis=1)).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("th"), pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64()), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
            names=["key", "th", "bytes", "node", "grams", "bands"],
        )


def gram_ids(texts: list[str | None], n: int) -> list[np.ndarray]:
    """For each text the numbers of its distinct n-grams, sorted; equal n-grams of words, compared as written, and no
    others have one number. A text of fewer than n words is one n-gram of its own."""
    known: dict[bytes, int] = {}
    number = known.setdefault
    rows = []
    for text in texts:
        ids = [number(w, len(known) + 1) for w in (text or "").encode().split()]
        rows.append(np.array(ids + [0] * (n - len(ids)) if ids else ids, np.int64))
    counts = np.array([max(0, len(r) - n + 1) for r in rows])
    flat = np.concatenate([*rows, np.zeros(n, np.int64)])
    firsts = np.cumsum([0, *map(len, rows)])[:-1]
    at = np.repeat(firsts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    grams = flat[at]
    for j in range(1, n):  # the number of the first j words and the next word make the number of j + 1 words
        grams = np.unique(grams * (len(known) + 1) + flat[at + j], return_inverse=True)[1].astype(np.int64)
    return [np.unique(x) for x in np.split(grams, np.cumsum(counts)[:-1])]


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the n-grams that both sides have."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    if left is right:  # n-grams of one set alone add nothing between sets
        grams, count = np.unique(np.concatenate(left), return_counts=True)
        shared = grams[count > 1]
    for at in range(0, len(shared), 8192):
        part = shared[at : at + 8192]
        sides = []
        for side in (left, right):
            m = np.zeros((len(side), len(part)), np.float32)
            for i, s in enumerate(side):
                near = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
                m[i, np.searchsorted(part, np.intersect1d(near, part, assume_unique=True))] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def meet(left: np.ndarray, right: np.ndarray, band: int) -> np.ndarray:
    """Which rows of bands of the two sides agree somewhere; for a band from 0 on, which agree there and in none before."""
    agree = np.zeros((len(left), len(right)), bool)
    for b in range(left.shape[1] if band < 0 else band):
        agree |= left[:, b, None] == right[None, :, b]
    return agree if band < 0 else ~agree & (left[:, band, None] == right[None, :, band])


def in_reach(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which sizes are so near that the similarity can reach the threshold."""
    return np.minimum(left[:, None], right[None, :]) >= threshold * np.maximum(left[:, None], right[None, :]) - 1e-9


def sides(frame: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(band, rows of the left side, rows of the right side) of each block in a frame; of repeated nodes one row counts."""
    names = ["label", "band", "bucket", "i", "j"]
    frame = frame.reset_index(drop=True).drop_duplicates([*names, "node"])
    for (_, band, _, i, j), rows in frame.groupby(names, dropna=False).indices.items():
        rows = frame.index.to_numpy()[rows]
        chunk = frame["chunk"].loc[rows].to_numpy()
        left = rows[chunk == i]
        right = left if i == j else rows[chunk == j]
        if len(left) and len(right) and not (i == j and len(left) < 2):
            yield int(band), left, right


def first_met(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The rows whose node has a partner in its block that it meets in no band before."""
    frame = frame.reset_index(drop=True)
    bands, grams = np.array(frame["bands"].tolist(), np.int64), frame["grams"].to_numpy()
    needed = np.zeros(len(frame), bool)
    for band, left, right in sides(frame):
        pairs = meet(bands[left], bands[right], band) & in_reach(grams[left], grams[right], threshold)
        if left is right:
            np.fill_diagonal(pairs, False)
        needed[left] |= pairs.any(axis=1)
        needed[right] |= pairs.any(axis=0)
    return frame[needed]


def verified(frame: pd.DataFrame, threshold: float, n: int) -> pd.DataFrame:
    """Of the blocks of a frame: the links of each node, and edges from what is linked to its smallest node, which are few
    as the blocks of a group mostly name the same ones. Only pairs that meet in a
    band are compared, by their n-grams and not by hashes of them."""
    frame = frame.reset_index(drop=True)
    sets = gram_ids(frame["text"].tolist(), n)
    bands, sizes = np.array(frame["bands"].tolist(), np.int64), np.array([len(s) for s in sets])
    copies, names = frame["copies"].to_numpy(), frame["node"].tolist()
    out: list[tuple] = []
    for band, left, right in sides(frame):
        linked = meet(bands[left], bands[right], band) & in_reach(sizes[left], sizes[right], threshold)
        if left is right:
            linked = np.triu(linked, 1)
        xs, ys = np.nonzero(linked)
        if not len(xs):
            continue
        if len(xs) > DENSE * linked.size:
            ls = [sets[x] for x in left]
            shared = overlaps(ls, ls if left is right else [sets[y] for y in right])[xs, ys]
        else:
            shared = np.array([len(np.intersect1d(sets[left[x]], sets[right[y]], assume_unique=True)) for x, y in zip(xs, ys, strict=True)])
        true = shared >= threshold * (sizes[left[xs]] + sizes[right[ys]] - shared) - 1e-9
        a, b = left[xs[true]], right[ys[true]]
        count = np.bincount(a, copies[b], len(frame)) + np.bincount(b, copies[a], len(frame))
        out += [(names[x], None, int(count[x])) for x in np.flatnonzero(count)]
        for members in joined(a.tolist(), b.tolist()):
            hub = min(names[x] for x in members)
            out += [(names[x], hub, 0) for x in members if names[x] != hub]
    return pd.DataFrame(out, columns=["node", "peer", "links"])


def joined(a: list[int], b: list[int]) -> list[list[int]]:
    """What the edges between a and b connect, as groups."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(a, b, strict=True):
        parent[root(x)] = root(y)
    groups: dict[int, list[int]] = {}
    for x in parent:
        groups.setdefault(root(x), []).append(x)
    return list(groups.values())


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of noded() without the node of the class."""
    return noded(docs, key, text, **options).drop("class")


def bundled(blocks: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """Blocks dealt to bundles of about `rows` rows, and of about `most` bytes of text, a group of work for one call."""
    count, size = blocks.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    bundles = max(1, count // rows, size // most if most else 0)
    return blocks.withColumn("bundle", F.pmod(F.xxhash64("label", "band", "bucket", "i", "j"), F.lit(bundles)))


def chunked(rows: DataFrame, size: str, weight: str, block: int, most: int = BLOCK_BYTES) -> DataFrame:
    """rows with chunk, i and j: each row in every block of its group that it belongs to. A group has as many chunks as its rows
    and its bytes ask for, at most one a row."""
    parts = F.greatest(F.ceil(F.col(size) / F.lit(float(block))), F.least(F.ceil(F.col(weight) / F.lit(most / 2)), F.col(size)))
    rows = rows.withColumn("parts", parts.cast("int"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")).drop("parts", "other", size, weight)


def candidate_blocks(nodes: DataFrame, block: int, threshold: float) -> DataFrame:
    """(label, band, bucket, i, j, chunk, node, copies, rep, bytes, bands): blocks in which every pair of nodes that meets in a band is
    once to be compared.

    Nodes that meet in a bucket are connected to its smallest node, not to each other. A connected component of at most
    `block` nodes and BLOCK_BYTES of text is one block. A larger one, such as a chain of texts that resemble only their neighbours, is dealt by
    its buckets: a pair belongs to the first band that it meets in, and a node goes only to buckets where it has such a
    partner, so the work grows with the pairs that meet and not with the square of the component.
    """
    banded = nodes.select("node", "bytes", F.posexplode("bands").alias("band", "bucket"))
    hubs = cut(banded.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("weight"), F.min("node").alias("hub")).where("n > 1"))
    met = cut(banded.drop("bytes").join(hubs, ["band", "bucket"]))
    spokes = met.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("k"))
    member = cut(components(spokes, "node", "hub"))
    weighed = member.join(nodes.select("node", "bytes"), "node").groupBy("label").agg(F.count("*").alias("size"), F.sum("bytes").alias("weight"))
    fits = (F.col("size") <= block) & (F.col("weight") <= BLOCK_BYTES)
    member = cut(member.join(weighed.select("label", fits.alias("fits")), "label"))
    facts = nodes.select("node", "copies", "rep", "bytes", "bands")
    columns = ["label", "band", "bucket", "i", "j", "chunk", "node", "copies", "rep", "bytes", "bands"]
    zero = F.lit(0)
    whole = member.where("fits").join(facts, "node")
    whole = whole.select("label", F.lit(-1).alias("band"), F.lit(0).cast("long").alias("bucket"), zero.alias("i"), zero.alias("j"), zero.alias("chunk"), "node", "copies", "rep", "bytes", "bands")
    large = member.where("NOT fits")
    if large.isEmpty():
        return whole
    dealt = met.join(large.select("node"), "node").join(nodes.select("node", "grams", "copies", "rep", "bytes", "bands"), "node").drop("hub")
    dealt = bundled(cut(chunked(dealt, "n", "weight", block).withColumn("label", F.lit(b""))), 8 * block)
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    first = dealt.groupBy("bundle").applyInPandas(lambda frame: first_met(frame, threshold)[columns], ", ".join(f"{c} {kinds[c]}" for c in columns))
    return whole.unionByName(first)


def noded(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: key, th (a hash of the text), class_id (the smallest key of its class), n_links
    (other rows whose n-gram set has a Jaccard similarity of at least the threshold), class (a node of its
    class, which tells classes apart that share their smallest key).

    Rows with equal n-gram sets are one node with a number of copies, so copies are counted and not
    paired. MinHash bands, sized for the recall, are shuffled; pairs that meet in a band are verified on their true
    n-grams, in blocks of bounded size (see candidate_blocks); blocks return counts and stars that connect what is linked, never pairs.

    Texts of fewer than n words have one n-gram, the whole text. Texts without words (null, empty, white
    space) have equal, empty sets and form one class. Very long texts are compared whole. Words compare as written.
    Repeated rows are copies of each other; a null key is returned and never names a class unless all keys are null.
    Other columns of docs, whatever their names, are ignored. No rows give no rows.
    """
    bands, rows = banding(threshold, recall)
    keyed = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    with workspace(docs.sparkSession) as keep:
        signed = keep(cut(keyed.mapInArrow(lambda it: signatures(it, n, bands, rows), f"key {kind}, th long, bytes long, node binary, grams int, bands array<long>")))
        nodes = signed.groupBy("node").agg(F.count("*").alias("copies"), F.min("key").alias("least"), F.min(F.struct("th", "key")).alias("rep"), F.max("bytes").alias("bytes"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
        nodes = cut(nodes)
        blocks = cut(candidate_blocks(nodes, block, threshold))
        wanted = blocks.select("rep").distinct()
        texts = keyed.withColumn("rep", F.struct("th", "key")).join(small(cut(wanted)), "rep", "left_semi").select("rep", "text")
        work = bundled(blocks, 2 * block, BLOCK_BYTES).join(texts, "rep").drop("rep")
        found = cut(work.groupBy("bundle").applyInPandas(lambda frame: verified(frame, threshold, n), "node binary, peer binary, links long"))
        links = found.where("peer IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
        merged = components(found.where("peer IS NOT NULL").select(F.col("node").alias("a"), F.col("peer").alias("b")))
        known = nodes.select("node", "copies", "least").join(links, "node", "left").join(merged, "node", "left")
        known = cut(known.select("node", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "node").alias("class")))
        named = known.groupBy("class").agg(F.min("least").alias("class_id"))
        facts = keep(cut(known.join(named, "class").select("node", "class_id", "n_links", "class")))
    return signed.select("key", "th", "node").join(facts, "node").select(F.col("key").alias(key), "th", "class_id", "n_links", "class")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs without the near copies: of each class the row with the smallest key stays, with all
    its columns; null is the largest key. Rows of one key stay all if they are in different classes; of those in
    one class, the one with the smallest hash of its text stays."""
    found = noded(docs, key, text, **options).select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), F.col("th").alias("h")).alias("row"), "class")
    found = cut(found.groupBy("class", "row").agg(F.count("*").alias("n")))  # key and text of a row tell its class
    best = cut(found.groupBy("class").agg(F.min("row").alias("best"), F.count("*").alias("rows")).where("rows > 1").select("class", "best"))
    goes = small(cut(found.join(small(best), "class").where(F.col("row") != F.col("best")).select("row.k", "row.h")))
    again = cut(found.where("n > 1").select("row.k", "row.h"))
    th = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    left = docs.join(goes, docs[key].eqNullSafe(goes["k"]) & (th == goes["h"]), "left_anti")
    if again.isEmpty():
        return left
    again = small(again)
    repeated = left[key].eqNullSafe(again["k"]) & (F.xxhash64(F.coalesce(left[text], F.lit(""))) == again["h"])
    same = left.join(again, repeated, "left_semi")
    mark = "_".join(["hash", *docs.columns])  # no column of docs
    same = same.withColumn(mark, F.xxhash64(F.coalesce(same[text], F.lit("")))).dropDuplicates([key, mark]).drop(mark)
    return left.join(again, repeated, "left_anti").unionByName(same)


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("th")


SQL = r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS s FROM dw),
node AS (SELECT md5(array_to_string(s, chr(10))) AS node, count(*) AS copies, min(doc_id) AS least, any_value(s) AS s FROM sets GROUP BY 1),
g AS (SELECT node, unnest(s) AS gram FROM node),
pair AS (
  SELECT x.node AS a, y.node AS b, count(*) AS shared
  FROM g x JOIN g y ON x.gram = y.gram AND x.node <> y.node GROUP BY 1, 2),
link AS (
  SELECT a, b FROM pair JOIN node na ON na.node = a JOIN node nb ON nb.node = b
  WHERE shared >= 0.8 * (len(na.s) + len(nb.s) - shared) - 1e-9),
walk AS (
  SELECT node AS start, node AS here FROM node
  UNION SELECT start, b FROM walk JOIN link ON here = a),
class AS (SELECT start AS node, min(least) AS class_id FROM walk JOIN node ON here = node.node GROUP BY 1),
n AS (SELECT a AS node, sum(copies) AS links FROM link JOIN node ON b = node.node GROUP BY 1)
SELECT doc_id, class_id, CAST(copies - 1 + coalesce(links, 0) AS BIGINT) AS n_links
FROM sets JOIN node ON node.node = md5(array_to_string(sets.s, chr(10))) JOIN class ON class.node = node.node LEFT JOIN n ON n.node = node.node
"""
