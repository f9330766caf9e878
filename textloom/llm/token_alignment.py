"""Two tokenizers' splits of the same bytes, aligned by arrays of the tokens that own each byte."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, workspace

#: Characters of text in a block, about: what a task aligns and looks up together. A longer text is a block of its own.
BLOCK_CHARS = 2_000_000
#: Segments and ids that a worker remembers before it starts anew: bounds on its memory, not on input.
KEPT_SEGMENTS, KEPT_IDS = 700_000, 6_000_000
#: Marks of the piece vocabulary's format: a space, and a byte.
SPACE_MARK = "▁"
#: The characters that the byte-level vocabulary takes for white space (Unicode's White_Space).
BLANKS = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space and what follows it: no token of either vocabulary starts before white space and ends behind it (for pieces
#: this is looked up on loading), so segments are encoded one by one and their tokens are those of the whole text.
SEGMENT = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")


def byte_letters() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the others, in order,
    for 256 and up (the format's rule)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Splitter:
    """Token ids of a byte-level vocabulary (A) and a piece vocabulary (B) per segment, and the bytes of every token."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        spelled = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.in_segments = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in spelled)
        #: White space that pieces join to other characters, or that the byte-level split does not take for it: texts with it are
        #: encoded whole.
        self.joined = {c for p in spelled if len(p) > 1 for c in re.findall(f"[{BLANKS}]", p)} | {"\x85"}
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        #: Token ids as text, with the sign that follows inside a group (first half) and at a group's end (second).
        self.text_a = [f"{i},".encode() for i in range(len(self.bytes_a))] + [f"{i}|".encode() for i in range(len(self.bytes_a))]
        self.text_b = [f"{i},".encode() for i in range(len(self.bytes_b))] + [f"{i};".encode() for i in range(len(self.bytes_b))]
        self.restart()

    def restart(self) -> None:
        self.known: dict[str, int] = {}  # the number of a segment
        none = np.zeros(0, np.int64)
        self.ids, self.counts, self.fits = [none, none], [none, none], np.zeros(0, bool)

    def learn(self, segments: list[str]) -> None:
        """Number new segments and store their ids; a segment fits if both tokenizers spell it."""
        found_a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        # B puts a space before every text: it takes the place of the segment's own, or is dropped
        found_b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        for i, s in enumerate(segments):
            if s == " ":
                found_b[i] = [self.b.piece_to_id(SPACE_MARK)]
            elif s[0] != " ":
                found_b[i] = found_b[i][1:] if found_b[i] and self.bytes_b[found_b[i][0]] == b" " else [0]
        raw = [s.encode() for s in segments]
        fits = np.ones(len(segments), bool)
        for k, (found, table) in enumerate(((found_a, self.bytes_a), (found_b, self.bytes_b))):
            counts = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int64, counts.sum())
            spelled = list(map(table.__getitem__, flat.tolist()))
            ends = np.cumsum(counts)
            lengths = np.concatenate([[0], np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled)))])
            same = lengths[ends] - lengths[ends - counts] == np.fromiter(map(len, raw), np.int64, len(raw))
            if not same.all() or b"".join(spelled) != b"".join(raw):
                same = np.array([b"".join(spelled[i:j]) == r for i, j, r in zip((ends - counts).tolist(), ends.tolist(), raw, strict=True)])
            fits &= same
            self.ids[k], self.counts[k] = np.concatenate([self.ids[k], flat]), np.concatenate([self.counts[k], counts])
        self.fits = np.concatenate([self.fits, fits])
        self.known.update(zip(segments, range(len(self.known), len(self.known) + len(segments)), strict=True))

    def split(self, text: str) -> list[str]:
        return SEGMENT.findall(" " + text) if self.in_segments and not any(c in text for c in self.joined) else [" " + text]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B: the ids of a space and each text, one text behind the other, and how many each has; texts that do not
        fit have none."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.known) > KEPT_SEGMENTS or len(self.ids[0]) > KEPT_IDS:
            self.restart()
        if new := [s for s in set().union(*split) if s not in self.known]:
            self.learn(new)
        per_text = np.fromiter(map(len, split), np.int64, len(split))
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, per_text.sum())
        text_of = np.repeat(np.arange(len(texts)), per_text)
        bad = np.bincount(text_of, ~self.fits[which], minlength=len(texts)) > 0
        which, text_of = which[~bad[text_of]], text_of[~bad[text_of]]
        found = []
        for ids, counts in zip(self.ids, self.counts, strict=True):
            n, start = counts[which], (np.cumsum(counts) - counts)[which]
            ends = np.cumsum(n)
            found.append((ids[np.arange(n.sum()) + np.repeat(start - (ends - n), n)], np.bincount(text_of, n, minlength=len(texts)).astype(np.int64)))
        return found

    def align(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """Aligns texts together, as one run of bytes in which documents are cut apart like groups.

        Token numbers are repeated over the bytes that they own. Wherever an owner changes a new pair of owners overlaps;
        where both change a group ends. Given back per text: counts and the digest of its groups; of all texts: distinct
        linked pairs of ids and how often they are linked; per text its distinct pairs, as places among these, and times.
        """
        (a, n_a), (b, n_b) = self.encode(texts)
        owner_a, owner_b = np.repeat(np.arange(len(a)), self.size_a[a]), np.repeat(np.arange(len(b)), self.size_b[b])
        turn_a, turn_b = owner_a[1:] != owner_a[:-1], owner_b[1:] != owner_b[:-1]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(owner_a)), bool), turn_a | turn_b]))
        last = np.append(np.flatnonzero(turn_a & turn_b), np.full(min(1, len(owner_a)), len(owner_a) - 1)).astype(np.int64)
        link_a, link_b = owner_a[first], owner_b[first]
        doc_of_a = np.repeat(np.arange(len(texts)), n_a)
        link_doc = doc_of_a[link_a]
        group_a, group_b = owner_a[last], owner_b[last]  # the last tokens of each group
        n_groups, n_links = (np.bincount(doc_of_a[x], minlength=len(texts)) for x in (group_a, link_a))
        pairs, which = np.unique(a[link_a] << 32 | b[link_b], return_inverse=True)
        own, times = np.unique(link_doc * len(pairs) + which, return_counts=True)
        sizes = np.bincount(own // max(1, len(pairs)), minlength=len(texts))
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": self.written(a, b, group_a, group_b, n_a + n_b),
            "pairs": pairs, "totals": np.bincount(which, minlength=len(pairs)), "sizes": sizes, "own": own % max(1, len(pairs)), "times": times,
        }

    def written(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n: np.ndarray) -> list[str]:
        """The digest of each text's groups as `a1,a2|b1;a3|b2,b3`. Tokens take their places group by group, A's before B's."""
        ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_a[group_a] = ends_b[group_b] = 1
        groups_a, groups_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b  # the group of each token
        place_a = np.arange(len(a)) + np.concatenate([[0], group_b + 1])[groups_a]
        place_b = np.arange(len(b)) + (group_a + 1)[groups_b] if len(b) else np.zeros(0, np.int64)
        code = np.empty(len(a) + len(b), np.int64)
        code[place_a] = a + ends_a * len(self.bytes_a)
        code[place_b] = b + ends_b * len(self.bytes_b) + len(self.text_a)
        table = self.text_a + self.text_b
        texts = list(map(table.__getitem__, code.tolist()))
        bounds = np.concatenate([[0], np.cumsum(n)]).tolist()
        return [hashlib.sha256(b"".join(texts[i:j])[:-1]).hexdigest() if j > i else "" for i, j in zip(bounds, bounds[1:], strict=False)]


_splitters: dict[tuple[str, str], Splitter] = {}


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Keys and texts of some BLOCK_CHARS characters; a longer text makes a block longer."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
            keys.append(key.as_py())
            texts.append(text.as_py())
            size += len(texts[-1] or "") + 50
            if size >= BLOCK_CHARS:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


PER_TEXT = ("n_a", "n_b", "n_groups", "n_links")


def aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A row per block: keys, counts and digests of its texts, its distinct pairs with totals, and the texts' own pairs."""
    if (path_a, path_b) not in _splitters:
        _splitters[path_a, path_b] = Splitter(path_a, path_b)
    splitter, task = _splitters[path_a, path_b], TaskContext.get().partitionId()
    for number, (keys, texts) in enumerate(blocks(batches)):
        found = splitter.align(texts)
        row = {"block": pa.array([task << 32 | number], pa.int64()), "keys": pa.array([keys], pa.list_(key_type)), "groups": pa.array([found["groups"]], pa.list_(pa.string()))}
        for name in (*PER_TEXT, "totals", "sizes", "own", "times"):
            row[name] = pa.array([found[name].astype(np.int32)], pa.list_(pa.int32()))
        row["pairs"] = pa.array([found["pairs"]], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_pydict(row)


def summed(batches: Iterator[pa.RecordBatch], key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A row per text from a block and what its pairs count corpus-wide."""
    for batch in batches:
        for i in range(batch.num_rows):
            values = {name: batch.column(name)[i].values for name in ("keys", "groups", *PER_TEXT, "sizes", "own", "times", "counts", "best")}
            own, times = (values[c].to_numpy().astype(np.int64) for c in ("own", "times"))
            place = np.repeat(np.arange(len(values["keys"])), values["sizes"].to_numpy())
            n_best, count_sum = np.zeros(len(values["keys"]), np.int64), np.zeros(len(values["keys"]), np.int64)
            np.add.at(n_best, place, times * values["best"].to_numpy(zero_copy_only=False)[own])
            np.add.at(count_sum, place, times * values["counts"].to_numpy()[own])
            columns = [pa.array(values[c].to_numpy().astype(np.int64)) for c in PER_TEXT]
            yield pa.RecordBatch.from_arrays([values["keys"].cast(key_type), *columns, pa.array(n_best), pa.array(count_sum), values["groups"]], names=["key", *PER_TEXT, "n_best", "count_sum", "groups_sha256"])


def align_tokens(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text by a byte-level vocabulary, B the text by a piece vocabulary that adds the space. Groups
    end where tokens of both end; links are all pairs of overlapping tokens. A pair of ids counts as often as it is
    linked in all docs; n_best are links whose pair has the largest count of its B id, count_sum sums counts over links.

    Texts are encoded once. A block of texts gives its distinct pairs, which are summed with reduction in the map and
    looked up by block, so what is shuffled grows with the vocabulary that blocks use and not with their words, and a
    pair's key has a row per block at most. The largest count of a B id is taken over the A ids that meet it, which
    the vocabulary bounds. Null and empty texts, and texts whose tokens do not spell the space and the text, have no tokens:
    zeros and an empty string. Very long texts are aligned whole. Repeated rows and null or repeated keys are rows each. Other
    columns, whatever their names, are ignored. No rows give no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    key_type = pa.from_numpy_dtype(np.dtype("int64")) if kind in ("bigint", "int") else pa.string()
    rows = docs.select(F.col(key).cast("long" if kind in ("bigint", "int") else "string").alias("key"), F.col(text).alias("text"))
    key_kind = rows.schema["key"].dataType.simpleString()
    lists = ", ".join(f"{c} array<int>" for c in (*PER_TEXT, "totals", "sizes", "own", "times"))
    schema = f"block long, keys array<{key_kind}>, groups array<string>, {lists}, pairs array<long>"
    with workspace(docs.sparkSession) as keep:
        made = keep(cut(rows.mapInArrow(lambda it: aligned(it, path_a, path_b, key_type), schema)))
        seen = made.select("block", F.posexplode(F.arrays_zip("pairs", "totals")).alias("at", "x")).select("block", "at", F.col("x.pairs").alias("pair"), F.col("x.totals").alias("n"))
        counts = seen.groupBy("pair").agg(F.sum("n").alias("count"))
        of_b = Window.partitionBy(F.col("pair").bitwiseAND((1 << 32) - 1))
        counts = cut(counts.select("pair", "count", (F.col("count") == F.max("count").over(of_b)).alias("best")))
        looked = seen.select("block", "at", "pair").join(counts, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "count", "best"))).alias("x"))
        looked = keep(cut(looked.select("block", F.col("x.count").alias("counts"), F.col("x.best").alias("best"))))
    nothing = [F.coalesce("counts", F.array().cast("array<long>")).alias("counts"), F.coalesce("best", F.array().cast("array<boolean>")).alias("best")]
    both = made.select("block", "keys", "groups", *PER_TEXT, "sizes", "own", "times").join(looked, "block", "left").select("keys", "groups", *PER_TEXT, "sizes", "own", "times", *nothing)
    found = both.mapInArrow(lambda it: summed(it, key_type), f"key {key_kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return found.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
