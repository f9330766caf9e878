"""Token ids of documents in sorted-string-table shards."""

from __future__ import annotations

import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scratch
from .shingles import hashed, spans
from .tokenfile import Reader, Writer, key_bytes, key_value

END = 1
#: Leading characters of a text by which rows of one key are cut into shards; the driver samples them. Rows that agree
#: in them are cut by a hash of their texts.
PREFIX = 16
#: Bytes of text in a shard, about; a row counts ROW_BYTES more, so that a shard of empty texts has a bounded Bloom filter.
SHARD_BYTES, ROW_BYTES = 256 << 20, 64
#: Pieces that a worker remembers before it starts anew: a bound on its memory, not on input.
KEPT_PIECES = 1_500_000
#: Texts, or characters of text, that are encoded together.
TOGETHER_TEXTS, TOGETHER_CHARS = 200, 600_000
#: Marks that the vocabulary splits from the letters before them, and keeps together.
MARKS = np.zeros(256, bool)
MARKS[list(b"!#$%&*.,;:?)|")] = True


def split_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, core_ends): where the letters of each plain word end and its marks begin, and the bytes with the letters
    of plain words in lower case. Plain words are ASCII or Latin-1 letters with MARKS behind them; of others the
    core is the whole word, as it is."""
    place = np.arange(len(data))
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3  # the first byte of the letters from U+00C0 to U+00FF, but for two signs
    latin = after & (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)
    lead = np.zeros(len(data), bool)
    lead[:-1] = (data[:-1] == 0xC3) & latin[1:]
    capital = (data >= 65) & (data <= 90)
    letter = capital | (data >= 97) & (data <= 122) | latin | lead
    before = np.maximum.accumulate(np.where(MARKS[data], -1, place))
    core_ends = np.maximum(starts, before[ends - 1] + 1)
    odd = np.concatenate([[0], np.cumsum(~letter)])
    plain = odd[core_ends] == odd[starts]
    low = data.copy()
    low[capital | latin & (data <= 0x9E)] += 32
    lengths = ends - starts
    whole = np.repeat(~plain, lengths)
    inside = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    low[inside[whole]] = data[inside[whole]]
    return low, np.where(plain, core_ends, ends)


def distinct_pieces(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at, piece_of): a place of each distinct piece, and which of them each piece is. Pieces are grouped by a hash and
    then compared by their bytes; pieces that share a hash only are told apart."""
    _, at, piece_of = np.unique(hashed(data, first, last), return_index=True, return_inverse=True)
    like = at[piece_of]
    lengths = last - first
    alike = lengths == (last - first)[like]
    held = np.where(alike, lengths, 0)
    inside = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
    differs = data[np.repeat(first, held) + inside] != data[np.repeat(first[like], held) + inside]
    alike[np.repeat(np.arange(len(first)), held)[differs]] = False
    seen: dict[bytes, int] = {}
    for i in np.flatnonzero(~alike).tolist():
        piece = data[first[i] : last[i]].tobytes()
        if piece not in seen:
            seen[piece] = len(at)
            at = np.append(at, i)
        piece_of[i] = seen[piece]
    return at, piece_of


class Encoder:
    """Encodes texts by words, plain ones by letters and marks, and remembers these pieces.

    The vocabulary's pre-tokens stop at white space and between letters and marks, and its normaliser puts
    letters in lower case one by one, so the ids of the pieces, in order, are the ids of the whole text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.known: dict[bytes, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        packed = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def learn(self, pieces: list[bytes]) -> None:
        if len(self.known) + len(pieces) > KEPT_PIECES:
            self.known.clear()
        found = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        self.known.update(zip(pieces, [self.pack(e.ids) for e in found], strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text with the end id, packed. Pieces that the texts share, byte by byte, are looked up once."""
        data, starts, ends, counts = spans([(t or "").encode() for t in texts])
        end = self.pack([END])
        if not len(starts):
            return [end] * len(texts)
        low, core_ends = split_words(data, starts, ends)
        first, last = np.stack([starts, core_ends], 1).ravel(), np.stack([core_ends, ends], 1).ravel()
        real = last > first
        per_word = real.reshape(-1, 2).sum(1)
        first, last = first[real], last[real]
        at, piece_of = distinct_pieces(low, first, last)
        blob = low.tobytes()
        distinct = [blob[i:j] for i, j in zip(first[at].tolist(), last[at].tolist(), strict=True)]
        ids = list(map(self.known.get, distinct))
        if None in ids:
            new = [p for p, x in zip(distinct, ids, strict=True) if x is None]
            if len(self.known) + len(new) > KEPT_PIECES:
                new = distinct
            self.learn(new)
            ids = list(map(self.known.__getitem__, distinct))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        packed = np.frombuffer(b"".join(ids), f"<u{self.width}")
        sizes, source = size[piece_of], (np.cumsum(size) - size)[piece_of]
        token_ends = np.cumsum(sizes)
        tokens = packed[np.arange(token_ends[-1]) + np.repeat(source - (token_ends - sizes), sizes)]
        pieces_before = np.concatenate([[0], np.cumsum(per_word)])[np.concatenate([[0], np.cumsum(counts)])]
        bounds = np.concatenate([[0], token_ends])[pieces_before].tolist()
        return [tokens[i:j].tobytes() + end for i, j in zip(bounds, bounds[1:], strict=False)]


_encoders: dict[str, Encoder] = {}


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Keys and texts of a few hundred rows, fewer if the texts are long."""
    for batch in batches:
        keys, texts, size = [], [], 0
        for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
            keys.append(key.as_py())
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if len(keys) >= TOGETHER_TEXTS or size >= TOGETHER_CHARS:
                yield keys, texts
                keys, texts, size = [], [], 0
        if keys:
            yield keys, texts


def store_of(folder: str) -> tuple:
    """The file system of a folder and the folder's path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def write_shard(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str) -> Iterator[pa.RecordBatch]:
    """One partition, sorted by key, to one shard; then its row of the manifest. The file appears under its
    name when it is whole, so a task that runs again does no harm."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if tokenizer not in _encoders:
        _encoders[tokenizer] = Encoder(tokenizer)
    encoder = _encoders[tokenizer]
    shard = TaskContext.get().partitionId()
    store, root = store_of(folder)
    store.create_dir(root)
    name, draft = f"{root}/shard-{shard:06d}.sst", f"{root}/.draft-{uuid.uuid4().hex}"
    writer = None
    for keys, texts in runs(batches):
        if writer is None:
            out = store.open_output_stream(draft)
            writer = Writer(out, encoder.width)
        for key, ids in zip(keys, encoder.encode(texts), strict=True):
            writer.add(key_bytes(key), ids)
    if writer is not None:
        writer.close()
        out.close()
        store.move(draft, name)
        row = {"shard": [shard], "file": [f"shard-{shard:06d}.sst"], "entries": [writer.entries], "tokens": [writer.tokens]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32()), ("file", pa.string()), ("entries", pa.int64()), ("tokens", pa.int64())]))


def open_shard(folder: str, file: str) -> Reader:
    store, root = store_of(folder)
    stream = store.open_input_file(f"{root}/{file}")
    return Reader(stream, stream.size())


def read_shards(batches: Iterator[pa.RecordBatch], folder: str, digest: bool) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        keys, starts, sizes, last = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(last, pa.int64() if digest else pa.list_(pa.int32()))],
            names=["key", "start", "n_tokens", "last"],
        )

    for part in batches:
        for row in part.to_pylist():
            rows, held = [], 0
            for key, before, ids in open_shard(folder, row["file"]):
                rows.append((key_value(key), row["start"] + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int32)))
                held += 1 if digest else len(ids)
                if len(rows) >= 4096 or held > 1 << 20:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, shards: int | None = None, key: str = "doc_id", text: str = "text") -> tuple[str, DataFrame]:
    """Encode every whole text, add the end id, and write shards in ascending key order: (folder, manifest).

    The manifest has a row per shard: shard, file, entries, tokens, start (ids in the shards before it).
    Keys are integers. A null key comes first; rows with one key follow each other in the order of their
    first PREFIX characters, then of a hash of the text; null and empty texts have the end id alone. Very long texts are
    encoded whole. No rows make no shard. Other columns are ignored. There are as many shards as shuffle partitions, and
    more if a shard would have over SHARD_BYTES of text. Without a folder the shards are in one that goes with the workspace.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    if shards is None:
        size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(ROW_BYTES).cast("long"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    order = ["key", F.substring("text", 1, PREFIX), F.xxhash64("text")]
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    made = cut(rows.mapInArrow(lambda it: write_shard(it, folder, tokenizer), "shard int, file string, entries long, tokens long"))
    drafts = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/.draft-*")
    files = drafts.getFileSystem(spark._jsc.hadoopConfiguration())
    for left in files.globStatus(drafts) or []:  # of tasks that failed
        files.delete(left.getPath(), False)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return folder, cut(made.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long")))


def read_tokens(folder: str, manifest: DataFrame, digest: bool = False, key: str = "doc_id") -> DataFrame:
    """Every document of the shards: key, start, n_tokens, ids; with digest, the crc32 of the ids instead."""
    shards = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = manifest.select("shard", "file", "start").repartitionByRange(shards, "shard")
    last = "long" if digest else "array<int>"
    rows = spread.mapInArrow(lambda it: read_shards(it, folder, digest), f"key long, start long, n_tokens long, last {last}")
    return rows.select(F.col("key").alias(key), "start", "n_tokens", F.col("last").alias("ids_crc32" if digest else "ids"))


def lookup(folder: str, manifest: DataFrame, keys: list[int]) -> DataFrame:
    """(key, ids) of a stated list of keys, by binary search in every shard that may hold them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for file in part.column("file").to_pylist():
                reader = open_shard(folder, file)
                found = [(k, ids.astype(np.int32)) for k in keys for ids in reader.get(key_bytes(k))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int32()))], names=["key", "ids"])

    return manifest.select("file").repartition("file").mapInArrow(find, "key long, ids array<int>")


def op8_token_output(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    folder, manifest = write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(folder, manifest, digest=True)
