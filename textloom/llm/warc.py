"""Web pages as WARC archives, and archives read back from any byte range by chains of record boundaries."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import cut, scratch, small, workspace
from .token_output import store_of
from .warcfile import page_of, page_record, record, record_id, records, successors

#: Bytes from which an equal payload is written once.
LEAST = 1000
#: Bytes after which a task starts another archive, and bytes of an archive that a task scans.
FILE_BYTES, CHUNK = 256 << 20, 8 << 20
#: The date of all records, as pages state none.
DATE = "2024-01-01T00:00:00Z"


def with_winners(rows: DataFrame, least: int) -> DataFrame:
    """rows (row, key, payload_bytes, same, ...) with refers, the row of the response that a row's payload was written with;
    null for responses. Groups are counted with reduction in the map, so that none is in one task."""
    best = F.max(F.struct(F.col("key").isNotNull().alias("named"), "key", (-F.col("row")).alias("row")))
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("same").agg(F.count("*").alias("n"), best.alias("best")).where("n > 1")
    winners = cut(groups.select(F.col("same").alias("same_"), (-F.col("best.row")).alias("winner")))
    met = rows.join(small(winners), F.col("same") == F.col("same_"), "left")
    return met.withColumn("refers", F.when(F.col("winner") != F.col("row"), F.col("winner"))).drop("same_", "winner")


def write_part(batches: Iterator[pa.RecordBatch], folder: str, date: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition to archives, each under a name of its own when it is whole; then their manifest."""
    store, root = store_of(folder)
    store.create_dir(root)
    files, sizes, counts = [], [], []
    out, name, size, count = None, "", 0, 0

    def end() -> None:
        out.close()
        files.append(name)
        sizes.append(size)
        counts.append(count)

    for batch in batches:
        columns = [batch.column(c) for c in ("row", "key", "url", "html", "sha1", "refers")]
        for values in zip(*columns, strict=True):
            row, key, url, html, sha1, refers = (v.as_py() for v in values)
            if out is None:
                name, size, count = f"pages-{uuid.uuid4().hex}.warc", 0, 0
                out = store.open_output_stream(f"{root}/{name}")
                data = record("warcinfo", record_id(name, 0), date, [("WARC-Filename", name)], "application/warc-fields", b"software: textloom\r\nformat: WARC File Format 1.1\r\n")
                out.write(data)
                size = len(data)
            data = page_record(folder, date, row, key, url, (html or "").encode(), sha1, refers)
            out.write(data)
            size, count = size + len(data), count + 1
            if size >= file_bytes:
                end()
                out = None
    if out is not None:
        end()
    if files:
        yield pa.RecordBatch.from_pydict({"file": files, "size": sizes, "records": counts})


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, date: str = DATE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of pages; the manifest (file, size, records).

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads (by SHA-256) of at least least bytes that
    with the largest key is a response, null being the smallest and the first of equal rows counting; the others are revisits
    that refer to it. An archive starts with a warcinfo record. Null urls and keys have no header field; control characters
    and spaces of urls are percent-encoded. Very long pages and urls are written whole. No rows make no archive. Other columns,
    whatever their names, are ignored. A task that runs again writes archives of other names; those of failed tasks
    are in no manifest.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    made = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"), F.octet_length(payload).alias("payload_bytes"), F.unhex(F.sha2(payload.cast("binary"), 256)).alias("same"))
    with workspace(pages.sparkSession) as keep:
        rows = with_winners(cut(made.withColumn("row", F.monotonically_increasing_id()), compression="zstd"), least)
        written = rows.select("row", F.col("key").cast("string").alias("key"), "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha1"), "refers")
        return keep(cut(written.mapInArrow(lambda it: write_part(it, folder, date, file_bytes), "file string, size long, records long")))


def chunk_links(batches: Iterator[pa.RecordBatch], folder: str, chunk: int) -> Iterator[pa.RecordBatch]:
    """(file, at, to) of every candidate in a chunk: to is where the chain from it leaves the chunk. Chains that end at no
    candidate are none."""
    store, root = store_of(folder)
    for part in batches:
        for row in part.to_pylist():
            file, size, start = row["file"], row["size"], row["start"]
            end = min(size, start + chunk)
            with store.open_input_file(f"{root}/{file}") as stream:
                found = list(successors(stream, start, end, size))
            leaves: dict[int, int] = {}
            for at, after in reversed(found):
                if after >= end:
                    leaves[at] = after
                elif after in leaves:
                    leaves[at] = leaves[after]
            if leaves:
                yield pa.RecordBatch.from_pydict({"file": [file] * len(leaves), "at": list(leaves), "to": list(leaves.values())}, pa.schema([("file", pa.string()), ("at", pa.int64()), ("to", pa.int64())]))


def entries(manifest: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """(file, at): where the chain of records from the start of each archive enters its chunks.

    Every task scans a chunk on its own and cannot know which candidates are records: payloads may hold archives. It
    gives for each candidate the offset at which the chain from it leaves the chunk. Of these links those that another one leads
    to, and those at a file's start, take part in pointer jumping: reached places double with each round, pointers are
    joined with themselves, and what the start of a file does not reach was inside a payload. A file whose
    chain does not reach its end is damaged, which is an error.
    """
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = manifest.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(chunk).cast("long"))).alias("start"))
    with workspace(manifest.sparkSession) as keep:
        links = cut(starts.repartition(parts, "file", "start").mapInArrow(lambda it: chunk_links(it, folder, chunk), "file string, at long, to long"))
        aims = links.select("file", F.col("to").alias("at")).distinct()
        first = manifest.where("size > 0").select("file", F.lit(0).cast("long").alias("at"))
        jump = cut(links.join(aims.unionByName(first), ["file", "at"], "left_semi"))
        reached = first
        most = manifest.agg(F.max("size")).first()[0] or 1
        for _ in range(math.ceil(math.log2(-(-most // chunk) + 1)) + 1):
            ahead = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
            reached = cut(reached.unionByName(ahead).distinct())
            further = jump.select("file", F.col("at").alias("to"), F.col("to").alias("end"))
            jump = cut(jump.join(further, ["file", "to"]).select("file", "at", F.col("end").alias("to")))
        ends = reached.withColumnRenamed("at", "size")
        broken = manifest.where("size > 0").join(ends, ["file", "size"], "left_anti").select("file").limit(1).collect()
        if broken:
            raise ValueError(f"records of {broken[0][0]} do not reach its end")
        return keep(cut(reached.join(manifest.select("file", "size"), "file").where("at < size")))


def read_chunk(batches: Iterator[pa.RecordBatch], folder: str, chunk: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The pages of the records from an entry to the end of its chunk."""
    store, root = store_of(folder)
    for part in batches:
        for row in part.to_pylist():
            rows, held = [], 0
            with store.open_input_file(f"{root}/{row['file']}") as stream:
                for fields, block in records(stream, row["at"], (row["at"] // chunk + 1) * chunk, row["size"]):
                    if fields["warc-type"] in ("response", "revisit"):
                        page = page_of(fields, block)
                        rows.append({c: page[c] for c in schema.names})
                        held += len(block)
                    if len(rows) >= 2048 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_records(manifest: DataFrame, folder: str, payload: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The response and revisit records of the archives, read once and written: key, url, payload_bytes, payload_digest, record_type,
    record_id, refers_id and, if wanted, payload."""
    schema = "key string, url string, payload_bytes long, payload_digest string, record_type string, record_id string, refers_id string" + (", payload binary" if payload else "")
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = entries(manifest, folder, chunk).repartition(parts, "file", "at")
    return cut(found.mapInArrow(lambda it: read_chunk(it, folder, chunk, arrow), schema))


def resolved(pages: DataFrame, key: str = "page_id", key_type: str = "long") -> DataFrame:
    """Records with the key of the response that a revisit refers to as refers_to: key, url, payload_bytes, payload_digest, record_type,
    refers_to and, if there is one, payload (null for revisits)."""
    payload = "payload" in pages.columns
    revisits = pages.where("refers_id IS NOT NULL")
    responses = pages.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("key").alias("refers_to"))
    names = ["url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payload else [])]
    plain = pages.where("refers_id IS NULL").withColumn("refers_to", F.lit(None).cast("string"))
    if payload:
        revisits = revisits.withColumn("payload", F.lit(None).cast("binary"))
    both = plain.select("key", *names).unionByName(revisits.join(responses, "refers_id").select("key", *names))
    return both.withColumns({"key": F.col("key").cast(key_type), "refers_to": F.col("refers_to").cast(key_type)}).withColumnRenamed("key", key)


def read_archives(manifest: DataFrame, folder: str, payload: bool = True, key: str = "page_id", key_type: str = "long", chunk: int = CHUNK) -> DataFrame:
    """Every page of the archives: key, url, payload_bytes, payload_digest (SHA-1 of the full payload), record_type, refers_to
    (the key of the response that a revisit refers to) and, if wanted, payload (null for revisits of another record)."""
    return resolved(read_records(manifest, folder, payload, chunk), key, key_type)


def op12_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    with workspace(spark) as keep:
        folder = scratch(spark, "warc")
        found = keep(read_records(write_archives(pages, folder), folder, payload=False))
    return resolved(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, url, html, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS best FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to, url
FROM q
"""
