"""Token-ID output as length-delimited binary records with masked checksums, and a separate offset index.

A data set is a folder with ``records/`` (shards in ascending doc_id order) and ``index/`` (Parquet: doc_id, shard,
offset, length, n_tokens, ids_crc32, first). One record, all integers little-endian::

    u64 n        payload bytes
    u32          masked CRC-32 of the eight bytes above
    n bytes      payload: u8 1 if the doc_id is null, i64 doc_id, u8 bytes per id (2 or 4), then the ids
    u32          masked CRC-32 of the payload
    0x0A         terminator

``masked(c) = rotate_right(c, 15) + 0xA282EAD8 mod 2^32``, so a checksum stored among data doesn't check itself.

Documents are range-partitioned by doc_id, then by how the text begins and the row number, before they are encoded, so rows
that share an id, or have none, or are wholly equal, are still cut into many shards of about ``shard_bytes``. Each task
encodes its sorted share and Spark's own file writer commits the shard, so a lost executor or a repeated attempt leaves
no half shard, and any Hadoop file system will do. Records are arbitrary bytes, mostly no valid UTF-8; the text writer
puts a string's bytes as they are, and the checksums would show it if it did not. The index comes from reading the
shards back and checking every checksum.

Defined edge cases: a null text is an empty text (only the end id); a null doc_id sorts first; equal doc_ids are
ordered by the first 64 characters of the text, then as they come; a very long text is one record in a shard of its own size; an empty table gives no
records; other columns are left alone.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftmill.llm.common import arrow_schema, per_text, scratch_path, texts
from weftmill.llm.tokens import encoder

HEAD = struct.Struct("<QI")
META = struct.Struct("<BqB")
TAIL = struct.Struct("<I")
_PART = re.compile(r"part-(\d+)")


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int = 2) -> bytes:
    """One record without its terminator, which the writer appends."""
    payload = META.pack(doc_id is None, doc_id or 0, width) + ids
    size = struct.pack("<Q", len(payload))
    return b"".join((size, TAIL.pack(masked(zlib.crc32(size))), payload, TAIL.pack(masked(zlib.crc32(payload)))))


def record_at(data: bytes | memoryview, offset: int = 0) -> tuple[int | None, np.ndarray, int]:
    """``(doc_id, ids, offset of the next record)``; raises if a checksum or the framing is wrong."""
    n, check = HEAD.unpack_from(data, offset)
    if masked(zlib.crc32(bytes(data[offset : offset + 8]))) != check:
        raise ValueError(f"damaged length at byte {offset}")
    body = data[offset + HEAD.size : offset + HEAD.size + n]
    end = offset + HEAD.size + n + TAIL.size
    if len(body) != n or end >= len(data) or masked(zlib.crc32(body)) != TAIL.unpack_from(data, end - TAIL.size)[0] or data[end] != 10:
        raise ValueError(f"damaged record at byte {offset}")
    null, doc_id, width = META.unpack_from(body)
    return None if null else doc_id, np.frombuffer(body, dtype=f"<u{width}", offset=META.size), end + 1


def read_record(file, offset: int) -> tuple[int | None, np.ndarray]:
    """The record at an index offset of a seekable file: a shuffled read."""
    file.seek(offset)
    head = file.read(HEAD.size)
    doc_id, ids, _ = record_at(head + file.read(HEAD.unpack(head)[0] + TAIL.size + 1))
    return doc_id, ids


def write(docs: DataFrame, base: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, tokenizer_path: str | None = None, shard_bytes: int = 24 << 20) -> str:
    """Write the records of ``docs`` below ``base``; a shard holds about ``shard_bytes`` of text."""
    rows = texts(docs).withColumn("head", F.left("text", F.lit(64))).withColumn("row", F.monotonically_increasing_id())
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    ordered = rows.repartitionByRange(max(1, -(-total // shard_bytes)), "doc_id", "head", "row").sortWithinPartitions("doc_id", "head", "row").select("doc_id", "text")
    tail = np.array([end_id], dtype="<u2").tobytes()

    def encode(batch) -> dict:
        ids = encoder(tokenizer, tokenizer_path).encode_batch(batch.column("text").to_pylist())
        return {"record": [frame(d, b + tail) for d, b in zip(batch.column("doc_id").to_pylist(), ids, strict=True)]}

    # the text writer puts a string's bytes as they are and the separator after each: the record and its terminator
    per_text(ordered, encode, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{base}/records")
    return base


def scan(spark: SparkSession, base: str) -> DataFrame:
    """Read the shards back, check everything, and give one row a record, in order within its shard."""
    ddl = "doc_id long, shard long, offset long, length long, n_tokens long, ids_crc32 long, first long"
    schema = arrow_schema(ddl)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                shard = int(_PART.search(path.as_py().rsplit("/", 1)[-1])[1])
                out: list[list] = [[] for _ in schema.names]
                at = first = 0
                while at < len(data):
                    doc_id, ids, nxt = record_at(data, at)
                    for column, v in zip(out, (doc_id, shard, at, nxt - at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), first), strict=True):
                        column.append(v)
                    first += len(ids)
                    at = nxt
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{base}/records").select("path", "content").mapInArrow(read, ddl)


def build_index(spark: SparkSession, base: str) -> DataFrame:
    """Write ``base/index`` from a checked scan of the shards and return it."""
    scan(spark, base).write.parquet(f"{base}/index")
    return spark.read.parquet(f"{base}/index")


def starts(index: DataFrame, block: int = 1000) -> DataFrame:
    """Add ``start``, the number of ids in all earlier records: sums by shard, then by block of shards, then prefixes."""
    shard = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.floor(F.col("shard") / block))
    whole = shard.groupBy("block").agg(F.sum("n").alias("n"))

    def prefix(window):
        return F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    base = whole.select("block", prefix(Window.orderBy("block")).alias("base"))
    inside = shard.select("shard", "block", prefix(Window.partitionBy("block").orderBy("shard")).alias("inside"))
    place = inside.join(base, "block").select("shard", (F.col("base") + F.col("inside")).alias("base"))
    return index.join(place, "shard").withColumn("start", F.col("base") + F.col("first")).drop("base")


def round_trip(docs: DataFrame, base: str | None = None, **options) -> DataFrame:
    """Write, read back, index: ``doc_id, start, n_tokens, ids_crc32, shard, offset, length`` of every document."""
    spark = docs.sparkSession
    base = write(docs, base or scratch_path(spark, "tokens"), **options)
    return starts(build_index(spark, base)).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", "length")
