"""Token-id shards: one concatenated id array for many documents, with Elias-Fano coded boundaries.

A shard's bytes: magic, id width, number of documents without an id, least doc_id; the doc_ids less that one and
the end of each document in the id array, both as Elias-Fano sequences; then all ids, little-endian. Shards lie
in ascending doc_id order in a Parquet table (part, shard, start_in_part, n_docs, n_tokens, payload), so that any
store that Spark writes to will do and a lost task leaves no half-written file.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idloom.llm import eliasfano
from idloom.llm.common import binary_column, blocks, documents, map_arrow, prepare, scratch
from idloom.llm.eliasfano import EliasFano
from idloom.llm.tokens import TEXT_BYTES, encoder, tokenizer_path, with_end

MAGIC = b"IDEF1"
_HEAD = struct.Struct("<5sBQq")
#: Bytes of ids after which a shard is closed; a longer document is a shard of its own.
SHARD_BYTES = 1 << 20
#: Where each task's ids begin is broadcast up to this many bytes (16 for each task) and joined by a shuffle beyond.
BROADCAST_BYTES = 64 << 20
SHARD_SCHEMA = "part int, shard int, start_in_part bigint, n_docs bigint, n_tokens bigint, payload binary"


def shard_bytes(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """The bytes of a shard of documents in ascending doc_id order, those without one first."""
    named = [d for d in doc_ids if d is not None]
    least = named[0] if named else 0
    ends = np.cumsum([len(x) // width for x in ids])
    gaps = np.array(named, np.int64).view(np.uint64) - np.int64(least).view(np.uint64)  # 64 bits hold any difference
    return _HEAD.pack(MAGIC, width, len(doc_ids) - len(named), least) + eliasfano.encode(gaps) + eliasfano.encode(ends) + b"".join(ids)


class Shard:
    """Random access to a shard: document k's ids are found by two selects."""

    def __init__(self, data: bytes):
        magic, self.width, self.unnamed, self.least = _HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.names = EliasFano(data, _HEAD.size)
        self.ends = EliasFano(data, self.names.end)
        self.ids = np.frombuffer(data, "<u2" if self.width == 2 else "<u4", offset=self.ends.end)

    def __len__(self) -> int:
        return len(self.ends)

    def doc_id(self, k: int) -> int | None:
        return None if k < self.unnamed else self.least + self.names.select(k - self.unnamed)

    def document(self, k: int) -> np.ndarray:
        return self.ids[self.ends.select(k - 1) if k else 0 : self.ends.select(k)]

    def doc_ids(self) -> list[int | None]:
        named = self.names.select_many(np.arange(len(self.names)))
        return [None] * self.unnamed + (np.int64(self.least).view(np.uint64) + named).view(np.int64).tolist()


def _write(path: str, end_id: int, shard_size: int):
    def run(batches):
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        enc = encoder(path)
        width = enc.dtype.itemsize
        docs: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def close():
            nonlocal shard, start, held
            n = held // width
            row = [part, shard, start, len(docs), n, shard_bytes(docs, ids, width)]
            shard, start, held = shard + 1, start + n, 0
            docs.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names=["part", "shard", "start_in_part", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for b in blocks(batch, TEXT_BYTES):
                flat, ends = with_end(*enc.arrays(b.column(1)), end_id)
                raw, cuts = flat.tobytes(), (ends * width).tolist()
                for doc, x, y in zip(b.column(0).to_pylist(), [0, *cuts], cuts, strict=False):
                    if held and held + y - x > shard_size:
                        yield close()
                    docs.append(doc)
                    ids.append(raw[x:y])
                    held += y - x
        if docs:
            yield close()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_size: int = SHARD_BYTES) -> None:
    """Encode every whole text (null: empty), append end_id and write shards in ascending doc_id order.

    Rows without a doc_id come first; rows that share one stand side by side, ordered by text. Extra columns are
    ignored; an empty table gives no shards.
    """
    prepare(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = text.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(ordered, _write(tokenizer, end_id, shard_size), SHARD_SCHEMA, "tokens").write.parquet(path)


def _read(batches):
    for batch in batches:
        for start, data in zip(batch.column("start").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            s = Shard(data)
            ends = s.ends.select_many(np.arange(len(s))).astype(np.int64)
            sizes = np.diff(ends, prepend=0)
            cols = [pa.array(s.doc_ids(), pa.int64()), pa.array(ends - sizes + start), pa.array(sizes), binary_column(s.ids.astype("<u4"), sizes)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the shards: doc_id, start (ids before it), n_tokens, ids (little-endian 32-bit).

    Each document's place in its shard comes from select on the coded boundaries.
    """
    prepare(spark)
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # One row for each task that wrote; what earlier tasks wrote is summed in one small window and joined back.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    first = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    last = shards.agg(F.max("part")).first()[0]
    if last is not None and (last + 1) * 16 <= BROADCAST_BYTES:
        first = F.broadcast(first)
    placed = shards.join(first, "part").select((F.col("first") + F.col("start_in_part")).alias("start"), "payload")
    return map_arrow(placed, _read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to token files and read back from them: see write_token_files and read_token_files."""
    path = scratch(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op8_token_files": op8_token_files}
ORACLE_SQL: dict[str, str] = {}
