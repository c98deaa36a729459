"""Exact deduplication by a stateful stream.

The stream reads documents file by file and keeps, in a disk-backed state store without expiry, one entry
per digest of the normalised text (A-Z lower-cased, null as empty): the stable identifier of the copy that
stays, its content locator (file and row in it) and the number of copies. A digest seen again, in this batch or
an earlier one, is a hit; the full bytes of all hits are compared before a copy is called a copy.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.llm.common import clearing, discard, documents, map_batches, prepare, raw_texts, saved, scratch

#: The state store keeps its entries on disk; many small stores do without reserved space and whole snapshots.
_STORE = "spark.sql.streaming.stateStore"
STORE_CONF = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
}
#: What one micro-batch of the stream reads; a file larger than that is a batch of its own.
BATCH_BYTES = 4 << 30
#: Digests of repeated texts are broadcast up to this many bytes, so that no other body is shuffled; beyond, all bodies are.
BROADCAST_BYTES = 64 << 20
_ROW = "doc_id bigint, file string, row bigint, digest binary"


def _digests(with_text: bool):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        low = raw_texts(batch.column("text"), lower=True)
        cols = {n: batch.column(n) for n in batch.schema.names if n != "text"}
        cols["digest"] = pa.array([hashlib.sha256(t).digest() for t in low], pa.binary())
        if with_text:
            cols["body"] = pa.array(low, pa.binary())
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return fn


def _locator(table: DataFrame, path: str) -> tuple[Column, Column]:
    """The file, as its path below the table's folder, and the row in it."""
    meta = table.metadataColumn("_metadata")
    name = path.rstrip("/").rpartition("/")[2]
    return F.regexp_replace(meta["file_path"], f"^.*?/{re.escape(name)}/", ""), meta["row_index"]


def _located(table: DataFrame, path: str) -> DataFrame:
    """doc_id, text and the locator of each row of a Parquet table."""
    file, row = _locator(table, path)
    return table.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), file.alias("file"), row.alias("row"))


def stream_state(stream: DataFrame, checkpoint: str) -> DataFrame:
    """Run a located stream to its end; the state it leaves, one row per digest: digest, keep, copies.

    The state stays in the checkpoint: a later run over the same folder goes on with it, reading new files only.
    """
    spark = stream.sparkSession
    state = map_batches(stream, _digests(False), _ROW).groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("copies"))
    before = {k: spark.conf.get(k, None) for k in STORE_CONF}
    for k, v in STORE_CONF.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        found = spark.read.format("statestore").load(checkpoint)
        keep, copies = [f for f in found.schema["value"].dataType.names]
        return saved(found.select(F.col("key.digest").alias("digest"), F.col(f"value.{keep}").alias("keep"), F.col(f"value.{copies}").alias("copies")), "state")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _outdated(rows: DataFrame, state: DataFrame) -> bool:
    """Whether the state counts rows that are not there any more: files have gone or were changed."""
    weight = F.xxhash64("digest").cast("decimal(38,0)")
    there = rows.agg(F.count("*").alias("n"), F.sum(weight).alias("sum")).first()
    counted = state.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n"), F.sum(weight * F.col("copies")).alias("sum"), F.count("*").alias("keepers")).first()
    if (there["n"], there["sum"]) != (counted["n"], counted["sum"]):
        return True
    keepers = rows.join(state.select("digest", "keep"), "digest").where(F.col("keep").eqNullSafe(F.struct("doc_id", "file", "row")))
    return keepers.count() != counted["keepers"]


def _decisions(spark: SparkSession, path: str, bytes_per_batch: int, checkpoint: str | None) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(path)
    files = docs.inputFiles()
    single = len(files) == 1 and files[0].rstrip("/").endswith("/" + path.rstrip("/").rpartition("/")[2])
    # A stream takes a folder or a pattern: the path of one file becomes a pattern that only it fits.
    source = f"{path[:-1]}[{path[-1]}]" if single else path
    stream = spark.readStream.schema(docs.schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(source)
    kept = checkpoint or scratch(spark, "exact-dedup")
    state = stream_state(_located(stream, path), kept)
    if not checkpoint:
        discard(spark, kept)
    rows = map_batches(_located(docs, path), _digests(False), _ROW)
    if checkpoint and _outdated(rows, state):
        state = saved(rows.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("copies")), "state")
    shape = ["file", "row", "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("copies").alias("group_size")]
    mine = F.struct("doc_id", "file", "row")
    shape += [F.col("keep").eqNullSafe(mine).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]

    bodies = map_batches(_located(docs, path), _digests(True), f"{_ROW}, body binary")
    hits = state.where("copies > 1").select("digest")
    n = hits.count()
    if n * 40 <= BROADCAST_BYTES:
        checked = bodies.join(F.broadcast(hits), "digest", "left_semi")
    else:
        checked = bodies
    # The least and the greatest body of a digest are equal only if all are; each task first reduces its own rows.
    clash = checked.groupBy("digest").agg(F.min("body").alias("lo"), F.max("body").alias("hi")).where("lo <> hi").select("digest")
    out = rows.join(state, "digest", "left")
    if not n or (clash := saved(clash, "clashes")).isEmpty():
        return out.select(shape)
    apart = saved(bodies.join(clash, "digest", "left_semi"), "apart")
    groups = apart.groupBy("digest", "body").agg(F.max(mine).alias("keep"), F.count("*").alias("copies"))
    return out.join(clash, "digest", "left_anti").select(shape).union(apart.join(groups, ["digest", "body"]).select(shape))


def exact_duplicates(spark: SparkSession, path: str, bytes_per_batch: int = BATCH_BYTES, checkpoint: str | None = None) -> DataFrame:
    """One row per row of the Parquet documents at path: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays (of rows that share it, the last file's last row; a
    null doc_id is the smallest). Null and empty texts are equal. Texts of one digest that differ in their
    bytes are separated again. Extra columns are ignored; an empty table gives no rows. bytes_per_batch is
    what one micro-batch reads. checkpoint keeps the state: a later call for the same path and checkpoint reads
    only files that are new there into the state and decides on all rows. Rows of files that have gone, or were changed, since
    do not count: if the state holds any, the rows that are there are grouped anew, in this call and later ones, until a new
    checkpoint is begun.
    """
    return _decisions(spark, path, bytes_per_batch, checkpoint).drop("file", "row")


def _source(docs: DataFrame) -> str | None:
    """The path of the Parquet table that docs is, if it is one as read, without partition columns or any further step."""
    plan = docs._jdf.queryExecution().analyzed()
    relation = plan.relation() if plan.getClass().getSimpleName() == "LogicalRelation" else None
    if relation is None or relation.getClass().getSimpleName() != "HadoopFsRelation":
        return None
    roots, format_name = relation.location().rootPaths(), relation.fileFormat().getClass().getSimpleName()
    plain = roots.size() == 1 and format_name == "ParquetFileFormat" and relation.partitionSchema().isEmpty()
    path = roots.head().toString() if plain else ""
    return path if path and not set(path) & set("*?[]{}") else None


def drop_exact_duplicates(docs: DataFrame, bytes_per_batch: int = BATCH_BYTES) -> DataFrame:
    """docs without the rows whose text another row keeps (see exact_duplicates); all columns stay as they are, whatever
    their names. Null and empty texts are equal, of equal rows the last one stays, and an empty table gives no rows. A Parquet table as read is located where it lies; anything else is written to the shared folder first."""
    spark = docs.sparkSession
    with clearing(spark):
        path = _source(docs)
        if path is None:
            path = scratch(spark, "docs")
            docs.write.option("compression", "zstd").parquet(path)
        again = spark.read.schema(docs.schema).parquet(path)
        gone = saved(_decisions(spark, path, bytes_per_batch, None).where("not kept").select("file", "row"), "gone", keep=True)
    file, row = _locator(again, path)
    every = again.select(F.struct("*").alias("all"), file.alias("file"), row.alias("row"))
    return every.join(gone, ["file", "row"], "left_anti").select("all.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document of equal texts stays, for every document: see exact_duplicates."""
    return exact_duplicates(spark, f"{sf_dir}/documents.parquet")


QUERIES = {"op1_exact_dedup": op1_exact_dedup}

ORACLE_SQL = {
    "op1_exact_dedup": """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
""",
}
