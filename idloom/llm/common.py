"""Helpers shared by the text operators: scratch tables, Arrow batches and vectorised word hashing."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from idloom.session import prepare  # noqa: F401  (the operators take it from here)

#: While an operator writes its scratch tables, Spark deletes the shuffle files of each query as it ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a scratch table that a task writes at least, where their number is bounded beforehand.
TASK_ROWS = 20_000
#: Rows of Arrow batches are regrouped so that one numpy pass sees about this much text.
BLOCK_BYTES = 1 << 20


def _shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="spark-")  # a single machine, as in tests
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: The tables to delete when the innermost clearing() of this thread ends.
_clearing: ContextVar[list[str] | None] = ContextVar("clearing", default=None)
#: How many clearing() blocks a session is in, over all threads, and what it had for _TIDY before them.
_tidying: Counter[str] = Counter()
_tidy_before: dict[str, str | None] = {}
_tidy_lock = threading.Lock()


def saved(df: DataFrame, name: str, keep: bool = False, compression: str = "snappy", most: int | None = None) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut and no step runs twice.

    Inside clearing() the table goes at the end, unless it is kept. most: df has no more rows than that, so few rows
    are written by as many tasks as there are cores and not by one for each shuffle partition. A local file system without Hadoop's native
    library starts several processes for each file.
    """
    path = scratch(df.sparkSession, name)
    if most is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-most // TASK_ROWS)))
    df.write.option("compression", compression).parquet(path)
    paths = _clearing.get()
    if paths is not None and not keep:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables, wherever Hadoop finds them."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Delete the scratch tables that df reads, once its rows are written elsewhere: it cannot be read any more."""
    bare = lambda p: re.sub("^[a-z]+:/*", "/", p)
    table = re.compile(rf"{re.escape(bare(_shared_folder(df.sparkSession)))}/[a-z_-]+-[0-9a-f]{{32}}(?=/)")
    discard(df.sparkSession, *sorted({m[0] for f in df.inputFiles() if (m := table.match(bare(f)))}))


@contextmanager
def clearing(spark: SparkSession) -> Iterator[None]:
    """Tables that saved() writes inside, in this thread, are deleted at the end; what is returned must hang on kept ones only.

    Shuffle files go as soon as the query that made them has ended, so disk follows the largest step and not their sum.
    """
    paths: list[str] = []
    token, key = _clearing.set(paths), spark._jsparkSession.sessionUUID()
    with _tidy_lock:
        if not _tidying[key]:
            _tidy_before[key] = spark.conf.get(_TIDY, None)
            spark.conf.set(_TIDY, "true")
        _tidying[key] += 1
    try:
        yield
    finally:
        _clearing.reset(token)
        with _tidy_lock:
            _tidying[key] -= 1
            if not _tidying[key]:
                before = _tidy_before.pop(key)
                spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)
        discard(spark, *paths)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_bucket(col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4: 2 marks held-out rows; null without an id, whose rows neither train nor are held out."""
    return F.crc32(F.col(col).cast("string")) % 4


#: Of a longer text, training reads a window of this many characters, at a place drawn by hash. Scoring reads all of it.
TRAIN_CHARS = 20_000
_DRAWS = 1 << 62


def drawn(share: float, *key: Column | str) -> Column:
    """Whether a row is in a sample of about that share, drawn by a 62-bit hash of its key."""
    return F.pmod(F.xxhash64(*key), F.lit(_DRAWS)) < F.lit(draws(share))


def draws(share: float) -> int:
    return int(min(1.0, share) * _DRAWS)


def training_window(most: int = TRAIN_CHARS) -> Column:
    """text, or a window of it."""
    spare = F.greatest(F.length("text") - most, F.lit(0))
    return F.substr("text", (F.pmod(F.xxhash64("text"), spare + 1) + 1).cast("int"), F.lit(most))


#: What tasks of each kind keep in their worker.
_kept: dict[str, dict] = {}


def kept(kind: str) -> dict:
    """A dictionary for what tasks of one kind keep in their worker until a task of another kind begins there."""
    return _kept.setdefault(kind, {})


def _begin(kind: str) -> None:
    for other, things in _kept.items():
        if other != kind:
            things.clear()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, kind: str = "hashes") -> DataFrame:
    """df.mapInArrow, after which a worker gives back the memory that Arrow keeps for later batches, and before which
    it gives up what tasks of another kind have kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(kind)
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str | StructType, most: int = BLOCK_BYTES) -> DataFrame:
    """Apply fn to Arrow batches of df, each cut to about `most` bytes of string and binary data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, most):
                out = fn(part)
                if out is not None:
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return map_arrow(df, run, schema)


def binary_column(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of runs of values, sizes[k] of them in row k."""
    ends = np.concatenate(([0], np.cumsum(sizes))) * values.itemsize
    kind, width = (pa.binary(), np.int32) if ends[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(ends.astype(width)), pa.py_buffer(np.ascontiguousarray(values))])


def blocks(batch: pa.RecordBatch, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    sizes = np.ones(batch.num_rows, np.int64)
    for c in [x for c in batch.columns for x in (c.flatten() if pa.types.is_struct(c.type) else [c])]:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def raw_texts(col: pa.Array, lower: bool = False) -> list[bytes]:
    """UTF-8 bytes of each value, null as empty; lower changes A-Z only."""
    if lower:
        col = pc.ascii_lower(col)
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


# Multipliers of the word hash: odd 64-bit numbers without further meaning.
_BASE = 0x9E6C63D0876A9A47
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = kept("hashes")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


class Words:
    """The words of some texts: hash, first byte and length of each, and each text's range of words."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        gap = SPACE[self.data]
        turns = np.flatnonzero(np.diff(gap, prepend=True))
        self.start, self.end = turns[0::2], turns[1::2]
        self.text_end = ends
        self.first = np.searchsorted(self.start, np.concatenate(([0], ends)))
        self.hash = self._hashes()

    def _hashes(self, step: int = BLOCK_BYTES) -> np.ndarray:
        """Polynomial hash of each word by prefix sums, over blocks of whole words."""
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):
            lo = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, lo + step, "right")))
            hi = self.end[j - 1]
            up, down = _power_tables(int(hi - lo) + 1)
            sums = np.zeros(int(hi - lo) + 1, np.uint64)
            np.cumsum((self.data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
            s, e = self.start[i:j] - lo, self.end[i:j] - lo
            out[i:j] = mix((sums[e] - sums[s]) * down[s])
            i = j
        return out

    def range(self, k: int) -> slice:
        return slice(int(self.first[k]), int(self.first[k + 1]))


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of each two neighbouring words."""
    return mix(words[:-1] * _GOLD + (words[1:] ^ (words[1:] >> np.uint64(29))) * _M2)
