"""Best-two-fit packing of tokenised documents into sequences of a fixed size.

Sizes are whole numbers up to the size of a sequence, so the packing is planned on the histogram of piece
sizes, which has at most that many entries at any scale: bins are filled greedily, largest piece first; then a
bin's smallest piece gives way to two unpacked pieces that fit its gap more tightly. A bin found once is used as
often as the histogram allows. Pieces take their places in the plan by their rank among pieces of their size.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idloom.llm.common import binary_column, blocks, documents, map_arrow, prepare, scratch
from idloom.llm.tokens import CACHE_BYTES, TEXT_BYTES, encoder, tokenizer_path, with_end

#: Rank offsets are broadcast up to this many bytes (16 for each task and size) and joined by a shuffle beyond.
BROADCAST_BYTES = 64 << 20


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(times, sizes in one bin) for all pieces of a histogram {size: count}, largest first within a bin."""
    left = {s: n for s, n in histogram.items() if n > 0}
    have = sorted(left)
    bins = []
    while have:
        used: dict[int, int] = {}
        gap = size
        free = lambda s: left.get(s, 0) - used.get(s, 0)

        def largest(most: int) -> int:
            i = bisect_right(have, most)
            while i and free(have[i - 1]) <= 0:
                i -= 1
            return have[i - 1] if i else 0

        while gap and (s := largest(gap)):
            n = min(gap // s, free(s))
            used[s] = used.get(s, 0) + n
            gap -= n * s
        while gap:
            small = min(used)
            best, pair = small, None
            for a in have[bisect_right(have, (gap + small - 1) // 2) :][::-1] if have else []:
                if a >= gap + small or free(a) <= 0 or a == small and free(a) < 1:
                    continue
                room = gap + small - a
                i = bisect_right(have, min(room, a))
                while i and free(have[i - 1]) < (2 if have[i - 1] == a else 1):
                    i -= 1
                if i and a + have[i - 1] > best:
                    best, pair = a + have[i - 1], (a, have[i - 1])
                    if best == gap + small:
                        break
            if not pair:
                break
            used[small] -= 1
            if not used[small]:
                del used[small]
            for s in pair:
                used[s] = used.get(s, 0) + 1
            gap += small - best
        times = min(left[s] // n for s, n in used.items())
        bins.append((times, [s for s in sorted(used, reverse=True) for _ in range(used[s])]))
        for s, n in used.items():
            left[s] -= times * n
            if not left[s]:
                del left[s]
                have.pop(bisect_right(have, s) - 1)
    return bins


def _slots(bins: list[tuple[int, list[int]]], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each piece size: first rank, first sequence and offset of each run of places, by rank."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for times, sizes in bins:
        at = 0
        for s in sizes:
            runs.setdefault(s, []).append((taken.get(s, 0), first, at))
            taken[s] = taken.get(s, 0) + times
            at += s
        first += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in runs.items()}


_PIECE = ("doc_id", "piece", "start", "length", "ids", "part", "rank")


def _pieces(path: str, end_id: int, size: int, cache: int):
    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        enc = encoder(path, cache)
        for batch in batches:
            for b in blocks(batch, TEXT_BYTES):
                ids, ends = with_end(*enc.arrays(b.column(1)), end_id)
                n = np.diff(ends, prepend=0)
                count = (n + size - 1) // size
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
                head = ((n - 1) % size + 1)[doc]
                length = np.where(piece == 0, head, size)
                order = np.argsort(length, kind="stable")  # rank among the task's pieces of that length
                kinds, at, many = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.repeat(at, many) + np.repeat(seen[kinds], many)
                seen[kinds] += many
                cols = [b.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(np.where(piece == 0, 0, head + (piece - 1) * size)), pa.array(length), binary_column(ids, length), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(cols, names=list(_PIECE))

    return run


def _place(slots: dict[int, tuple[np.ndarray, ...]], width: int):
    def run(batches):
        for batch in batches:
            for b in blocks(batch, TEXT_BYTES):
                length = b.column("length").to_numpy()
                rank = b.column("rank").to_numpy() + b.column("before").to_numpy()
                seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
                for s in np.unique(length):
                    at = np.flatnonzero(length == s)
                    lo, first, offset = slots[int(s)]
                    k = np.searchsorted(lo, rank[at], "right") - 1
                    seq[at], off[at] = first[k] + rank[at] - lo[k], offset[k]
                ids = np.frombuffer(b"".join(b.column("ids").to_pylist()), "<u2" if width == 2 else "<u4").astype("<u4")
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _PIECE[:4]), binary_column(ids, length), pa.array(seq), pa.array(off)], names=[*_PIECE[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 1024, cache: int = CACHE_BYTES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian 32-bit), sequence_id, offset.

    A null or empty text is the end id alone. Documents longer than size are cut into pieces of that size, the
    first of which may be shorter; nothing else is cut or dropped. Rows that share a doc_id, or have none, are
    packed like any other; extra columns are ignored. Within a sequence the offsets have no gap. An empty table gives no rows.
    cache bounds the ids of words that a worker keeps, in bytes (twice).
    """
    spark = docs.sparkSession
    prepare(spark)
    width = 2 if encoder(tokenizer).code == "H" else 4
    path = scratch(spark, "pieces")
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids binary, part int, rank bigint"
    map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _pieces(tokenizer, end_id, size, cache), schema, "tokens").write.option("compression", "zstd").parquet(path)
    pieces = spark.read.schema(schema).parquet(path)
    counts = pieces.groupBy("length", "part").count()
    total = counts.groupBy("length").agg(F.sum("count").alias("n"))
    slots = _slots(plan({r["length"]: r["n"] for r in total.collect()}, size), size)  # at most `size` rows
    # For each task and size, the pieces of that size in earlier tasks: one row for each task in a window.
    before = counts.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    tasks = pieces.agg(F.max("part")).first()[0]
    if tasks is not None and (tasks + 1) * size * 16 <= BROADCAST_BYTES:
        before = F.broadcast(before)
    placed = pieces.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids", "rank", "before")
    return map_arrow(placed, _place(slots, width), "doc_id bigint, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 ids: see pack."""
    packed = pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
