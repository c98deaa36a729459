"""First-fit decreasing packing with a tournament tree, in randomised groups of documents.

A document's ids are first cut into whole sequences; what is left of each, less than a sequence, goes to a group
drawn by a hash of the row. Each group is packed by itself: its rests, largest first, go to the first bin that has
room, which a tournament tree over the bins' free places finds in as many steps as the tree has levels. Then the
least full bins are taken apart and cut to fill the gaps of the others, so that one bin a group is not full. That
one is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.llm.common import binary_column, blocks, clearing, documents, map_arrow, prepare, saved
from idloom.llm.tokens import TEXT_BYTES, encoder, gather, tokenizer_path, with_end

#: Documents in a group, on the average: with sequences of 2048 ids of 2 bytes at most 8 MB of ids.
GROUP = 2048
_ROW_BITS, _BIN_BITS = 40, 20


class TournamentTree:
    """Free places of bins: each inner node holds the larger of its two children's."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def first(self, size: int) -> int:
        """The first bin with that much room; there must be one."""
        at, room, leaves = 1, self.room, self.leaves
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        return at - leaves

    def take(self, bin_: int, size: int) -> None:
        at, room = bin_ + self.leaves, self.room
        room[at] = most = room[at] - size
        while at > 1:
            other = room[at ^ 1]
            at //= 2
            most = max(most, other)
            if room[at] == most:
                break
            room[at] = most


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """The items of each bin, by index into sizes, which must fall and fit a bin."""
    tree, bins = TournamentTree(len(sizes), capacity), []
    for i, size in enumerate(sizes):
        b = tree.first(size)
        tree.take(b, size)
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def close_gaps(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, from, to) without padding: the least full bins fill the gaps of the others, the rest ends at powers of two."""
    used = [sum(sizes[i] for i in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: -used[b])
    full, rest = divmod(sum(used), capacity)
    out = [[(i, 0, sizes[i]) for i in bins[b]] for b in order[:full]]
    gaps = [(k, capacity - used[b]) for k, b in enumerate(order[:full])]
    out += [[] for k in range(capacity.bit_length()) if rest >> k & 1]
    gaps += zip(range(full, len(out)), [1 << k for k in reversed(range(capacity.bit_length())) if rest >> k & 1], strict=True)
    open_ = iter((k, g) for k, g in gaps if g)
    k, gap = next(open_, (0, 0))
    for i in (i for b in order[full:] for i in bins[b]):
        at = 0
        while at < sizes[i]:
            n = min(gap, sizes[i] - at)
            out[k].append((i, at, at + n))
            at, gap = at + n, gap - n
            if not gap:
                k, gap = next(open_, (0, 0))
    return out


def _cut(path: str, end_id: int, size: int):
    """Whole sequences and rests of each document; uid numbers the rows of the table."""

    def run(batches):
        uid = TaskContext.get().partitionId() << _ROW_BITS
        enc = encoder(path)
        for batch in batches:
            for b in blocks(batch, TEXT_BYTES):
                ids, ends = with_end(*enc.arrays(b.column(1)), end_id)
                n = np.diff(ends, prepend=0)
                count = (n + size - 1) // size
                doc = np.repeat(np.arange(len(n)), count)
                start = (np.arange(len(doc)) - (np.cumsum(count) - count)[doc]) * size
                length = np.minimum(size, n[doc] - start)
                uids = uid + np.arange(len(doc))
                uid += len(doc)
                yield pa.RecordBatch.from_arrays([pa.array(uids), b.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), binary_column(ids, length), pa.array(n[doc])], names=["uid", "doc_id", "start", "length", "ids", "doc_tokens"])

    return run


_OUT = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def _pack_group(width: str, size: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        length, uid = group["length"].to_numpy(), group["uid"].to_numpy()
        order = np.lexsort((uid, -length))
        sizes = length[order].tolist()
        pieces = [(s, *p) for s, seq in enumerate(close_gaps(sizes, first_fit_decreasing(sizes, size), size)) for p in seq]
        seq, item, lo, hi = np.array(pieces, np.int64).T
        rows, n = order[item], hi - lo
        before = np.cumsum(n) - n
        offset = before - before[np.searchsorted(seq, seq)]
        ids = np.frombuffer(b"".join(group["ids"].to_pylist()), width)
        ids = gather(ids, (np.cumsum(length) - length)[rows] + lo, n).astype("<u4")
        number = -1 - ((key[0].as_py() << _BIN_BITS) + seq)
        at = pa.array(rows)
        return pa.Table.from_arrays([group["doc_id"].take(at), pa.array(group["start"].to_numpy()[rows] + lo), pa.array(n), binary_column(ids, n), group["doc_tokens"].take(at), pa.array(number), pa.array(offset)], names=_OUT)

    return run


def _whole(width: str):
    """A whole sequence is numbered by its row."""

    def run(batches):
        for b in batches:
            length = b.column("length").to_numpy()
            ids = np.frombuffer(b"".join(b.column("ids").to_pylist()), width).astype("<u4")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "length")), binary_column(ids, length), b.column("doc_tokens"), b.column("uid"), pa.array(np.zeros(len(length), np.int64))], names=_OUT)

    return run


def pack_first_fit(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Every id is in exactly one piece; sequences hold `size` ids but for the
    last ones of a group, whose sizes are different powers of two (size must be one too). Rows that share a doc_id, or have
    none, are packed like any other, and equal rows go to groups of their own; extra columns are ignored. An empty table gives no rows.

    Groups are drawn by a hash of the row's number, so no key can make one large.
    """
    spark = docs.sparkSession
    prepare(spark)
    width = "<u2" if encoder(tokenizer).code == "H" else "<u4"
    types = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint"
    with clearing(spark):
        cut = map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _cut(tokenizer, end_id, size), f"uid bigint, {types}", "tokens")
        cut = saved(cut, "cut", keep=True, compression="zstd")
    rests = cut.where(F.col("length") < size)
    groups = max(1, -(-rests.count() // group))
    types = f"{types}, sequence_id bigint, offset bigint"
    packed = rests.groupBy(F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("g")).applyInArrow(_pack_group(width, size), types)
    return packed.union(map_arrow(cut.where(F.col("length") == size), _whole(width), types))


def op11_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids: see pack_first_fit. ids_crc32 is taken of a piece's ids as 32-bit numbers."""
    packed = pack_first_fit(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op11_first_fit_packing": op11_first_fit_packing}
ORACLE_SQL: dict[str, str] = {}
