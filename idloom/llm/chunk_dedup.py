"""Repeated substrings by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last NARROW bytes is the largest within REACH bytes on both sides (never before
LEAST bytes, always after MOST), so an insertion moves only the boundaries near it, and two copies of a passage fall into
step at once: but for ties, a boundary hangs on the NARROW + REACH bytes before and the REACH bytes after it alone. Chunks are told apart by a 128-bit digest; of
each distinct chunk the document with the least doc_id keeps its copy (and within a document the first place). Runs of
later copies of at least min_words words are what deduplication cuts.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from idloom.llm.common import SPACE, documents, map_batches, prepare, raw_texts, saved

LEAST, REACH, MOST = 24, 24, 512
_WINDOW, NARROW = 32, 16
#: Words in a run of repeated chunks from which it is cut. A repeated passage keeps its ends, up to the first and after the
#: last boundary that hangs on its own bytes only, so this is far below the length of passages to be caught.
MIN_WORDS = 12


def _gear_table() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    table = (x >> np.uint64(32)).astype(np.uint32)
    table[0] = 0  # the filler between texts adds nothing to a hash
    return table


GEAR = _gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte, h = 2 * h + GEAR[byte] modulo 2 ** 32, by doubling the window five times."""
    h = GEAR[data]
    step = 1
    while step < _WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def peaks(data: np.ndarray) -> np.ndarray:
    """The places whose hash of NARROW bytes (the low bits of the gear hash) is the largest, or ties, within REACH bytes."""
    h = np.zeros(len(data) + 2 * REACH, np.uint16)
    h[REACH : REACH + len(data)] = gear_hashes(data) & np.uint32((1 << NARROW) - 1)
    top, width, span = h, 1, 2 * REACH + 1
    while 2 * width <= span:
        top = np.maximum(top[:-width], top[width:])
        width *= 2
    top = np.maximum(top[: len(data)], top[span - width : span - width + len(data)])
    return np.flatnonzero(h[REACH : REACH + len(data)] == top)


def boundaries(texts: list[bytes]) -> list[list[int]]:
    """The ends of each text's chunks; no character of UTF-8 is cut."""
    gap = _WINDOW + REACH
    fill = b"\0" * gap
    data = np.frombuffer(fill.join(texts) + fill, np.uint8)
    found = peaks(data) + 1
    for _ in range(3):  # a cut moves on to the start of a character
        found = found + (data[np.minimum(found, len(data) - 1)] & 0xC0 == 0x80)
    out, start = [], 0

    def most(text: bytes, last: int) -> int:
        at = last + MOST
        while text[at] & 0xC0 == 0x80 and at > last + MOST - 3:
            at -= 1
        return at

    for t in texts:
        n, ends, last = len(t), [], 0
        lo, hi = np.searchsorted(found, [start + 1, start + n + 1])
        for c in (found[lo:hi] - start).tolist():
            while c - last > MOST:
                last = most(t, last)
                ends.append(last)
            if c - last >= LEAST and c < n:
                ends.append(c)
                last = c
        while n - last > MOST:
            last = most(t, last)
            ends.append(last)
        if n > last:
            ends.append(n)
        out.append(ends)
        start += n + gap
    return out


def _chunk(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = raw_texts(batch.column(1))
    digests, sizes = bytearray(), []
    chunk_no, starts, ends, words = (array("q") for _ in range(4))
    first_here = bytearray()
    for text, cuts in zip(texts, boundaries(texts), strict=True):
        gap = SPACE[np.frombuffer(text, np.uint8)]
        begins = np.concatenate(([0], np.cumsum(~gap & np.concatenate(([True], gap[:-1]))))) if len(text) else np.zeros(1, np.int64)
        seen: set[bytes] = set()
        n, a = begins[cuts].tolist() if cuts else [], 0
        before = 0
        for i, b in enumerate(cuts):
            d = hashlib.blake2b(text[a:b], digest_size=16).digest()
            digests += d
            first_here.append(d not in seen)
            seen.add(d)
            starts.append(a)
            ends.append(b)
            words.append(n[i] - before)
            chunk_no.append(i)
            before, a = n[i], b
        sizes.append(len(cuts))
    d = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
    values = [np.frombuffer(c, np.int64) for c in (chunk_no, starts, ends, words)]
    ids = [pa.array(np.repeat(batch.column(c).to_numpy(), sizes)) for c in (0, 2)]
    arrays = [*ids, *(pa.array(v.astype(np.int32)) for v in values), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(np.frombuffer(bytes(first_here), np.uint8).astype(bool))]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "chunk", "start", "end", "words", "d1", "d2", "first_here"])


CHUNKS = "doc_id bigint, text_key bigint, chunk int, start int, end int, words int, d1 bigint, d2 bigint, first_here boolean"


def chunk_table(docs: DataFrame) -> DataFrame:
    """The chunks of all texts: doc_id, text_key (a hash of the text), chunk, start, end (bytes), words, digest (d1, d2), first_here."""
    prepare(docs.sparkSession)
    text = docs.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(text.withColumn("text_key", F.xxhash64("text")), _chunk, CHUNKS)


def _runs(min_words: int):
    kept = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_spans", pa.int64()), ("cut_bytes", pa.int64()), ("cut_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("source_ids", pa.list_(pa.int64()))])

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, key, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            spans, sources, words, run, inside = [], set(), 0, 0, set()

            def close(spans=spans, sources=sources) -> int:
                nonlocal run
                got = run if run >= min_words else 0
                if spans and not got:
                    spans.pop()
                elif got:
                    sources |= inside
                run = 0
                inside.clear()
                return got

            last = None
            for c in found:
                if last is None or c["chunk"] != last + 1:
                    if last is not None:
                        words += close()
                    spans.append({"start": c["start"], "end": c["end"]})
                spans[-1]["end"] = c["end"]
                run += c["words"]
                inside.add(c["source"])
                last = c["chunk"]
            if last is not None:
                words += close()
            if spans:
                rows.append({"doc_id": doc, "text_key": key, "n_spans": len(spans), "cut_bytes": sum(s["end"] - s["start"] for s in spans), "cut_words": words, "spans": spans, "source_ids": sorted(sources)})
        return pa.RecordBatch.from_pylist(rows, schema=kept)

    return fn


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per text that loses a part: doc_id, text_key, n_spans, cut_bytes, cut_words, spans, source_ids.

    spans are byte ranges (UTF-8) of runs of chunks that a document with a smaller doc_id (named in source_ids)
    or an earlier place in the same text also holds; chunks are equal if their 128-bit digests are. Null doc_ids and
    empty texts are left out; rows that share a doc_id are texts of one document, told apart by text_key, none of which
    is cut on account of another; equal rows give one. Extra columns are ignored; an empty table gives no rows.
    """
    chunks = saved(chunk_table(docs), "chunks")
    # Least and greatest document of each digest, combined before the shuffle: no group meets in one task.
    shared = chunks.groupBy("d1", "d2").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.min("first_here").alias("once"))
    # They are written before the join, so that Spark can split the places of a hot chunk among tasks.
    shared = saved(shared.where("source < last or not once").drop("last", "once"), "shared")
    again = chunks.join(shared, ["d1", "d2"]).where("doc_id > source or not first_here")
    by_doc = again.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("chunk", "start", "end", "words", "source"))).alias("found"))
    return map_batches(by_doc, _runs(min_words), "doc_id bigint, text_key bigint, n_spans bigint, cut_bytes bigint, cut_words bigint, spans array<struct<start:bigint,end:bigint>>, source_ids array<bigint>")


def cut_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the byte ranges of spans (as from repeated_spans of the same docs) taken out of text.

    Rows without spans, with a null doc_id or a null or empty text stay as they are, as do all other columns, whatever
    their names. An empty table gives no rows.
    """
    prepare(docs.sparkSession)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for t, cut in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if t and cut:
                raw, at, parts = t.encode(), 0, []
                for s in cut:
                    parts.append(raw[at : s["start"]])
                    at = s["end"]
                t = b"".join([*parts, raw[at:]]).decode("utf-8", "ignore")
            texts.append(t)
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    joined = keyed.join(spans.select("doc_id", "text_key", "spans"), ["doc_id", "text_key"], "left").select("row", "text", "spans")
    out = map_batches(joined, fn, StructType([joined.schema["row"], joined.schema["text"]]))
    return out.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that another one has too: see repeated_spans."""
    return repeated_spans(documents(spark, sf_dir))


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
