"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text's subwords are the byte n-grams (2 to 4) of its letters, with everything else as blanks. Since the softmax
is linear in the averaged embeddings, scoring needs only each bucket's product with the output weights: one table
look-up per n-gram. Training reads a bounded sample of labelled rows; scoring reads every whole text. A fifth of the
sample calibrates: it sharpens the probabilities, and isotonic regression of right guesses on them tells which to reject.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from idloom.llm.boosting import isotonic
from idloom.llm.common import documents, drawn, id_bucket, map_batches, prepare, training_window

BUCKET_BITS = 16
SIZES = (2, 3, 4)
#: Labelled rows of each language that training reads, at most (in expectation; never above twice as many).
ROWS_PER_LANGUAGE = 500
#: Languages that are learned, the most frequent ones: a column of dirty names has no bound.
MOST_LANGUAGES = 256
#: Scores at which a calibration row is rightly named with less than this probability are rejected.
LEAST_RIGHT = 0.5
#: Bytes of text that one numpy pass over n-grams sees.
PASS_BYTES = 1 << 18

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 256)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_GAP = b"   "  # before and after each text: no n-gram holds letters of two


def _buckets(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram at each byte; blanks alone have the bucket after the last."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    v = np.zeros(m, np.uint64)
    for i in range(n):
        v = v << np.uint64(8) | data[i : i + m]
    blank = v == np.uint64(int.from_bytes(b" " * n, "big"))
    h = ((v + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)
    return np.where(blank, 1 << BUCKET_BITS, h).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # a row of logits for each bucket, and one of zeros
    bias: np.ndarray
    sharpness: float
    least: float  # scores below are rejected

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The best language's index and its probability."""
        logits = average(texts, self.table) + self.bias
        z = logits * self.sharpness
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def average(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """The mean table row over each text's n-grams."""
    sums = np.zeros((len(texts), table.shape[1]))
    counts = np.zeros(len(texts))
    data = _FOLD[np.frombuffer(b"".join(p for t in texts for p in (_GAP, t, _GAP)), np.uint8)]
    sizes = np.fromiter((len(t) + 2 * len(_GAP) for t in texts), np.int64, len(texts))
    start = np.cumsum(sizes) - sizes
    for a in range(0, len(data), PASS_BYTES):
        b = min(a + PASS_BYTES, len(data))
        k0, k1 = int(np.searchsorted(start, a, "right")) - 1, int(np.searchsorted(start, b, "left"))
        cuts = np.maximum(start[k0:k1] - a, 0)
        for n in SIZES:
            bucket = _buckets(data[a : min(b + n - 1, len(data))], n)
            at = cuts[cuts < len(bucket)]
            if not len(at):
                continue
            k = slice(k0, k0 + len(at))
            sums[k] += np.add.reduceat(table[bucket], at, axis=0)
            counts[k] += np.add.reduceat((bucket < 1 << BUCKET_BITS).astype(np.int64), at)
    return sums / np.maximum(counts, 1)[:, None]


def train(texts: list[bytes], labels: list[str], dim: int = 16, epochs: int = 8, rate: float = 1.0, seed: int = 1) -> Model:
    """Fit on four fifths of the texts; sharpen and set the rejection score on the rest."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels], np.int64)
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1, 1, ((1 << BUCKET_BITS) + 1, dim)) / dim
    embed[-1] = 0
    out, bias = np.zeros((dim, len(languages))), np.zeros(len(languages))
    order = rng.permutation(len(texts))
    held = order[: len(texts) // 5] if len(texts) >= 10 else order[:0]
    grams = []
    for t in texts:
        data = _FOLD[np.frombuffer(_GAP + t + _GAP, np.uint8)]
        b, c = np.unique(np.concatenate([_buckets(data, n) for n in SIZES]), return_counts=True)
        real = b < 1 << BUCKET_BITS
        grams.append((b[real], c[real] / max(1, c[real].sum())))
    fit = order[len(held) :].copy()
    for e in range(epochs):
        rng.shuffle(fit)
        step = rate * (1 - e / epochs)
        for i in fit:
            b, share = grams[i]
            if not len(b):
                continue
            x = share @ embed[b]
            p = np.exp((z := x @ out + bias) - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= step * np.outer(x, p)
            bias -= step * 0.01 * p
            embed[b] -= step * 30 * share[:, None] * back
    table = (embed @ out).astype(np.float32)
    model = Model(languages, table, bias, 1.0, 0.0)
    if len(held):
        logits = average([texts[i] for i in held], table) + bias
        best = None
        for s in np.geomspace(0.25, 64, 33):
            z = logits * s - (logits * s).max(axis=1, keepdims=True)
            loss = float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(held)), y[held]]).mean() + 1e-4 * s)
            if best is None or loss < best:
                best, model.sharpness = loss, float(s)
        guess, score = model.predict([texts[i] for i in held])
        at, right = isotonic(score, (guess == y[held]).astype(float), np.ones(len(held)))
        model.least = 0.0 if right[0] >= LEAST_RIGHT else float(at[np.argmax(right >= LEAST_RIGHT)]) if right[-1] >= LEAST_RIGHT else 1.0
    return model


def training_rows(docs: DataFrame, usable: Column, rows_per_language: int = ROWS_PER_LANGUAGE) -> tuple[list[bytes], list[str]]:
    """A bounded sample of labelled rows: text (a window of long ones) and lang, the same rows for the same table."""
    named = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    picked = F.lit(False)
    for lang, n in counts.items():
        picked = F.when(F.col("lang") == lang, drawn(rows_per_language / n, F.col("doc_id").cast("string"), F.lit("language"))).otherwise(picked)
    rows = named.where(picked).select(training_window().alias("text"), "lang").limit(2 * rows_per_language * max(1, len(counts))).collect()
    rows.sort(key=lambda r: (r["lang"], r["text"]))
    return [r["text"].encode() for r in rows], [r["lang"] for r in rows]


def _named(texts: list[str | None], m: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it is rejected, of each text."""
    real = [bool(t and m) and any(map(str.isalpha, t)) for t in texts]
    best, score = m.predict([(t or "").encode() for t in texts]) if m else (np.zeros(len(texts), int), np.zeros(len(texts)))
    lang = [m.languages[b] if ok else "und" for b, ok in zip(best, real, strict=True)]
    score = np.where(real, score, 0.0)
    return lang, score, np.array([not ok for ok in real], bool) | (score < (m.least if m else 0))


def identify(docs: DataFrame, usable: Column, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """docs with lang_pred, score (probability, 0 to 1) and rejected.

    usable marks the rows whose labels training may read. A null text or one without letters is `und`, score 0,
    rejected; so is every text when there is no labelled row. A score below the calibrated one is rejected but
    keeps its language. Columns of the same names are replaced, all others stay; an empty table gives no rows. Rows
    that share a doc_id, or have none, are scored like any other.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts, labels = training_rows(docs, usable, rows_per_language)
    model = train(texts, labels) if labels else None
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    box = spark.sparkContext.broadcast(model)  # 65,537 rows of one number per language

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, rejected = _named(batch.column("text").to_pylist(), box.value)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=[*kept, "lang_pred", "score", "rejected"])

    source = docs.select(*(F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in kept))
    schema = StructType([*source.schema.fields]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return map_batches(source, fn, schema)


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of docs that identify, trained on those of them that have a lang, does not reject: all columns, whatever their names."""
    spark = docs.sparkSession
    prepare(spark)
    texts, labels = training_rows(docs.select("doc_id", "text", "lang"), F.lit(True))
    box = spark.sparkContext.broadcast(train(texts, labels) if labels else None)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        row = batch.column(0)
        _, _, rejected = _named(pc.struct_field(row, "text").cast(pa.string()).to_pylist(), box.value)
        return pa.RecordBatch.from_arrays([row.filter(pa.array(~rejected))], names=["row"])

    whole = docs.select(F.struct("*").alias("row"))  # a text goes to Python once
    return map_batches(whole, fn, whole.schema).select("row.*")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows whose id's remainder is not 2: see identify. A null doc_id has a null held_out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = identify(docs, id_bucket() != 2)
    return found.select("doc_id", (id_bucket() == 2).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op3_language_id": op3_language_id}
ORACLE_SQL: dict[str, str] = {}
