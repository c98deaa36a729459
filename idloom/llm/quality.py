"""Quality rules as weak supervision: rules vote or abstain, and a posterior probability decides.

The counts are exact; the votes' reliabilities come from expectation-maximisation over the counts of vote
patterns of the whole corpus (at most 3 ** rules of them), not from labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.llm import weak
from idloom.llm.common import _GOLD, _M2, SPACE, Words, documents, map_batches, mix, prepare, raw_texts, saved

SYMBOLS = b"#*$%&|<>"
_LONG = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_bangs")
_KIND = np.zeros((256, 4), np.int32)
_KIND[ord("A") : ord("Z") + 1, 0] = 1
_KIND[ord("A") : ord("Z") + 1, 1] = 1
_KIND[ord("a") : ord("z") + 1, 1] = 1
_KIND[:0x80, 2] = ~SPACE[:0x80] & (_KIND[:0x80, 1] == 0)
_KIND[ord("0") : ord("9") + 1, 2] = 0
_KIND[[ord("!"), ord("?")], 3] = 1


def _repeat_words(h: np.ndarray) -> int:
    """Words in windows of three words that occur twice or more."""
    if len(h) < 4:
        return 0
    w = mix(mix(h[:-2] * _GOLD + h[1:-1]) * _M2 + h[2:])
    _, inverse, counts = np.unique(w, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    cover = np.zeros(len(h), bool)
    for i in range(3):
        cover[i : i + len(twice)] |= twice
    return int(cover.sum())


def _stats(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = raw_texts(batch.column(1))
    words = Words(texts)
    ends = words.text_end
    starts = np.concatenate(([0], ends[:-1]))

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[ends] - sums[starts]

    data = words.data
    cols: dict[str, list[int] | np.ndarray] = {"n_words": np.diff(words.first), "word_chars": total(~SPACE[data] & ((data & 0xC0) != 0x80))}
    for i, name in enumerate(("n_upper", "n_letters", "n_marks", "n_bangs")):
        cols[name] = total(_KIND[:, i][data])
    cols["n_symbols"] = [len(t) - len(t.translate(None, SYMBOLS)) for t in texts]
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    cols["n_lines"] = [len(x) for x in lines]
    cols["n_dup_lines"] = [len(x) - len(set(x)) for x in lines]
    cols["n_repeat_words"] = [_repeat_words(words.hash[words.range(k)]) for k in range(len(texts))]
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(cols[c], pa.int64()) for c in _LONG)], names=["doc_id", *_LONG])


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text (null: no words)."""
    prepare(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(text, _stats, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in _LONG))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The rules over text_counts: -1 poor, 1 good, 0 no opinion."""
    c, words, lines = F.col, F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    length, symbols, upper = c("word_chars") / words, c("n_symbols") / words, c("n_upper") / F.greatest("n_letters", F.lit(1))
    return {
        "length": _vote(c("n_words") < 50, c("n_words") >= 80),
        "word_length": _vote((length < 3) | (length > 10), length.between(3.5, 8)),
        "symbols": _vote(symbols > 0.1, symbols < 0.02),
        "dup_lines": _vote(c("n_dup_lines") / lines > 0.5, c("n_dup_lines") / lines < 0.1),
        "repeat_words": _vote(c("n_repeat_words") / words > 0.4, c("n_repeat_words") / words < 0.15),
        "upper": _vote(upper > 0.3, upper < 0.12),
        "bangs": _vote(c("n_bangs") / words > 0.2, c("n_bangs") / words < 0.05),
        "marks": _vote(c("n_marks") / F.greatest("word_chars", F.lit(1)) > 0.1, c("n_marks") / F.greatest("word_chars", F.lit(1)) < 0.05),
    }


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, the counts, quality (posterior probability), base_failed, kept.

    A text without words fails. Rows that share a doc_id, or have none, are judged like any other; extra columns
    are ignored; an empty table gives no rows.
    """
    counts = saved(text_counts(docs), "counts")
    votes = rules()
    patterns = counts.groupBy(*(v.cast("int").alias(k) for k, v in votes.items())).count().collect()  # 3 ** rules at most
    model = weak.fit({tuple(r)[:-1]: r["count"] for r in patterns}, len(votes))
    z: Column = F.lit(model.bias)
    for w, v in zip(model.weight, votes.values(), strict=True):
        z = z + F.when(v < 0, float(w[0])).when(v > 0, float(w[2])).otherwise(float(w[1]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    quality = 1 / (1 + F.exp(-z))
    return counts.withColumns({"quality": quality, "base_failed": failed, "kept": ~failed & (quality >= least)})


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether it is kept: see judge."""
    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLE_SQL: dict[str, str] = {}
