"""Toxicity: gradient-boosted trees over dense features of the whole text, with isotonic calibration.

Features: densities of a lexicon and of word stems learnt from labelled rows, closeness of lexicon words to
second-person words, capitals, punctuation and obfuscation rates. Training reads a bounded sample of labelled rows
in FOLDS parts: each part's features come from a lexicon of the other parts, its margins for the calibration from
trees of the other parts, so every row serves all three steps and none meets itself.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.llm import boosting
from idloom.llm.common import documents, drawn, id_bucket, map_batches, prepare, training_window

#: Labelled rows of each class that training reads (in expectation; both together never above twice as many).
TOXIC_ROWS, OTHER_ROWS = 3000, 6000
FOLDS = 5
THRESHOLD = 0.3

# Second-person words of the languages in use, and look-alikes of letters in disguised words.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch tú ti usted ustedes vosotros su sus".split())
DISGUISE = str.maketrans("013457@$!|", "oieastasii")
_EDGE = ".,;:!?\"'()[]{}<>«»“”‘’…#*$%&|-_"
_INNER = re.compile(r"[^\W\d_]+[*@$!|013457.\-_]+[^\W\d_]")
_FILLER = re.compile(r"[*.\-_]+")
_STEMS = (4, 5, 6)
FEATURES = 15
_CLASS = np.zeros((256, 3), np.int64)
_CLASS[ord("A") : ord("Z") + 1, 0] = 1
_CLASS[[ord(c) for c in "!?"], 1] = 1
_CLASS[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"], 2] = 1


@dataclass
class Lexicon:
    words: dict[str, float]
    stems: dict[str, float]


class Tally:
    """In how many texts of either label each word and each stem is."""

    def __init__(self) -> None:
        self.n, self.words, self.stems = [0, 0], (Counter(), Counter()), (Counter(), Counter())

    def add(self, text: str, toxic: bool) -> None:
        own = {w.strip(_EDGE) for w in text.lower().split()}
        self.n[toxic] += 1
        self.words[toxic].update(own)
        self.stems[toxic].update({w[:k] for w in own for k in _STEMS if len(w) >= k})

    def merge(self, other: Tally) -> None:
        for t in (0, 1):
            self.n[t] += other.n[t]
            self.words[t].update(other.words[t])
            self.stems[t].update(other.stems[t])

    def lexicon(self, without: Tally | None = None, least: int = 4) -> Lexicon:
        """Words and stems whose log odds of being in a toxic text are high, less the counts of `without`."""
        less = without or Tally()
        n = [a - b for a, b in zip(self.n, less.n, strict=True)]

        def odds(counts: tuple[Counter, Counter], off: tuple[Counter, Counter], least: int, floor: float) -> dict[str, float]:
            out = {}
            for w, c in counts[1].items():
                if w and c >= least and (c := c - off[1][w]) >= least:
                    s = math.log((c + 0.5) / (n[1] + 1)) - math.log((counts[0][w] - off[0][w] + 0.5) / (n[0] + 1))
                    if s >= floor:
                        out[w] = s
            return out

        return Lexicon(odds(self.words, less.words, least, 2.0), odds(self.stems, less.stems, 2 * least, 2.5))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.lower().encode(), digest_size=16).digest()


def tallies(texts: list[str], toxic: np.ndarray, folds: int) -> tuple[list[Tally], np.ndarray]:
    """The counts of each fold and the fold of each text; equal texts (case apart) share a fold and count once a label."""
    parts, fold, seen = [Tally() for _ in range(folds)], np.empty(len(texts), np.int64), set()
    for i, (text, t) in enumerate(zip(texts, toxic.tolist(), strict=True)):
        key = (bool(t), _digest(text))
        fold[i] = int.from_bytes(key[1][:8], "little") % folds
        if key not in seen:
            seen.add(key)
            parts[fold[i]].add(text, bool(t))
    return parts, fold


def learn_lexicon(texts: list[str], toxic: np.ndarray) -> Lexicon:
    return tallies(texts, toxic, 1)[0][0].lexicon()


def features(texts: list[str], lex: Lexicon) -> np.ndarray:
    out = np.zeros((len(texts), FEATURES))
    words, stems = lex.words, lex.stems
    for k, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8)
        caps, bangs, marks = _CLASS[raw].sum(axis=0).tolist() if len(raw) < 1 << 22 else (np.bincount(raw, minlength=256) @ _CLASS).tolist()
        tokens = [w.strip(_EDGE) for w in text.lower().split()]
        n, chars = max(1, len(tokens)), max(1, len(text))
        hits = [i for i, w in enumerate(tokens) if w in words]
        near = sum(not SECOND_PERSON.isdisjoint(tokens[max(0, i - 5) : i + 6]) for i in hits)
        stem = [max(stems.get(w[:4], 0), stems.get(w[:5], 0), stems.get(w[:6], 0)) for w in tokens if w[:4] in stems or w[:5] in stems or w[:6] in stems]
        second = sum(w in SECOND_PERSON for w in tokens)
        hidden = [m for w in set(tokens) if not w.isalpha() and _INNER.search(w) for m in [w]]
        shown = sum(w.translate(DISGUISE) in words or _FILLER.sub("", w) in words for w in hidden)
        odds = [words[tokens[i]] for i in hits]
        out[k] = (len(hits), 100 * len(hits) / n, sum(odds) / n, max(odds, default=0), len({tokens[i] for i in hits}), len(stem), 100 * len(stem) / n, max(stem, default=0),
                  near / (len(hits) + 1), 100 * second / n, caps / chars, 100 * bangs / chars, 100 * marks / chars, 100 * len(hidden) / n, shown)
    return out


@dataclass
class Scorer:
    lexicon: Lexicon
    trees: boosting.Boosted

    def score(self, texts: list[str]) -> np.ndarray:
        return np.clip(self.trees.score(features(texts, self.lexicon)), 0, 1)


def train(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Scorer:
    parts, fold = tallies(texts, toxic, FOLDS)
    every = Tally()
    for p in parts:
        every.merge(p)
    x, margin = np.zeros((len(texts), FEATURES)), np.zeros(len(texts))
    for f, p in enumerate(parts):
        at = np.flatnonzero(fold == f)
        x[at] = features([texts[i] for i in at], every.lexicon(p))
    for f in range(FOLDS):
        at, rest = fold == f, fold != f
        if at.any() and rest.any():
            margin[at] = boosting.fit(x[rest], toxic[rest], weight[rest]).margin(x[at])
    trees = boosting.fit(x, toxic, weight)
    trees.steps = boosting.isotonic(margin, toxic, weight)
    return Scorer(every.lexicon(), trees)


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A bounded sample: texts (windows of long ones), labels and the number of labelled rows that each stands for."""
    known = labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    most = {1: TOXIC_ROWS, 0: OTHER_ROWS}
    share = {t: min(1.0, most[t] / n) for t, n in counts.items()}
    picked = F.lit(False)
    for t, p in share.items():
        picked = F.when(F.col("toxic") == t, drawn(p, F.col("doc_id").cast("string"), F.lit("toxicity"))).otherwise(picked)
    bounded = known.where(picked).limit(2 * sum(most.values()))
    rows = docs.select("doc_id", "text").join(F.broadcast(bounded), "doc_id").where("text is not null").select("doc_id", "toxic", training_window().alias("text")).limit(2 * sum(most.values())).collect()
    rows.sort(key=lambda r: (r["toxic"], r["doc_id"], r["text"]))
    y = np.array([float(r["toxic"]) for r in rows])
    return [r["text"] for r in rows], y, np.array([1 / max(1e-12, share[r["toxic"]]) for r in rows])


def score_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1, higher: toxic likelier), predicted (score >= threshold).

    usable is a condition on doc_id for the labelled rows that training may read. Null texts are scored as
    empty ones, rows that share a doc_id or have none like any other. Of a doc_id labelled more than once each label
    counts. Without labels of both classes every score is 0. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts, y, weight = training_rows(docs, labels, usable)
    scorer = train(texts, y, weight) if 0 < y.sum() < len(y) and len(y) >= 10 else None
    box = spark.sparkContext.broadcast(scorer)  # a lexicon of at most what the sample holds

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        score = box.value.score(texts) if box.value else np.zeros(len(texts))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(source, fn, "doc_id bigint, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels of rows whose id's remainder is not 2: see score_toxicity. A null doc_id has a null held_out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score_toxicity(documents(spark, sf_dir), labels, id_bucket() != 2)
    return found.select("doc_id", (id_bucket() == 2).alias("held_out"), "score", "predicted")


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE_SQL: dict[str, str] = {}
