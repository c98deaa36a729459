"""Personal data by weak supervision: labelers vote on candidate spans, a classifier trained on them decides.

Base spans follow fixed patterns and always stay. Looser candidates (obfuscated addresses, numbers without a
plus, split cards, failing checks) are voted on by regex, gazetteer and context labelers, like the base spans;
expectation-maximisation over the counts of all vote patterns of a kind gives the labelers' reliabilities, and a
logistic classifier trained on the resulting posteriors accepts or refuses each candidate. Offsets count code
points and ends are exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.llm import weak
from idloom.llm.common import clearing, documents, map_batches, prepare, saved

KINDS = ("email", "ip", "card", "phone")
#: Candidates with different features that the span classifier is trained on, at most.
TRAIN_CANDIDATES = 20_000
#: Probability from which a candidate that is no base span is accepted.
ACCEPT = 0.8

# Gazetteers of the labelers.
DOMAIN_ENDS = frozenset("com org net edu gov mil int info biz io co de fr es it nl eu uk us ca au ch at be se no dk fi pl pt ru br jp cn in mx".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "62", "64", "81", "82", "86", "90", "91")
CUES = {
    "email": frozenset("mail email e-mail correo contact contacto courriel kontakt write".split()),
    "ip": frozenset("ip host server address addr login adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit carte tarjeta karte".split()),
    "phone": frozenset("phone tel call mobile fax cell teléfono téléphone telefon whatsapp".split()),
}
OTHER_CUES = frozenset("version release order invoice isbn issn ticket serial build part model page".split())

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELT_AT = re.compile(r"[\x20]?[\[({][\x20]?(?:at|AT|At|@)[\x20]?[\])}][\x20]?|[\x20](?:AT)[\x20]")
_SPELT_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:[\x20]?(?:[\[({][\x20]?(?:dot|DOT|\.)[\x20]?[\])}]|DOT|\.)[\x20]?[A-Za-z0-9-]{2,63})+")
_NUMBER = re.compile(r"\(?[0-9](?:[\s.()/\[\]-]{0,3}[0-9])+")
_GROUPS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind's pattern, in the order of KINDS and then of start.

    Each scan is linear in the text: what a pattern can match is found from its fixed character or from
    maximal runs of digits.
    """
    out = []
    if "@" in text:
        done = 0
        at = text.find("@")
        while at >= 0:
            m = _DOMAIN.match(text, at + 1) if at > done and text[at - 1] in _LOCAL else None
            if m:
                start = at - 1
                while start > done and text[start - 1] in _LOCAL:
                    start -= 1
                out.append(("email", start, m.end()))
                done = m.end()
            at = text.find("@", max(at + 1, done))
    if not any(c in text for c in "0123456789"):
        return out
    cards = []
    for m in _DOTTED.finditer(text):
        if "." in m[0]:
            parts = list(_GROUPS.finditer(text, m.start(), m.end()))
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                if all(len(p[0].lstrip("0")) <= 3 and int(p[0]) <= 255 for p in four):
                    out.append(("ip", four[0].start(), four[3].end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = "".join(c for c in m[0] if c not in " -")
            if 13 <= len(digits) <= 19 and luhn(digits):
                cards.append(("card", m.start(), m.end()))
    out += cards
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Candidates that overlap no base span: spelt-out addresses and numbers in other shapes."""
    taken = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))

    def free(s: int, e: int) -> bool:
        i = bisect_left(starts, e)
        return not i or reach[i - 1] <= s

    for m in _SPELT_AT.finditer(text) if "(" in text or "[" in text or "{" in text or " AT " in text else ():
        start = m.start()
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        right = _SPELT_DOMAIN.match(text, m.end())
        if start < m.start() and right and free(start, right.end()):
            yield "email", start, right.end()
    for m in _NUMBER.finditer(text):
        n = m.end() - m.start()
        if n < 7 or not free(m.start(), m.end()):
            continue
        digits = _GROUPS.findall(m[0])
        size = sum(map(len, digits))
        if len(digits) == 4 and all(len(d) <= 3 and int(d) <= 255 for d in digits) and ("." in m[0]) and "-" not in m[0]:
            yield "ip", m.start(), m.end()
        elif 13 <= size <= 19:
            yield "card", m.start(), m.end()
        elif 9 <= size <= 12 and len(digits) > 1 and "/" not in m[0]:
            yield "phone", m.start(), m.end()


LABELERS = ("pattern", "gazetteer", "context", "shape", "edges")
#: How far each labeler is trusted before any data: one number in ten passes a card's checksum by chance, shapes say little.
BELIEFS = (0.97, 0.75, 0.85, 0.65, 0.65)


def votes_of(text: str, kind: str, start: int, end: int, is_base: bool) -> list[int]:
    """One vote per labeler: 1 personal data of this kind, -1 not, 0 no opinion."""
    span = text[start:end]
    groups = _GROUPS.findall(span)
    digits = "".join(groups)
    before = re.findall(r"[\w-]+", text[max(0, start - 48) : start].lower())[-4:]
    left = text[start - 1] if start else " "
    right = text[end] if end < len(text) else " "
    pattern = 1 if is_base else 0
    if kind == "email":
        tail = re.findall(r"[A-Za-z]+", span)[-1:] or [""]
        gaz = 1 if tail[0].lower() in DOMAIN_ENDS else -1
        shape = 1 if 6 <= len(span) <= 80 else -1
    elif kind == "ip":
        gaz = -1 if groups[0] in ("0", "127", "255") else 1
        shape = 1 if all(g == "0" or g[0] != "0" for g in groups) and re.fullmatch(r"[0-9.\s\[\]()]+", span) else -1
    elif kind == "card":
        pattern = pattern if luhn(digits) else -1
        gaz = 1 if digits[0] in "3456" else -1
        shape = 1 if len(groups) == 1 or all(3 <= len(g) <= 6 for g in groups) else -1
    else:
        gaz = (1 if digits.startswith(CALLING_CODES) else -1) if is_base else 1 if digits.startswith("00") else 0
        shape = 1 if all(1 <= len(g) <= 5 for g in groups) and 2 <= len(groups) <= 6 else -1
    context = 1 if any(w in CUES[kind] for w in before) else -1 if any(w in OTHER_CUES for w in before) else 0
    edges = -1 if left.isalnum() or right.isalnum() or left in "=\"'_" else 1
    return [pattern, gaz, context, shape, edges]


def _features(kind: str, text: str, start: int, end: int, votes: list[int]) -> list[float]:
    span = text[start:end]
    n = end - start
    return [*(float(kind == k) for k in KINDS), *(float(v) for v in votes), n / 32, sum(c.isdigit() for c in span) / n, sum(c in " ()[].-/" for c in span) / n, float("@" in span), float(span[:1] == "+")]


FEATURES = len(KINDS) + len(LABELERS) + 5
_SPAN = "struct<kind:string,start:bigint,end:bigint,base:boolean,votes:array<int>,features:array<double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.float64()))]))


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = []
    for text in batch.column(1).to_pylist():
        text = text or ""
        base = base_spans(text)
        spans = [(k, s, e, True) for k, s, e in base] + [(k, s, e, False) for k, s, e in loose_spans(text, base)]
        rows = []
        for k, s, e, is_base in spans:
            v = votes_of(text, k, s, e, is_base)
            rows.append({"kind": k, "start": s, "end": e, "base": is_base, "votes": v, "features": _features(k, text, s, e, v)})
        found.append(rows)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPAN_TYPE)], names=["doc_id", "found"])


def train(features: np.ndarray, target: np.ndarray, count: np.ndarray, rounds: int = 300, rate: float = 0.5) -> np.ndarray:
    """Weights (bias last) of a logistic classifier on soft targets, rows of which occur so often, by gradient descent with a small penalty."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-x @ w))
        w -= rate * (x.T @ (count * (p - target)) / count.sum() + 1e-3 * w)
    if not len(x):
        w[-1] = -10.0
    return w


def _fit(every: DataFrame) -> np.ndarray:
    """The span classifier's weights for a table of candidates (kind, start, end, votes, features)."""
    patterns: dict[str, dict[tuple[int, ...], int]] = {k: {} for k in KINDS}
    for r in every.groupBy("kind", "votes").count().collect():  # at most 3 ** labelers for each kind
        patterns[r["kind"]][tuple(r["votes"])] = r["count"]
    models = {k: weak.fit(v, len(LABELERS), start_prior=0.5, belief=BELIEFS) for k, v in patterns.items()}
    # Equal candidates, as of a line in many documents, are one row of the sample and count as often as they occur.
    different = every.groupBy("kind", "votes", "features").count()
    sample = different.orderBy(F.xxhash64("kind", "features"), "kind", "features").limit(TRAIN_CANDIDATES).collect()
    x = np.array([r["features"] for r in sample]).reshape(len(sample), FEATURES)
    return train(x, np.array([models[r["kind"]].posterior(r["votes"]) for r in sample]), np.array([r["count"] for r in sample], float))


def _found(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    prepare(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = saved(map_batches(text, _scan, f"doc_id bigint, found array<{_SPAN}>"), "candidates")
    return found, _fit(found.select(F.explode("found").alias("c")).select("c.*"))


def find_pii(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """One row per row of docs: doc_id, spans array<struct<kind, start, end, base, score>>.

    Null and empty texts have no spans. Rows that share a doc_id, or have none, are searched like any other;
    extra columns are ignored; an empty table gives no rows. Candidates overlap no base span.
    """
    found, w = _found(docs)

    def scored(c):
        dot = F.aggregate(F.zip_with(c["features"], F.array(*(F.lit(float(v)) for v in w[:-1])), lambda a, b: a * b), F.lit(float(w[-1])), lambda a, b: a + b)
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), (1 / (1 + F.exp(-dot))).alias("score"))

    spans = F.filter(F.transform("found", scored), lambda c: c["base"] | (c["score"] >= accept))
    return found.select("doc_id", spans.alias("spans"))


def _masked(text: str, w: np.ndarray, least: float) -> str:
    base = base_spans(text)
    spans = list(base)
    for k, s, e in loose_spans(text, base):
        if np.dot(_features(k, text, s, e, votes_of(text, k, s, e, False)), w[:-1]) + w[-1] >= least:
            spans.append((k, s, e))
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if e <= at:
            continue
        out += [text[at : max(s, at)], f"<{k.upper()}>" if s >= at else ""]
        at = e
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """docs with every span of personal data in text replaced by <KIND>; n_chars, if there, counts the new text.

    Of spans that overlap, the one that starts first gives the name and all of their text goes. A second scan
    with the trained classifier replaces the spans, so no text is shuffled. Null and empty texts stay as they are (a
    null text keeps its n_chars); rows that share a doc_id, or have none, are masked like any other; all other columns
    stay, whatever their names; an empty table gives no rows.
    """
    with clearing(docs.sparkSession):
        _, w = _found(docs)
    names, types = docs.columns, dict(docs.dtypes)
    least = float(np.log(accept / (1 - accept)))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if not t else _masked(t, w, least) for t in batch.column("text").to_pylist()]
        new = {"text": pa.array(texts, pa.string())}
        if types.get("n_chars") == "bigint":
            new["n_chars"] = pa.array([c if t is None else len(t) for t, c in zip(texts, batch.column("n_chars").to_pylist(), strict=True)], pa.int64())
        return pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)

    return map_batches(docs, fn, docs.schema)


def _of(spans, kind: str):
    return F.filter(spans, lambda c: c["kind"] == kind)


def _written(places, kind: str):
    return F.transform(places, lambda c: F.concat_ws(":", F.lit(kind), c["s"].cast("string"), c["e"].cast("string")))


def _ordered(spans):
    """Spans as text, kind:start:end, by kind as listed and then by start."""
    parts = []
    for kind in KINDS:
        places = F.transform(_of(spans, kind), lambda c: F.struct(c["start"].alias("s"), c["end"].alias("e")))
        parts.append(_written(F.array_sort(places), kind))
    return F.array_join(F.concat(*parts), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document, the base ones counted and hashed: see find_pii."""
    found = find_pii(documents(spark, sf_dir))
    base = F.filter("spans", lambda c: c["base"])
    counts = [F.size(_of(base, k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_ordered(base), 256).alias("base_sha256"), _ordered(F.col("spans")).alias("spans"))


QUERIES = {"op6_pii": op6_pii}
ORACLE_SQL: dict[str, str] = {}
