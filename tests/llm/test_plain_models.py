"""Scores, features and chunks written out once more in plain Python, without numpy, to hold the operators against."""

import bisect
import random

import numpy as np
import pytest

from idloom.llm import boosting, chunk_dedup, language, toxicity

MASK = (1 << 64) - 1


def plain_grams(text: bytes):
    """Buckets of the n-grams of the letters, everything else as blanks, blanks alone left out."""
    fold = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in b"   " + text + b"   ")
    for n in (2, 3, 4):
        for i in range(len(fold) - n + 1):
            gram = fold[i : i + n]
            if gram.strip(b" "):
                yield ((int.from_bytes(gram, "big") + (n << 40)) * 0x9E3779B97F4A7C15 & MASK) >> 48


def test_language_scores_are_averages_of_table_rows():
    rng = np.random.default_rng(3)
    table = rng.standard_normal((65_537, 3)).astype(np.float32)
    table[-1] = 0
    texts = ["The  Quick; brown", "", "12 34", "Straße und Öl", "é", "a" * 9, "word " * 70_000]
    got = language.average([t.encode() for t in texts], table)
    model = language.Model(["a", "b", "c"], table, np.array([0.1, 0.0, -0.2]), 3.0, 0.0)
    best, score = model.predict([t.encode() for t in texts])
    for k, t in enumerate(texts):
        sums, n = [0.0] * 3, 0
        for b in plain_grams(t.encode()):
            sums = [s + float(v) for s, v in zip(sums, table[b], strict=True)]
            n += 1
        mean = [s / max(1, n) for s in sums]
        assert np.allclose(got[k], mean, atol=1e-5)
        logits = [3.0 * (m + b) for m, b in zip(mean, (0.1, 0.0, -0.2), strict=True)]
        odds = [np.exp(v - max(logits)) for v in logits]
        assert best[k] == odds.index(max(odds)) and abs(score[k] - max(odds) / sum(odds)) < 1e-4


def plain_tree(tree, row):
    node = 0
    while tree.feature[node] >= 0:
        node = tree.left[node] if row[tree.feature[node]] <= tree.cut[node] else tree.right[node]
    return tree.value[node]


def plain_isotonic(margin, y, w):
    """{margin: probability}: the greatest of the least means over runs that begin at or before and end at or after it."""
    at = sorted(set(margin))
    s = [sum(b * c for a, b, c in zip(margin, y, w, strict=True) if a == m) for m in at]
    n = [sum(c for a, c in zip(margin, w, strict=True) if a == m) for m in at]
    mean = [max(min(sum(s[a : b + 1]) / sum(n[a : b + 1]) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
    out, top = {}, 0.0
    i = 0
    while i < len(at):
        j = i
        while j + 1 < len(at) and abs(mean[j + 1] - mean[i]) < 1e-12:
            j += 1
        top = max(top, (sum(s[i : j + 1]) + 0.02) / (sum(n[i : j + 1]) + 0.5))
        out.update({m: min(1.0, top) for m in at[i : j + 1]})
        i = j + 1
    return out


def test_trees_and_calibration():
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((300, 4)), 1)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.standard_normal(300)) > 0.4).astype(float)
    weight = rng.choice([1.0, 2.5], 300)
    model = boosting.fit(x, y, weight, rounds=12)
    margin = model.margin(x)
    for i in range(0, 300, 7):
        assert abs(margin[i] - (model.base + sum(plain_tree(t, x[i]) for t in model.trees))) < 1e-9
    model.steps = boosting.isotonic(margin, y, weight)
    want = plain_isotonic(margin.tolist(), y.tolist(), weight.tolist())
    at, to = zip(*sorted(want.items()), strict=True)
    for m in [*margin[:60].tolist(), margin.min() - 1, margin.max() + 1, *(margin[:40] + 0.013).tolist()]:
        k = bisect.bisect_right(at, m) - 1
        if k < 0 or k == len(at) - 1:
            value = to[max(k, 0)]
        else:
            value = to[k] + (to[k + 1] - to[k]) * (m - at[k]) / (at[k + 1] - at[k])
        assert abs(float(np.interp(m, *model.steps)) - value) < 1e-9
    better = sum((model.score(x) >= 0.5) == (y > 0))
    assert better > 260


def plain_features(text, words, stems):
    edge = toxicity._EDGE
    tokens = []
    for w in text.lower().split():
        while w and w[0] in edge:
            w = w[1:]
        while w and w[-1] in edge:
            w = w[:-1]
        tokens.append(w)
    n, chars = max(1, len(tokens)), max(1, len(text))
    hits = [i for i, w in enumerate(tokens) if w in words]
    near = sum(any(t in toxicity.SECOND_PERSON for j, t in enumerate(tokens) if abs(j - i) <= 5) for i in hits)
    stem = [max(stems.get(w[:k], 0) for k in (4, 5, 6)) for w in tokens]
    stem = [s for s, w in zip(stem, tokens, strict=True) if any(w[:k] in stems for k in (4, 5, 6))]
    hidden = {w for w in tokens if not w.isalpha() and toxicity._INNER.search(w)}
    open_ = lambda w: "".join("oieastasii"["013457@$!|".index(c)] if c in "013457@$!|" else c for c in w)
    shown = sum(open_(w) in words or "".join(c for c in w if c not in "*.-_") in words for w in hidden)
    odds = [words[tokens[i]] for i in hits]
    count = lambda kind: sum(c in kind for c in text)
    return [len(hits), 100 * len(hits) / n, sum(odds) / n, max(odds, default=0), len({tokens[i] for i in hits}), len(stem), 100 * len(stem) / n, max(stem, default=0),
            near / (len(hits) + 1), 100 * sum(w in toxicity.SECOND_PERSON for w in tokens) / n, count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars, 100 * count("!?") / chars,
            100 * count("!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~") / chars, 100 * len(hidden) / n, shown]


def test_toxicity_features():
    lex = toxicity.Lexicon({"idiot": 3.0, "fool": 2.5, "stupid": 4.0}, {"idio": 2.6, "stupi": 3.5})
    rng = random.Random(6)
    some = ["you", "IDIOT!", "id1ot", "f*ol", "st.upid", "Tu", "(fool)", "idiotic", "stupidly", "fine", "Day?!", "a_b", "«été»", "word", "--", "...", "x1y"]
    texts = ["", "...", " ".join(some), *(" ".join(rng.choice(some) for _ in range(rng.randint(1, 60))) for _ in range(40)), "you fool " * 4000]
    got = toxicity.features(texts, lex)
    for k, t in enumerate(texts):
        assert np.allclose(got[k], plain_features(t, lex.words, lex.stems)), t[:80]


def plain_chunks(text: bytes):
    """Ends of the chunks: local maxima of the gear hash, not too close, never too far apart, between characters."""
    gear, wide = chunk_dedup.GEAR.tolist(), 80
    data = b"\0" * wide + text + b"\0" * wide
    h = [sum(gear[data[i - j]] << j for j in range(16)) & 0xFFFF if i >= 16 else 0 for i in range(len(data))]
    ends, last = [], 0
    lead = lambda i: i < len(text) and text[i] & 0xC0 == 0x80

    def far(at):
        at += chunk_dedup.MOST
        for _ in range(3):
            at -= lead(at)
        return at

    for i in range(len(text)):
        if h[i + wide] != max(h[i + wide - chunk_dedup.REACH : i + wide + chunk_dedup.REACH + 1]):
            continue
        c = i + 1
        while lead(c):
            c += 1
        while c - last > chunk_dedup.MOST:
            last = far(last)
            ends.append(last)
        if c - last >= chunk_dedup.LEAST and c < len(text):
            ends.append(c)
            last = c
    while len(text) - last > chunk_dedup.MOST:
        last = far(last)
        ends.append(last)
    return [*ends, len(text)] if len(text) > last else ends


def _texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghiéü") for _ in range(rng.randint(1, 9)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(rng.randint(1, 150))) for _ in range(25)]
    texts += [f"{texts[i]} {passage}\n{texts[i + 1]}" for i in (0, 4, 8)] + [texts[3], passage + " " + passage, "x" * 1500, "é" * 700, ""]
    return list(enumerate(texts))


def test_chunk_ends():
    texts = [t.encode() for _, t in _texts()]
    assert chunk_dedup.boundaries(texts) == [plain_chunks(t) for t in texts]


@pytest.mark.parametrize("least", [1, 12])
def test_repeated_spans_equal_plain_chunks(spark, least):
    rows = _texts()
    chunks, first = {}, {}
    for doc, text in rows:
        raw, at = text.encode(), 0
        chunks[doc] = []
        for end in plain_chunks(raw):
            chunks[doc].append((at, end, raw[at:end]))
            first.setdefault(raw[at:end], doc)
            at = end
    want = {}
    for doc, text in rows:
        raw, seen, runs, last = text.encode(), set(), [], None
        for k, (a, b, body) in enumerate(chunks[doc]):
            if first[body] < doc or body in seen:
                words = sum(raw[i : i + 1].strip() != b"" and (i == 0 or raw[i - 1 : i].strip() == b"") for i in range(a, b))
                if last == k - 1 and runs:
                    runs[-1] = (runs[-1][0], b, runs[-1][2] + words)
                else:
                    runs.append((a, b, words))
                last = k
            seen.add(body)
        kept = [(a, b) for a, b, n in runs if n >= least]
        if kept:
            want[doc] = kept
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in chunk_dedup.repeated_spans(docs, least).collect()}
    assert got == want and len(want) >= 4
