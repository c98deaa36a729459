"""Spelling variants against comparing all pairs of words; edge rows."""

import random
import re
import zlib
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from idloom.llm import spelling
from idloom.llm.queries import QUERIES


def is_near(a, b):
    """One inserted, deleted or replaced code point apart, by the full table of distances."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] == 1


def plain_counts(texts):
    out = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def plain_variants(counts):
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 10 * counts[w]:
            form[w] = best
    out = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, counts[w], len(near[w]), counts.get(form.get(w))))
    return out


def test_spelling_variants(spark, tmp_path):
    rng = random.Random(5)
    stems = ["separate", "necessary", "aabbaabb", "zzzzzzz", "zzzzzzzz", "häuserÿ", "été×ètés", "Occurred", "SEPARATE", "short"]
    letters = "abcdeézÿ"

    def word():
        w = rng.choice(stems[:3]) if rng.random() < 0.7 else rng.choice(stems)
        for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])):
            i = rng.randrange(len(w))
            w = w[:i] + rng.choice(["", rng.choice(letters), rng.choice(letters) + w[i]]) + w[i + 1 :]
        return w

    texts = [(i, rng.choice([" ", "1", ", "]).join(word() for _ in range(rng.randint(0, 120)))) for i in range(60)]
    texts += [(100, None), (101, ""), (None, "separate Separate lostword lostword " * 40), (5, texts[5][1]), (5, texts[5][1]), (102, "x" * 50_000 + " " + "y" * 50_000), (103, "ß" * 9 + "Straße ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÁ ÀÀÀÀÀÀÁ")]
    docs = spark.createDataFrame([(d, t, 1, "a", 2) for d, t in texts], "doc_id bigint, text string, n int, word string, wid int")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in QUERIES["op13_spelling_variants"](spark, str(tmp_path)).collect()]
    want = plain_variants(plain_counts(texts))
    assert len(got) == len(set(got)) and set(got) == want and sum(r[1] is not None for r in got) > 5 and any(r[1] not in (None, r[2]) for r in got)
    assert spelling.spelling_variants(docs.limit(0)).collect() == []


def test_words_over_many_parts(spark, monkeypatch):
    """Beginnings and endings that words of several parts share keep one number."""
    monkeypatch.setattr(spelling, "PART_WORDS", 20)
    rng = random.Random(6)
    counts = {"".join(rng.choice("ab") for _ in range(rng.randint(7, 9))): rng.choice([2, 3, 30, 300, 5000]) for _ in range(300)}
    counts = counts | {"a" * 40: 2, "a" * 39: 20, "a" * 38: 200}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()
    assert {tuple(r) for r in got} == plain_variants(counts)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.text("abé", min_size=7, max_size=9), st.sampled_from([2, 9, 20, 200, 2000]), max_size=40))
def test_any_words(spark, counts):
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()
    assert {tuple(r) for r in got} == plain_variants(counts)


def test_a_very_long_text(spark):
    text = "separate neighbour " * 550_000  # 10 MB
    got = {r.word: r.n for r in spelling.spelling_variants(spark.createDataFrame([(1, text), (2, "separat neighbor separat neighbor")], "doc_id bigint, text string")).collect()}
    assert got == plain_counts([(1, text), (2, "separat neighbor separat neighbor")])
