"""The registered corpus queries and the pipeline over a small table, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from idloom.llm import common, language, pii, toxicity
from idloom.llm.queries import ORACLE_SQL, QUERIES
from idloom.llm.tokens import tokenizer_path

WORDS = {"en": "the and of that with this from have".split(), "de": "und der die nicht mit ein auch wenn".split()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    text = lambda k, n: " ".join(f"{rng.choice(WORDS[k])}{rng.choice('abcdefgh')}" for _ in range(n))
    out = [(i, text(k, rng.randint(20, 120)), k) for i, k in enumerate(["en", "de"] * 40)]
    long, near = text("en", 3000), text("de", 100)
    out += [(100, long, "en"), (101, long.upper(), "en"), (102, long + " tail", "en"), (103, near, "de"), (104, near + " ende", "de"), (105, near + " ganz anders", "de")]
    out += [(110, None, "en"), (111, "", None), (112, "12 !! 34", "en"), (113, "write to a.b@c.de and that is from the host 10.0.0.1 of this", "en"), (114, "mail x@y.org " * 3 + out[5][1], "de")]
    out += [(3, out[3][1], "de"), (None, text("de", 60), "de"), (None, None, None)]  # a repeated row and rows without an id
    return [(*r, "s", len(r[1] or "")) for r in out]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(80)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def low(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def groups(texts, k):
    """{doc_id: (shingles, least doc_id of its group)} by comparing all pairs."""
    sets = {}
    for i, t in texts:
        w = low(t).split()
        if i is not None:
            sets.setdefault(i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or {tuple(w)} - {()})
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {i: lo if r == hi else r for i, r in root.items()}
    return {i: (len(s), root[i]) for i, s in sets.items()}


def test_exact_dedup_equals_its_sql(spark, folder):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    found = QUERIES["op1_exact_dedup"](spark, folder)
    q = db.execute(ORACLE_SQL["op1_exact_dedup"])
    names = [c[0] for c in q.description]
    rows, known = found.collect(), [dict(zip(names, r, strict=True)) for r in q.fetchall()]
    # Of rows that share a doc_id, or have none, the SQL marks every one or none as kept.
    shown = lambda rows: Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"], r["doc_id"] in (3, None) or r["kept"]) for r in rows)
    assert sorted(found.columns) == sorted(names) and shown(rows) == shown(known)
    assert sum(r["kept"] for r in rows) == len({r["text_sha256"] for r in rows})


def test_token_queries_equal_the_libraries(spark, folder, rows):
    import sentencepiece
    from tokenizers import Tokenizer

    crc = lambda ids: zlib.crc32(np.array(ids, np.uint32).tobytes())
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    want = [(r[0], len(x := lib.encode(r[1] or "")), crc(x), True) for r in rows]
    assert Counter(map(tuple, QUERIES["op2_sentencepiece"](spark, folder).collect())) == Counter(want)
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {r[1]: [*lib.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    got = sorted(QUERIES["op8_token_files"](spark, folder).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r[0], len(ids[r[1]]), crc(ids[r[1]])) for r in rows)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for r in rows:
        x = [*lib.encode(r[1] or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(x) - 1) % 1024 + 1, len(x), 1024), len(x)]
        want.update((r[0], i, a, b - a, crc(x[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter(tuple(r)[:5] for r in QUERIES["op5_best_fit_packing"](spark, folder).collect()) == want


def test_models_score_each_text_alone(spark, folder, rows):
    docs = common.documents(spark, folder)
    usable = common.id_bucket() != 2
    model = language.train(*language.training_rows(docs, usable))
    got = QUERIES["op3_language_id"](spark, folder).collect()
    want = []
    for i, t, *_ in rows:
        best, score = model.predict([(t or "").encode()])
        real = any(c.isalpha() for c in t or "")
        want.append((i, model.languages[best[0]] if real else "und", float(score[0]) if real else 0.0))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert all(r.rejected == (r.lang_pred == "und" or r.score < model.least) for r in got)
    got, want = sorted(((r.doc_id, r.lang_pred, r.score) for r in got), key=order), sorted(want, key=order)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], rtol=0, atol=1e-6)
    scorer = toxicity.train(*toxicity.training_rows(docs, spark.read.parquet(f"{folder}/labels.parquet"), usable))
    got = Counter((r.doc_id, round(r.score, 6), r.predicted) for r in QUERIES["op4_toxicity"](spark, folder).collect())
    assert got == Counter((i, round(s := float(scorer.score([t or ""])[0]), 6), int(s >= toxicity.THRESHOLD)) for i, t, *_ in rows)


def test_span_and_count_queries(spark, folder, rows):
    want = Counter()
    for i, t, *_ in rows:
        spans = pii.base_spans(t or "")
        shown = ",".join(f"{k}:{s}:{e}" for k in pii.KINDS for k2, s, e in sorted(spans, key=lambda x: x[1]) if k2 == k)
        want[i, *(sum(s[0] == k for s in spans) for k in pii.KINDS), hashlib.sha256(shown.encode()).hexdigest()] += 1
    got = QUERIES["op6_pii"](spark, folder).collect()
    assert Counter(tuple(r)[:6] for r in got) == want and sum(r.n_email for r in got) == 4 and sum(r.n_ip for r in got) == 1
    got = QUERIES["op9_quality_rules"](spark, folder).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars) for r in got) == Counter((i, len(w := (t or "").split()), sum(map(len, w))) for i, t, *_ in rows)


def test_repeat_queries(spark, folder, rows):
    found = groups([r[:2] for r in rows], 2)
    got = QUERIES["op10_minhash_near_dedup"](spark, folder).collect()
    want = Counter((i, *found[i], found[i][1] == i) for i, *_ in rows if i is not None)
    assert Counter(tuple(r) for r in got if r.doc_id is not None) == want and sum(r.doc_id is None for r in got) == 2
    text = {i: (t or "").encode() for i, t, *_ in rows if i is not None}
    got = {r.doc_id: r for r in QUERIES["op7_substring_dedup"](spark, folder).collect()}
    assert {102, 104, 105} <= set(got) and 100 in got[102].source_ids and 103 in got[104].source_ids
    for i, r in got.items():
        cut = [text[i][s.start : s.end] for s in r.spans]
        assert (r.n_spans, r.cut_bytes) == (len(cut), sum(map(len, cut))) and all(s <= i for s in r.source_ids)
        if len(r.source_ids) == 1 and r.source_ids[0] < i:
            assert all(c in text[r.source_ids[0]] for c in cut)


def test_pipeline_equals_brute_force(spark, folder, rows):
    from tokenizers import Tokenizer

    got = corpus_pipeline.run(spark, folder).collect()
    model = language.train(*language.training_rows(common.documents(spark, folder), F.lit(True)))
    left = [(i, t) for i, t, *_ in rows if any(c.isalpha() for c in t or "") and model.predict([t.encode()])[1][0] >= model.least]
    last = {low(t): i for i, t in sorted(left, key=lambda r: (r[0] is not None, r[0] or 0))}
    left = [(i, t) for i, t in {(i, t): 0 for i, t in left} if last[low(t)] == i]  # equal rows leave one
    near = groups(left, 5)
    left = [(i, t) for i, t in left if i is None or near[i][1] == i]
    assert {100, 102, 104, 105, 110, 111, 112}.isdisjoint(i for i, _ in left) and 80 < len(left) < len(rows) - 6
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in left:
        at, out = 0, ""
        for kind, s, e in sorted(pii.base_spans(t), key=lambda x: x[1]):
            out, at = f"{out}{t[at:s]}<{kind.upper()}>", e
        want[i, tuple([*lib.encode(out + t[at:], add_special_tokens=False).ids, 2])] += 1
    parts, seqs = {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length
        parts.setdefault(r.doc_id, {})[r.start] = np.frombuffer(r.ids, np.uint32).tolist()
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert Counter((i, tuple(x for s in sorted(p) for x in p[s])) for i, p in parts.items()) == want
    for places in seqs.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 1024
