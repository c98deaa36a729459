"""Corpus operators: brute force, round trips, edge rows (nulls, empty and long texts, ties, clashing columns)."""

import os
import random
import re
import shutil
import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from idloom.llm import boosting, chunk_dedup, common, eliasfano, exact_dedup, language, near_dedup, packing, pieces, pii, quality, token_files, toxicity, weak
from idloom.llm.tokens import Encoder, tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id string, kept int, score string"
BASE = " ".join(f"word{i} of" for i in range(60))


@pytest.fixture(scope="module")
def rows():
    near = BASE.replace("word7 ", "other ")
    texts = [None, "", BASE, BASE, BASE.upper(), near, "one", "one", "x y " * 4000, "1234 !!", BASE + " tail"]
    out = [(i, t, "en", "s", len(t or ""), "c", 1, "z") for i, t in enumerate(texts)]
    return [*out, (3, BASE, None, None, None, None, None, None), (None, "lost " * 9, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_exact_dedup(spark, docs, tmp_path):
    path = str(tmp_path / "documents.parquet")
    docs.repartition(4).write.parquet(path)
    got = exact_dedup.exact_duplicates(spark, path, bytes_per_batch=1).collect()  # one file a micro-batch
    assert len(got) == 13 and sum(r.kept for r in got) == 8
    by = {r.doc_id: r for r in got}
    assert by[2].keep_id == 4 and by[2].group_size == 4 and by[0].keep_id == 1 and by[6].keep_id == 7 and by[None].kept
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 8
    docs.limit(0).write.parquet(str(tmp_path / "none.parquet"))
    assert exact_dedup.exact_duplicates(spark, str(tmp_path / "none.parquet")).count() == 0


def test_exact_dedup_goes_on_with_its_state(spark, tmp_path):
    path, state = tmp_path / "documents.parquet", str(tmp_path / "state")
    write = lambda rows, part: spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(f"{path}/{part}")
    write([(1, "a"), (2, "A"), (3, "b")], "source=x")
    first = exact_dedup.exact_duplicates(spark, str(path), checkpoint=state)
    assert {tuple(r)[:4] for r in first.collect()} == {(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)}
    write([(9, "a"), (2, "b"), (5, None), (5, "")], "source=y")  # a repeated id in a file of another folder
    for checkpoint in (state, None):
        again = exact_dedup.exact_duplicates(spark, str(path), checkpoint=checkpoint)
        assert sorted(tuple(r)[:3] for r in again.collect()) == [(1, 9, 3), (2, 3, 2), (2, 9, 3), (3, 3, 2), (5, 5, 2), (5, 5, 2), (9, 9, 3)]
        assert sorted(r.doc_id for r in again.collect() if r.kept) == [3, 5, 9]


def test_columns_of_any_name_stay(spark, docs, rows):
    names = ["_at", "_file", "_row", "row", "spans", "score", "rejected", "text_key", "_metadata"]
    wide = docs.select("doc_id", "text", "lang", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    few = {"exact": exact_dedup.drop_exact_duplicates(wide), "pii": pii.mask_pii(wide), "cut": chunk_dedup.cut_spans(wide, chunk_dedup.repeated_spans(wide))}
    import corpus_pipeline

    few |= {name: stage(spark, wide, "") for name, stage in corpus_pipeline.STAGES[:4]}
    for name, found in few.items():
        assert found.columns == wide.columns, name
        assert {tuple(r)[3:] for r in found.collect()} == {tuple(range(len(names)))}, name
        assert (few[name].count() == len(rows)) == (name in ("pii", "cut")), name


def test_empty_tables(spark, docs):
    import corpus_pipeline

    none, model = docs.limit(0), tokenizer_path("piece_bpe_32k.model")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    found = [pieces.encode_pieces(none, model), pieces.decode_pieces(pieces.encode_pieces(none, model), model), language.identify(none, F.lit(True)), toxicity.score_toxicity(none, labels, F.lit(True))]
    spans = chunk_dedup.repeated_spans(none)
    found += [spans, chunk_dedup.cut_spans(none, spans), pii.mask_pii(none), *(stage(spark, none, "") for _, stage in corpus_pipeline.STAGES)]
    assert [f.count() for f in found] == [0] * len(found)


def test_samples_do_not_end_at_any_size():
    for n in (10**10, 10**13):
        assert 0.99 < common.draws(500 / n) / 2**62 * n / 500 < 1.01
    assert common.draws(2.0) == 2**62


def test_training_reads_windows_of_long_texts(spark):
    df = spark.createDataFrame([("ab" * 30_000,), ("short",), ("",)], "text string")
    got = [r[0] for r in df.select(common.training_window()).collect()]
    assert got[1:] == ["short", ""] and len(got[0]) == common.TRAIN_CHARS and set(got[0]) == {"a", "b"}


def test_letters_decide_on_a_language(spark):
    rows = [(i, "the and of that " * 3, "en") for i in range(20)] + [(100, "²½ Ⅷ ① 12", None), (101, "x² the", None)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True)).collect()}
    assert (got[100].lang_pred, got[100].score) == ("und", 0) and got[101].lang_pred == "en"


def test_near_dedup_equals_brute_force(spark, docs, rows):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    extra = []
    for i in range(60):  # copies with more and more edits: links, chains and strangers
        copy = list(base)
        for _ in range(i // 4):
            copy[rng.randrange(len(copy))] = f"e{i}x{rng.randrange(9)}"
        extra.append((100 + i, " ".join(copy)))
    every = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    got = {(r.doc_id): (r.n_shingles, r.component_id) for r in near_dedup.near_groups(every, shingle=2).collect()}
    sets = {}
    for i, t in [(r[0], r[1]) for r in rows] + extra:
        w = (t or "").lower().split()
        sets[i] = {tuple(w)} if len(w) == 1 else set(zip(w, w[1:], strict=False))
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {i: got[i] for i in ids} == {i: (len(sets[i]), find(i)) for i in ids}
    assert got[None][1] is None
    assert near_dedup.near_groups(docs.limit(0)).count() == 0


def test_near_dedup_of_edited_copies_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(70)]
    texts = []
    for i in range(90):
        words = list(base)
        for at in rng.choice(len(base), int(rng.integers(1, 9)), replace=False):
            words[at] = f"e{rng.integers(40)}"
        texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 2]) for i in range(len(w) - 1)} for w in map(str.split, texts)]
    root = list(range(len(sets)))
    for x in range(len(sets)):
        for y in range(x):
            if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]) and root[x] != root[y]:
                lo, hi = sorted((root[x], root[y]))
                root = [lo if r == hi else r for r in root]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(table, shingle=2, star_rounds=1).collect()}
    assert got == dict(enumerate(root))
    assert 1 < len(set(root)) < len(root)


def test_near_dedup_of_rows_that_share_an_id(spark):
    rng = random.Random(6)
    pick = lambda: [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(9)) for _ in range(60)]
    a, b, c = pick(), pick(), pick()
    rows = [(1, a), (1, b), (2, [*a, "end"]), (3, [*b, "end"]), (4, c), (5, [*c, "end"]), (5, None), (6, pick()), (6, pick())]
    rows = [(i, w and " ".join(w)) for i, w in rows]
    want = Counter([(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 5), (6, 6), (6, 6)])
    for order in (rows, rows[::-1], [rows[1], rows[0], *rows[2:]]):
        table = spark.createDataFrame(order, "doc_id bigint, text string").repartition(3)
        assert Counter((r.doc_id, r.component_id) for r in near_dedup.near_groups(table, shingle=2).collect()) == want


def test_components(spark):
    from idloom.llm.components import components

    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    edges += [(5, 5), (None, 3)]
    root = {x: x for e in edges if None not in e for x in e}
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect())
    assert {x: got.get(x, x) for x in root} == {x: find(x) for x in root}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_segment_ids_equal_the_library(name):
    from array import array

    from tokenizers import Tokenizer

    rng = random.Random(2)
    parts = ["the", "An", " ", "  ", "\n", ",", ".", "é", "É", "é", "日", "1", "²", "'s", "'", "_", "\t", "$$$", "İ", "Σ", "<|endoftext|>", "ſ", "ª", "ẞ", "\u1c89", "ñdo.\nAl.", "\x1c", "\xa0", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    enc, lib = Encoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    assert [array(enc.code, x).tolist() for x in enc.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_equal_the_library(spark, docs, rows):
    from array import array

    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=path), pieces.codec(path)
    rng = random.Random(5)
    texts = ["".join(rng.choice(["the", "an", " ", "  ", "é", "日", "\n", "er", "H", "1", " " * 20, "😀"]) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    for t in [*texts, *(r[1] or "" for r in rows)]:
        ids = codec.encode([t])[0]
        assert array(codec.code, ids).tolist() == lib.encode(t) and codec.decode(ids) == t
    back = pieces.decode_pieces(pieces.encode_pieces(docs, path), path)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r[0], r[1] or "") for r in rows)
    stream, whole, widest = pieces.StreamingViterbi(codec.pieces), [], 0
    for i in range(0, 3000, 7):
        whole += stream.feed(("theation" * 400)[i : i + 7])
        widest = max(widest, len(stream.window))
    whole += stream.finish()
    assert widest <= 4 * codec.pieces.longest and "".join(lib.id_to_piece(whole)) == ("theation" * 400)[:3003]


def test_packing(docs, rows):
    got = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), 2, size=64).collect()
    by_seq, total = {}, 0
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
        assert len(r.ids) == 4 * r.length
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by_seq) <= -(-total // 64) + 2 and sum(r.piece == 0 for r in got) == len(rows)
    assert packing.plan({}, 64) == [] and packing.pack(docs.limit(0), tokenizer_path("byte_bpe_50k.json"), 2).count() == 0
    assert packing.plan({40: 1, 13: 1, 20: 1, 4: 1}, 64) == [(1, [40, 20, 4]), (1, [13])]


def test_token_files(spark, docs, rows, tmp_path):
    for n, u in ((0, 1), (1, 5), (700, 10), (900, 2**40), (3, 2**63 - 1)):
        v = np.sort(np.random.default_rng(n).integers(0, u, n)).astype(np.uint64)
        e = eliasfano.EliasFano(eliasfano.encode(v))
        assert (e.select_many(np.arange(n)) == v).all() and all(e.select(i) == int(v[i]) for i in range(0, n, 13))
    path, name = str(tmp_path / "t"), tokenizer_path("word_bpe_49k.json")
    token_files.write_token_files(docs, path, name, 2, shard_size=300)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    shard = token_files.Shard(spark.read.parquet(path).first().payload)
    assert [shard.doc_id(k) for k in range(len(shard))] == shard.doc_ids() and len(shard.document(0)) >= 1


def test_language(spark):
    words = {"en": "the and of that with this".split(), "de": "und der die nicht mit ein".split(), "fr": "le les une pour avec dans".split()}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(3, 60))), k) for i, k in enumerate(rng.choice(list(words)) for _ in range(300))]
    rows += [(900, None, "en"), (901, "", None), (902, "12 !!", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language.identify(docs, common.id_bucket() != 2).collect()}
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (900, 901, 902))
    assert np.mean([got[i].lang_pred == k for i, _, k in rows[:300]]) > 0.97
    none = language.identify(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_toxicity(spark):
    rng = random.Random(1)
    clean = [" ".join(rng.choice("alpha beta gamma delta you".split()) for _ in range(40)) for _ in range(500)]
    texts = [(i, t + " " + rng.choice("jerkface dumbo".split()) * (i % 4 == 0) + " end") for i, t in enumerate(clean)]
    docs = spark.createDataFrame([*texts, (900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 5, int(i % 4 == 0)) for i, _ in texts], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels, common.id_bucket() != 2).collect()}
    assert len(got) == 502 and np.mean([got[i].predicted == (i % 4 == 0) for i, _ in texts]) > 0.97 and got[900].predicted == 0
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0), F.lit(True)).collect()} == {0.0}
    at, to = boosting.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert (np.diff(to) >= 0).all() and (np.diff(at) >= 0).all()


def test_toxicity_lexicon_reads_whole_texts():
    head = "A header of more than forty characters stands before every text of this source. "
    bad = [f"{head}note {i} {w}" for i, w in enumerate(["jerkface", "dumbo"] * 4)]
    fine = [f"{head}note {i} plain" for i in range(40)]
    copies = [f"{c} blether" for c in ("Once more", "ONCE MORE", "once MORE", "once more") for _ in range(3)]
    texts = [*bad, *fine, *copies]
    lexicon = toxicity.learn_lexicon(texts, np.array([1] * 8 + [0] * 40 + [1] * 12))
    assert set(lexicon.words) == {"jerkface", "dumbo"}


def test_pii(docs, spark):
    fixed = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def plain(t):
        out = []
        for kind, pattern in fixed.items():
            for m in re.finditer(pattern, t):
                digits = re.sub("[^0-9]", "", m[0])
                ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "phone" and 9 <= len(digits) <= 15 or kind == "card" and 13 <= len(digits) <= 19 and pii.luhn(digits)
                if ok:
                    out.append((kind, *m.span()))
        return out

    rng = random.Random(3)
    for _ in range(5000):
        t = "".join(rng.choice("a@.1+- 25(") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == plain(t), t
    df = spark.createDataFrame([(1, "mail é a.b@c.de now", 19), (2, None, 0), (3, "x", 1)], "doc_id bigint, text string, n_chars bigint")
    assert [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in pii.find_pii(df).orderBy("doc_id").collect()] == [(1, [("email", 7, 15)]), (2, []), (3, [])]
    assert [tuple(r) for r in pii.mask_pii(df).orderBy("doc_id").collect()] == [(1, "mail é <EMAIL> now", 18), (2, None, 0), (3, "x", 1)]
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_chunks(spark, docs):
    data = np.random.default_rng(1).integers(1, 255, 3000).astype(np.uint8)
    h, plain = 0, []
    for b in data.tolist():
        h = (2 * h + int(chunk_dedup.GEAR[b])) % (1 << 32)
        plain.append(h)
    assert chunk_dedup.gear_hashes(data).tolist() == plain
    texts = [b"", data.tobytes(), b"a" * 5000, data[100:].tobytes()]
    ends = chunk_dedup.boundaries(texts)
    assert all(chunk_dedup.boundaries([t]) == [e] and e[-1:] == ([len(t)] if t else []) for t, e in zip(texts, ends, strict=True))
    assert len({e - 100 for e in ends[1]} & set(ends[3])) > 0.8 * len(ends[3])  # boundaries move with the text
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    made = [(i, " ".join(word() for _ in range(50)) + " " + passage * (i % 3 == 0) + " " + " ".join(word() for _ in range(40))) for i in range(30)]
    df = spark.createDataFrame([*made, (90, None), (None, passage)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in chunk_dedup.repeated_spans(df).collect()}
    assert set(got) == {i for i in range(3, 30, 3)} and all(0 in r.source_ids for r in got.values())
    cut = {r.doc_id: r.text for r in chunk_dedup.cut_spans(df, chunk_dedup.repeated_spans(df)).where("doc_id is not null").collect()}
    assert all(len(cut[i]) < len(t) - 150 if i in got else cut[i] == t for i, t in made)


def test_chunks_catch_every_passage_of_51_words(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    pick = lambda n: " ".join(rng.choice(words) for _ in range(n))
    made = []
    for i in range(500):
        passage = pick(51)
        made += [(2 * i, f"{pick(40)} {passage} {pick(40)}"), (2 * i + 1, f"{pick(40)} {passage} {pick(40)}")]
    got = {r.doc_id: r.source_ids for r in chunk_dedup.repeated_spans(spark.createDataFrame(made, "doc_id bigint, text string")).collect()}
    assert got == {2 * i + 1: [2 * i] for i in range(500)}
    ends = chunk_dedup.boundaries([("a line of words " * 300).encode(), b"ab" * 3000])
    assert all(len(set(np.diff(e[1:-1]).tolist())) == 1 for e in ends)  # text in periods is cut in step with them


def test_chunks_end_between_characters(spark):
    rng = random.Random(4)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) + " " * (rng.random() < 0.2) for _ in range(n))
    passage = han(400)
    rows = [(1, han(50) + passage), (2, han(80) + passage + han(20)), (2, passage + han(30)), (3, "é" * 3000), (4, "😀" * 700 + passage), (4, "😀" * 700 + passage)]
    for text in (t.encode() for _, t in rows):
        assert all(text[e] & 0xC0 != 0x80 for e in chunk_dedup.boundaries([text])[0] if e < len(text))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans = chunk_dedup.repeated_spans(df)
    cut = Counter((r.doc_id, r.text) for r in chunk_dedup.cut_spans(df, spans).collect())
    found = {(r.doc_id, r.text_key): r.spans for r in spans.collect()}
    keys = {(r.doc_id, r.text): r.k for r in df.select("doc_id", "text", F.xxhash64("text").alias("k")).collect()}
    want = Counter()
    for i, t in rows:
        raw, out, at = t.encode(), b"", 0
        for s in found.get((i, keys[i, t]), []):
            out, at = out + raw[at : s.start], s.end
        want[i, (out + raw[at:]).decode()] += 1
    assert cut == want and sum(n for (i, t), n in cut.items() if (i, t) in rows) <= 2  # all but the first, or its own repeats


def test_span_classifier_accepts_and_refuses(spark):
    rng = random.Random(9)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    made = []
    for i in range(300):
        made += [f"write a mail to name{i}@site{i}.com or call the phone +44 {digits(4)} {digits(6)} now", f"the host ip address 10.{i % 250}.7.{i % 99} is up"]
    made += [f"my mail is person{i} [at] site{i} [dot] org today" for i in range(40)] + [f"her phone is 00{i % 9 + 1}{digits(2)} {digits(3)} {digits(4)} today" for i in range(40)]
    made += [f"the invoice number {digits(4)}-{digits(4)}-{digits(5)} of the order" for i in range(40)]
    found = pii.find_pii(spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")).collect()
    loose = Counter((s.kind, (r.doc_id - 600) // 40) for r in found if r.doc_id >= 600 for s in r.spans if not s.base)
    assert loose["email", 0] == 40 and loose["phone", 1] == 40 and not any(k == "card" for k, _ in loose)
    long = "x" * 100 + " [at] site [dot] com"
    assert list(pii.loose_spans(long, [])) == [("email", 0, len(long))]
    assert not list(pii.loose_spans("1 2 3 4 5 6 7 8 9 10 11", [("card", 0, 22), *(("ip", i, i + 1) for i in range(1, 9))]))


def test_shard_holds_any_ids():
    ids = [None, -(2**63), -5, 2**63 - 1]
    shard = token_files.Shard(token_files.shard_bytes(ids, [b"\1\0"] * 4, 2))
    assert shard.doc_ids() == [shard.doc_id(k) for k in range(4)] == ids


def test_quality(docs, rows):
    got = quality.judge(docs).collect()
    for r, (_, text, *_rest) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id, r.n_words)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        w = (text or "").split()
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(cover))
        lines = [x for x in (text or "").split("\n") if x.strip()]
        assert (r.n_symbols, r.n_dup_lines) == (sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert weak.fit({}, 3).posterior((-1, -1, -1)) < 0.5 < weak.fit({}, 3).posterior((1, 1, 1))
    assert quality.judge(docs.limit(0)).count() == 0


def test_exact_dedup_locates_only_tables_as_read(spark, tmp_path):
    """A table as read is not copied; what is filtered, limited in its columns or partitioned is judged as it stands."""
    from idloom.llm.exact_dedup import _source, drop_exact_duplicates

    rows = [(1, "Same", "a"), (2, "same", "a"), (3, "SAME", "b"), (4, None, "a"), (5, "", "b"), (6, "other", "b")]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, part string")
    plain, parted = str(tmp_path / "plain"), str(tmp_path / "parted")
    made.repartition(3).write.parquet(plain)
    made.write.partitionBy("part").parquet(parted)
    read = spark.read.parquet(plain)
    kept = lambda df: sorted(r.doc_id for r in drop_exact_duplicates(df).collect())
    assert _source(read) and kept(read) == [3, 5, 6]
    for df in (read.where("doc_id < 3 or doc_id = 4"), read.select("text", "doc_id"), read.withColumn("text", F.lit("x")), spark.read.parquet(parted), made):
        assert _source(df) is None
    assert kept(read.where("doc_id < 3 or doc_id = 4")) == [2, 4]
    assert kept(spark.read.parquet(parted)) == kept(made) == [3, 5, 6]
    assert kept(read.withColumn("text", F.lit("x"))) == [6]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") in ("false", False)


def test_drop_near_duplicates_keeps_the_least_id(spark):
    from idloom.llm.near_dedup import drop_near_duplicates

    base = [f"word{i}" for i in range(60)]
    rows = [(7, " ".join(base), 0), (3, " ".join([*base[:-1], "end"]), 1), (9, "quite another text that shares nothing at all", 2), (None, " ".join(base), 3), (5, None, 4), (3, " ".join(base), 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int")
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r.component_id for r in out.collect()) == [1, 2, 3, 4, 5]
    assert drop_near_duplicates(docs.limit(0)).count() == 0


def test_exact_dedup_does_not_count_files_that_have_gone(spark, tmp_path):
    path, state = tmp_path / "documents.parquet", str(tmp_path / "state")
    write = lambda rows, part: spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("overwrite").parquet(f"{path}/{part}")
    decided = lambda: sorted(tuple(r)[:4] for r in exact_dedup.exact_duplicates(spark, str(path), checkpoint=state).collect())
    write([(1, "a"), (4, "b")], "part=x")
    write([(2, "a")], "part=y")
    assert decided() == [(1, 2, 2, False), (2, 2, 2, True), (4, 4, 1, True)]
    shutil.rmtree(path / "part=y")
    assert decided() == [(1, 1, 1, True), (4, 4, 1, True)]
    write([(3, "b")], "part=z")  # as many rows as have gone
    assert decided() == [(1, 1, 1, True), (3, 4, 2, False), (4, 4, 2, True)]


def test_span_sample_is_of_different_candidates(spark, monkeypatch):
    monkeypatch.setattr(pii, "TRAIN_CANDIDATES", 300)
    seen = []
    plain = pii.train
    monkeypatch.setattr(pii, "train", lambda x, y, n: seen.append((x, n)) or plain(x, y, n))
    row = lambda i: ("card", [1, 1, 0, 1, 1], [float(i)] * pii.FEATURES)
    pii._fit(spark.createDataFrame([row(0)] * 600 + [row(i) for i in range(1, 201)], "kind string, votes array<int>, features array<double>"))
    x, n = seen[0]
    assert len(x) == len(np.unique(x, axis=0)) == 201 and n.max() == 600 and n.sum() == 800


def test_release_deletes_what_a_table_reads(spark):
    df = common.saved(spark.range(5), "some-rows").join(common.saved(spark.range(3), "others"), "id")
    files = [f.removeprefix("file:").replace("//", "/") for f in df.inputFiles()]
    assert all(os.path.exists(f) for f in files)
    common.release(df)
    assert not any(os.path.exists(f) for f in files)
    common.release(spark.range(1))


def test_clearing_in_two_threads(spark):
    """One operator's end leaves another's tables, and the session's setting, alone."""
    first_saved, second_done, out = threading.Event(), threading.Event(), {}
    before = spark.conf.get(common._TIDY, None)

    def slow():
        with common.clearing(spark):
            kept = common.saved(spark.range(7), "slow")
            first_saved.set()
            second_done.wait(60)
            out["rows"], out["tidy"] = kept.count(), spark.conf.get(common._TIDY)

    thread = threading.Thread(target=slow)
    thread.start()
    first_saved.wait(60)
    with common.clearing(spark):
        common.saved(spark.range(2), "quick").count()
    second_done.set()
    thread.join()
    assert out == {"rows": 7, "tidy": "true"} and spark.conf.get(common._TIDY, None) == before


def test_languages_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    rows = [(i, "the word " * 9, "en") for i in range(20)] + [(50 + i, "das wort " * 9, "de") for i in range(15)] + [(90 + i, "dirt", f"x{i}") for i in range(9)]
    texts, labels = language.training_rows(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    assert set(labels) == {"en", "de"} and len(texts) == 35
