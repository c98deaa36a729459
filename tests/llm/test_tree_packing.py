"""First-fit decreasing packing: the tree against a plain search, pieces against the library, edge rows."""

import random
import struct
import zlib

from idloom.llm import tree_packing
from idloom.llm.queries import QUERIES
from idloom.llm.tokens import tokenizer_path


def test_tree_finds_the_first_bin_with_room():
    rng = random.Random(1)
    for capacity in (1, 16, 64):
        for n in (1, 2, 7, 300):
            sizes = sorted((rng.randint(1, capacity) for _ in range(n)), reverse=True)
            plain: list[list[int]] = []
            for i, s in enumerate(sizes):
                found = next((b for b in plain if sum(sizes[x] for x in b) + s <= capacity), None)
                if found is None:
                    plain.append(found := [])
                found.append(i)
            bins = tree_packing.first_fit_decreasing(sizes, capacity)
            assert bins == plain
            for seq in (closed := tree_packing.close_gaps(sizes, bins, capacity)):
                total = sum(b - a for _, a, b in seq)
                assert total == capacity or total & (total - 1) == 0
            assert sorted((i, x) for seq in closed for i, a, b in seq for x in range(a, b)) == [(i, x) for i, s in enumerate(sizes) for x in range(s)]
            assert sum(sum(b - a for _, a, b in seq) == capacity for seq in closed) == sum(sizes) // capacity


def check_pieces(rows, texts, size=2048):
    """Every id in one piece, sequences without gaps and without padding."""
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode
    want = []
    for doc, text in texts:
        ids = encode(text or "", add_special_tokens=False).ids + [1]
        want.append((-1 if doc is None else doc, len(ids), ids))
    want.sort()
    got, sequences = {}, {}
    for r in rows:
        got.setdefault(-1 if r.doc_id is None else r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size and at & (at - 1) == 0
    for doc in {d for d, *_ in want}:
        mine = [w for w in want if w[0] == doc]
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.pop(doc))
        assert sum(p[1] for p in pieces) == sum(n for _, n, _ in mine)
        if len({tuple(i) for *_, i in mine}) == 1:  # one text, perhaps repeated
            ids = mine[0][2]
            assert all(crc == zlib.crc32(struct.pack(f"<{n}I", *ids[s : s + n])) and total == len(ids) for s, n, crc, total in pieces)
        if len(mine) == 1:
            assert [p[0] for p in pieces] == [sum(p[1] for p in pieces[:k]) for k in range(len(pieces))]
    assert not got


def test_first_fit_packing(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: rng.choice(["stone", "river", "Übung", "naïve", "12,5", "(x)", "longerword"])
    texts = [(i, " ".join(word() for _ in range(rng.choice([1, 5, 60, 900, 2500])))) for i in range(120)]
    texts += [(200, None), (201, ""), (202, "same text " * 50), (202, "same text " * 50), (203, "same text " * 50), (None, "lost one"), (204, "x " * 2047), (205, "x " * 2046 + "\n")]
    rows = [(d, t, "a", 1, b"i", 5) for d, t in texts]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, uid int, length binary, sequence_id int")
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    check_pieces(QUERIES["op11_first_fit_packing"](spark, str(tmp_path)).collect(), texts)
    few = tree_packing.pack_first_fit(docs, tokenizer_path("word_bpe_49k.json"), 1, group=8)
    assert len({r.sequence_id for r in few.collect()}) > len(texts) / 8
    assert tree_packing.pack_first_fit(docs.limit(0), tokenizer_path("word_bpe_49k.json"), 1).collect() == []


def test_a_very_long_text_is_cut_into_whole_sequences(spark):
    text = "alpha beta gamma delta " * 420_000  # 10 MB
    rows = tree_packing.pack_first_fit(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), tokenizer_path("word_bpe_49k.json"), 1).collect()
    total = rows[0].doc_tokens
    assert sum(r.length for r in rows) == total > 1_000_000 and sum(r.length < 2048 for r in rows) == bin(total % 2048).count("1")
    assert b"".join(r.ids for r in sorted(rows, key=lambda r: r.start))[-4:] == struct.pack("<I", 1)
