"""Each query over a table that holds one text of 10 MB among small ones."""

import random

import pytest

from idloom.llm.queries import QUERIES

SMALL = 24


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d, rng = str(tmp_path_factory.mktemp("long")), random.Random(1)
    words = {"en": "the and of that with this from have".split(), "de": "und der die nicht mit ein auch wenn".split()}
    text = lambda k, n: " ".join(rng.choice(words[k]) + rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, text(k, 80), k, "s", 0) for i, k in zip(range(SMALL), ["en", "de"] * SMALL, strict=False)]
    long = "\n".join(text("en", 400) for _ in range(40))
    long = (long + " mail a.b@c.de from 10.1.2.3 neighbour ") * (10_500_000 // len(long))
    assert len(long) > 10_000_000
    spark.createDataFrame([*rows, (100, long, "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(SMALL)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.mark.parametrize("name", [n for n in QUERIES if "documents" not in n and n != "op12_embedding_whitening"])
def test_long_text(spark, folder, name):
    rows = QUERIES[name](spark, folder).collect()
    if name.startswith("op13_"):
        assert [(r.word, r.n > 100) for r in rows] == [("neighbour", True)]
    elif name.startswith("op7_"):
        assert {r.doc_id for r in rows} == {100} and rows[0].cut_bytes > 9_000_000  # one page, many times
    else:
        assert {r.doc_id for r in rows} == {*range(SMALL), 100}
    mine = [r for r in rows if getattr(r, "doc_id", None) == 100]
    if name.startswith(("op5_", "op11_")):
        assert sum(r.length for r in mine) > 1_000_000
    elif name.startswith("op6_"):
        assert mine[0].n_email == mine[0].n_ip > 20
    elif name.startswith("op9_"):
        assert mine[0].n_words > 1_000_000 and mine[0].base_failed
