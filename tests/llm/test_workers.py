"""What workers keep and how many files they write."""

import os

import pyarrow as pa
import pytest

from idloom.llm import common, near_dedup, tokens
from idloom.llm.components import components


@pytest.fixture
def many_partitions(spark):
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _files(spark, monkeypatch, run):
    """Part files of each scratch table that run() writes, by its name."""
    folder, found = common._shared_folder(spark).removeprefix("file:"), {}
    monkeypatch.setattr(common, "discard", lambda *_: None)
    before = set(os.listdir(folder))
    run()
    for table in set(os.listdir(folder)) - before:
        n = sum(f.endswith(".parquet") for f in os.listdir(f"{folder}/{table}"))
        found[table[:-33]] = max(n, found.get(table[:-33], 0))
    return found


def test_small_tables_are_few_files(spark, monkeypatch, many_partitions):
    cores = spark.sparkContext.defaultParallelism
    edges = spark.createDataFrame([(i, i + 1) for i in range(300) if i % 30], "a bigint, b bigint")
    found = _files(spark, monkeypatch, lambda: components(edges).collect())
    assert max(found[t] for t in ("low", "kept", "least")) <= cores

    words = [[f"w{k}x{i}" for i in range(60)] for k in range(40)]
    texts = [" ".join(w if j != 10 * c else "other" for j, w in enumerate(ws)) for ws in words for c in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = []
    found = _files(spark, monkeypatch, lambda: got.extend(near_dedup.near_groups(docs).collect()))
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 4 for i in range(160)}
    assert max(found[t] for t in ("classes", "shared", "open-keys", "centres", "weights", "roots", "components")) <= cores


def test_rows_beyond_a_task(spark, monkeypatch, many_partitions):
    """A table of more rows is dealt over more tasks, and none goes."""
    monkeypatch.setattr(common, "TASK_ROWS", 100)
    df = spark.range(1000).selectExpr("7 * id AS k").groupBy("k").count()
    found = common.saved(df, "counts", most=1000)
    assert found.count() == 1000 and len(found.inputFiles()) == 10


def test_a_worker_keeps_one_kind(spark):
    path = tokens.tokenizer_path("byte_bpe_50k.json")

    def encode(batches):
        for b in batches:
            tokens.encoder(path).encode(["some words"])
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(common.kept("tokens"))], pa.int64())})

    def look(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(common.kept("tokens"))], pa.int64())})

    rows = spark.range(0, 8, 1, 4)
    assert {r.n for r in common.map_arrow(rows, encode, "n bigint", "tokens").collect()} == {1}
    assert {r.n for r in common.map_arrow(rows, look, "n bigint").collect()} == {0}
