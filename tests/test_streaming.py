"""Votes over frames: buckets against a plain fold, streams against tables for any order of arrival."""

import random

import pytest
from pyspark.sql import functions as F

from idloom.sources import io
from idloom.streaming import stability

SF = "/root/testdata/sf0.001"
T0 = 1_700_000_000_000
PAIR = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"


def _camera(spark, rows):
    schema = "session_id bigint, ms bigint, frame_id bigint, feedback string, mrz_text string"
    df = spark.createDataFrame([(1, T0 + t, i, f, z) for i, (t, f, z) in enumerate(rows)], schema)
    return df.select("session_id", F.timestamp_millis("ms").alias("ts"), "frame_id", "feedback", "mrz_text")


def test_scan_samples_gates_and_votes(spark):
    start = -T0 % 900  # the first tick's beginning
    rows = [(start, None, PAIR), (start + 800, None, "no zone"), (start + 900, None, PAIR), (start + 1000, "glare_strong", None), (start + 1900, None, PAIR), (start + 2600, "ok", None), (start + 2800, None, PAIR), (start + 3700, None, PAIR)]
    # Tick 0 reads its last frame, which has no zone; tick 2 is gated; ticks 1 and 3 make the document stable; tick 4 begins anew.
    got = stability.scan_frames(_camera(spark, rows), 2026).collect()
    assert [(r.frame_id, r.stable_key) for r in got] == [(6, "Ерикссон|Анна|12.08.1974")]


def test_votes(spark):
    frames = spark.createDataFrame([(1, i, k) for i, k in enumerate("ABAB")], "s bigint, i bigint, k string")
    got = {r.i: r.stable_key for r in stability.stability_vote(frames, "s", ["i"], "k").collect()}
    assert got == {0: None, 1: None, 2: "A", 3: "A"}
    assert [(r.frame_id, r.stable_key) for r in stability.stable_frames(frames, "s", ["i"], "i", "k").collect()] == [(2, "A")]


def plain_votes(keys, required):
    out, history = [], []
    for i, k in enumerate(keys):
        history = [*history, k][-2 * required :]
        found = [x for x in history if history.count(x) >= required]
        if found:
            out.append((i, found[0]))
            history = []
    return out


@pytest.mark.parametrize("required", [1, 2, 3])
@pytest.mark.parametrize("bucket", [1.0, 2.0, 7.0, 1000.0])
def test_buckets_do_not_change_the_vote(spark, required, bucket):
    rng = random.Random(required)
    keys = {s: [rng.choice("AABC"[: 1 + s % 4] + "D") for _ in range(rng.choice([1, 3, 40, 120]))] for s in range(12)}
    frames = spark.createDataFrame([(s, i, k) for s, ks in keys.items() for i, k in enumerate(ks)], "s bigint, i bigint, k string").repartition(5)
    got = {(r.session_id, r.frame_id, r.stable_key) for r in stability.stable_frames(frames, "s", ["i"], "i", "k", required, bucket).collect()}
    assert got == {(s, i, k) for s, ks in keys.items() for i, k in plain_votes(ks, required)} and got


def test_a_long_session_spreads_over_tasks(spark):
    """One session of 300,000 frames: buckets are folded apart, and the result is that of one fold."""
    frames = spark.range(300_000).select(F.lit(1).alias("s"), "id", F.concat(F.lit("k"), (F.xxhash64("id") % 3).cast("string")).alias("k"))
    got = stability.stable_frames(frames, "s", ["id"], "id", "k", bucket=1000.0)
    keys = [r.k for r in frames.orderBy("id").collect()]
    assert sorted((r.frame_id, r.stable_key) for r in got.collect()) == plain_votes(keys, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan


def test_gate_carries_feedback_over_buckets(spark):
    rng = random.Random(9)
    looks = sorted((rng.randrange(3), T0 + rng.randrange(4_000_000), i, rng.choice(["ok", "glare_strong", "glare_mild"])) for i in range(60))
    shots = [(rng.randrange(4), T0 + rng.randrange(4_000_000), i) for i in range(200)] + [(looks[0][0], looks[0][1], 900)]  # one at the time of a feedback
    told = spark.createDataFrame([(s, t, f) for s, t, _, f in looks], "session_id bigint, ms bigint, feedback string").select("session_id", F.timestamp_millis("ms").alias("ts"), "feedback")
    frames = spark.createDataFrame(shots, "session_id bigint, ms bigint, frame_id bigint").select("session_id", F.timestamp_millis("ms").alias("ts"), "frame_id")
    want = set()
    for s, t, i in shots:
        before = [f for a, b, _, f in sorted(looks, key=lambda x: x[1]) if a == s and b <= t]
        if not before or before[-1] != "glare_strong":
            want.add((s, i, before[-1] if before else "ok"))
    for bucket in (1.0, 60.0, 1e6):
        assert {(r.session_id, r.frame_id, r.feedback) for r in stability.frame_gate(frames, told, bucket).collect()} == want


def _written(frames, path, rng, parts, spread):
    """frames in files that arrive one by one, each row up to `spread` parts late."""
    rows = frames.orderBy("ts").collect()
    size = len(rows) / parts
    late = [[] for _ in range(parts + spread)]
    for k, r in enumerate(rows):
        late[int(k / size) + rng.randint(0, spread)].append(r)
    for part in late:
        rng.shuffle(part)
        if part:
            frames.sparkSession.createDataFrame(part, frames.schema).coalesce(1).write.mode("append").parquet(path)


def _streamed(spark, query, name):
    query.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.table(name).where("session_id >= 0").collect())


def _push_watermark(frames, path, *hours):
    for h in hours:
        far = frames.limit(1).withColumn("session_id", F.lit(-1).cast("long")).withColumn("ts", F.col("ts") + F.expr(f"interval {h} hours"))
        far.coalesce(1).write.mode("append").parquet(path)


def test_stream_of_votes_equals_table_for_any_arrival(spark, tmp_path):
    rng, path = random.Random(4), str(tmp_path / "in")
    rows = [(rng.randrange(4), T0 + 1000 * i + rng.randrange(900), i, rng.choice(["A", "B", None])) for i in range(300)]
    frames = spark.createDataFrame(rows, "session_id bigint, ms bigint, frame_id bigint, key string").select("session_id", F.timestamp_millis("ms").alias("ts"), "frame_id", "key")
    _written(frames, path, rng, 8, 2)
    _push_watermark(frames, path, 5, 6)
    got = _streamed(spark, stability.stable_stream(io.read_frames_stream(spark, path, 1, "session_id bigint, ts timestamp, frame_id bigint, key string"), late="5 minutes", ttl="1 hour"), "voted")
    want = stability.stable_frames(frames, "session_id", ["ts", "frame_id"], "frame_id", "key")
    assert got == sorted(tuple(r) for r in want.collect()) and len(got) > 40


def test_stream_scan_equals_table_for_any_arrival(spark, tmp_path):
    """Rows shuffled within the watermark: feedback, ticks and votes are in the order of their times all the same."""
    rng, path = random.Random(5), str(tmp_path / "in")
    rows = [(450 * i, rng.choice(["ok", "glare_strong"]), None) if i % 4 == 0 else (450 * i, None, PAIR if rng.random() < 0.8 else "") for i in range(400)]
    frames = _camera(spark, rows)
    frames = frames.union(frames.withColumn("session_id", F.lit(2).cast("long")).withColumn("frame_id", F.col("frame_id") + 5000))
    _written(frames, path, rng, 8, 2)
    _push_watermark(frames, path, 5)
    late = frames.where("frame_id < 40").withColumn("frame_id", F.col("frame_id") + 1000)  # later than the watermark
    late.coalesce(1).write.mode("append").parquet(path)
    _push_watermark(frames, path, 6)
    got = _streamed(spark, stability.stream_scan(io.read_frames_stream(spark, path, files_per_batch=1), 2026, late="2 minutes", ttl="1 hour"), "scanned")
    assert got == sorted(tuple(r) for r in stability.scan_frames(frames, 2026).collect()) and len(got) > 40


def test_feedback_that_comes_late_counts_at_its_own_time(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(5000, "ok", None), (5100, None, PAIR), (1000, "glare_strong", None), (6000, None, PAIR), (7000, None, PAIR)]
    frames = _camera(spark, rows)
    for i in range(len(rows)):  # in this order
        frames.where(f"frame_id = {i}").coalesce(1).write.mode("append").parquet(path)
    _push_watermark(frames, path, 1, 2)
    got = _streamed(spark, stability.stream_scan(io.read_frames_stream(spark, path, files_per_batch=1), 2026), "late_feedback")
    assert got == [(1, 3, "Ерикссон|Анна|12.08.1974")] == [tuple(r) for r in stability.scan_frames(frames, 2026).collect()]


def test_a_pause_starts_a_session_anew(spark, tmp_path):
    path = str(tmp_path / "in")
    frames = _camera(spark, [(0, "glare_strong", None), (3_000, "ok", None), (4_000, None, PAIR), (1_200_000, None, PAIR), (1_202_000, None, PAIR)])
    frames.coalesce(1).write.parquet(path)
    _push_watermark(frames, path, 1, 2)
    got = _streamed(spark, stability.stream_scan(io.read_frames_stream(spark, path, files_per_batch=1), 2026, ttl="10 minutes"), "paused")
    assert got == [(1, 4, "Ерикссон|Анна|12.08.1974")]  # without the pause frame 3 would be the second
