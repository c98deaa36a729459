"""Votes over camera frames: a reading is stable once its key came up often enough among the last few.

A session may be long, so nothing here needs a session in one task. Time is cut into buckets; what a bucket does to
the rows after it is a small value (the last feedback; for the vote, a function on the few states that a vote can be in), and
only those values are carried along a session. In a stream rows wait until the watermark has passed them and are then
taken in the order of their times, whatever the order in which they came.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from idloom.functions.mrz import parse_mrz
from idloom.operators.merge import merged
from idloom.session import checkpointed, prepare

OCR_TICK, FEEDBACK_TICK = "900 milliseconds", "200 milliseconds"
#: Seconds of a session that are folded together: at 30 frames a second 108,000 rows, one after the other.
BUCKET = 3600.0


def document_key(doc: Column) -> Column:
    return F.concat_ws("|", doc["surname"], doc["name"], doc["dateOfBirth"])


def stability_vote(df: DataFrame, session: str, order: list[str], key: str, required: int = 2) -> DataFrame:
    """df with stable and stable_key, never starting over.

    The last 2 * required keys of the session are looked at; of keys that come up `required` times the one first
    in that window counts. A window of a few rows: nothing is gathered beyond it.
    """
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(-(2 * required - 1), 0)
    recent = F.collect_list(F.coalesce(F.col(key), F.lit(""))).over(w)
    often = F.get(F.filter("_recent", lambda k: F.size(F.filter("_recent", lambda x: x == k)) >= required), F.lit(0))
    return df.withColumn("_recent", recent).withColumn("stable_key", often).withColumn("stable", F.col("stable_key").isNotNull()).drop("_recent")


def _in_order(df: DataFrame, by: list[str], order: list[str], fold: Callable[[Iterator[tuple]], Iterator[tuple]], types: pa.Schema, ddl: str) -> DataFrame:
    """fold over the rows of df as tuples, all rows of equal `by` in one task and one after the other, in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        for row in fold(rows):
            out.append(row)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.types, strict=True)], schema=types)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.types, strict=True)], schema=types)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, ddl)


def _votes(required: int) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    """Over (session, bucket, frame, key, near): the stable frames of each bucket for every state that the vote may start it in.

    The state is the number of keys since the vote last started over, most of all 2 * required - 1; near is the number that
    makes this frame stable. A bucket's last row, without a frame, tells in which state each state leaves it.
    """
    most = 2 * required - 1

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        here: tuple | None = None
        ends: list[int] = []
        for session, bucket, frame, key, near in rows:
            if (session, bucket) != here:
                if here:
                    yield (*here, None, None, 0, ends)
                here, ends = (session, bucket), list(range(most + 1))
            if near is None:
                ends = [min(s + 1, most) for s in ends]
                continue
            stable = 0
            for i, s in enumerate(ends):
                if s >= near:
                    stable |= 1 << i
                    ends[i] = 0
                else:
                    ends[i] = min(s + 1, most)
            if stable:
                yield session, bucket, frame, key, stable, None
        if here:
            yield (*here, None, None, 0, ends)

    return run


def _starts(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The state in which the vote begins each bucket, over (session, bucket, ends)."""
    now, state = None, 0
    for session, bucket, ends in rows:
        if session != now:
            now, state = session, 0
        yield session, bucket, state
        state = ends[state]


def stable_frames(df: DataFrame, session: str, order: list[str], frame: str, key: str, required: int = 2, bucket: float = BUCKET) -> DataFrame:
    """(session_id, frame_id, stable_key) for each frame at which a reading became stable; then the vote starts over.

    bucket is a width of the first order column, a time (in seconds) or a number: a session's frames are folded
    bucket by bucket, and the buckets' effects along the session.
    """
    prepare(df.sparkSession)
    most = 2 * required - 1
    at = [f"o{i}" for i in range(len(order))]
    moment = F.col("o0").cast("timestamp") if dict(df.dtypes)[order[0]].startswith("timestamp") else F.col("o0")
    slim = df.select(F.col(session).cast("long").alias("session_id"), *(F.col(c).alias(a) for c, a in zip(order, at, strict=True)), F.col(frame).cast("long").alias("frame_id"), F.coalesce(F.col(key), F.lit("")).alias("key"))
    part = ["session_id", "bucket"]
    within = Window.partitionBy(*part).orderBy(*at)
    rows = slim.withColumn("bucket", F.coalesce(F.floor(moment.cast("double") / bucket), F.lit(-1 << 62))).withColumn("earlier", F.collect_list("key").over(within.rowsBetween(-most, -1)))
    tails = rows.groupBy(*part).agg(F.max_by(F.concat("earlier", F.array("key")), F.struct(*at)).alias("tail"))
    before = F.flatten(F.collect_list("tail").over(Window.partitionBy("session_id").orderBy("bucket").rowsBetween(-most, -1)))
    rows = rows.join(tails.select(*part, before.alias("before")), part)
    newest_first = F.reverse(F.concat("before", "earlier"))
    equal = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda i: F.get("newest", i - 1) == F.col("key"))
    near = F.lit(0) if required == 1 else F.get(equal, F.lit(required - 2))
    rows = rows.withColumn("newest", newest_first).select(*part, *at, "frame_id", "key", near.cast("int").alias("near"))
    slots = pa.schema([("session_id", pa.int64()), ("bucket", pa.int64()), ("frame_id", pa.int64()), ("key", pa.string()), ("stable", pa.int64()), ("ends", pa.list_(pa.int32()))])
    fold, drop = _votes(required), len(at)
    folded = _in_order(rows, part, at, lambda given: fold((*r[:2], *r[2 + drop :]) for r in given), slots, "session_id bigint, bucket bigint, frame_id bigint, key string, stable bigint, ends array<int>")
    folded = checkpointed(folded)
    begun = pa.schema([("session_id", pa.int64()), ("bucket", pa.int64()), ("state", pa.int32())])
    starts = _in_order(folded.where("ends is not null").select(*part, "ends"), ["session_id"], ["bucket"], _starts, begun, "session_id bigint, bucket bigint, state int")
    met = folded.where("ends is null").join(starts, part)
    return met.where(F.expr("stable >> state & 1 = 1")).select("session_id", "frame_id", F.col("key").alias("stable_key"))


def _micros(c: Column | str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c)


def _gated(frames: DataFrame, feedback: DataFrame, bucket: float) -> DataFrame:
    """frames with the column _told, the latest of feedback(session_id, ts, frame_id, feedback) at their time; ok before any."""
    shots = frames.withColumns({"_told": F.lit(None).cast("string"), "_shot": F.lit(1)})
    looks = feedback.select("session_id", "ts", F.col("frame_id"), F.col("feedback").alias("_told"), F.lit(0).alias("_shot"))
    both = shots.unionByName(looks, allowMissingColumns=True).withColumn("_bucket", F.floor(F.col("ts").cast("timestamp").cast("double") / bucket))
    part, at = ["session_id", "_bucket"], ["ts", "_shot", "frame_id", "_told"]
    last = both.groupBy(*part).agg(F.max_by("_told", F.when(F.col("_told").isNotNull(), F.struct("ts", "frame_id", "_told"))).alias("_last"))
    carried = F.last("_last", ignorenulls=True).over(Window.partitionBy("session_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    here = F.last("_told", ignorenulls=True).over(Window.partitionBy(*part).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0))
    seen = both.withColumn("_here", here).where("_shot = 1").join(last.select(*part, carried.alias("_before")), part)
    return seen.select(*frames.columns, F.coalesce("_here", "_before", F.lit("ok")).alias("_told"))


def frame_gate(frames: DataFrame, feedback: DataFrame, bucket: float = BUCKET) -> DataFrame:
    """frames(session_id, ts, frame_id, ...) but for those whose latest feedback(session_id, ts, feedback) is strong glare.

    An as-of join: feedback at a frame's time comes before it; none yet counts as ok. Inside a bucket of time feedback is carried
    forward over both tables in order, between buckets only its last value is.
    """
    looks = feedback.select("session_id", "ts", F.lit(None).cast("long").alias("frame_id"), "feedback")
    names = [c for c in frames.columns if c != "feedback"]
    return _gated(frames.select(names), looks, bucket).where("_told <> 'glare_strong'").select(*names, F.col("_told").alias("feedback"))


def sample_frames(frames: DataFrame, tick: str = OCR_TICK) -> DataFrame:
    """The last frame of each session in each tick: session_id, tick, ts, frame_id."""
    last = frames.groupBy("session_id", F.window("ts", tick).alias("w")).agg(F.max(F.struct("ts", "frame_id")).alias("f"))
    return last.select("session_id", F.col("w.start").alias("tick"), F.col("f.ts").alias("ts"), F.col("f.frame_id").alias("frame_id"))


def _span(text: str) -> int:
    """Microseconds."""
    return int(pd.Timedelta(text).total_seconds() * 1_000_000)


def _keyed(frames: DataFrame, as_of_year: int) -> DataFrame:
    """frames with key, of zones read and merged; a struct column `visual`, if there, is the other side of the merge."""
    read = parse_mrz(frames, "mrz_text", as_of_year)
    doc = merged(F.col("mrz"), F.col("visual") if "visual" in frames.columns else None)
    return read.select("session_id", "ts", "frame_id", "feedback", F.when(F.col("mrz.mrzLine1").isNotNull(), document_key(doc)).alias("key"))


def scan_frames(frames: DataFrame, as_of_year: int, required: int = 2, tick: str = OCR_TICK, bucket: float = BUCKET) -> DataFrame:
    """Stable documents of frames(session_id, ts, frame_id, feedback, mrz_text[, visual]): rows with feedback are glare ticks,
    the others frames.

    Of the frames in a tick the last one counts, unless the feedback at its time is strong glare; only those are
    read, and those without a document are no votes.
    """
    names = [c for c in frames.columns if c in ("session_id", "ts", "frame_id", "mrz_text", "visual")]
    looks = frames.where("feedback is not null").select("session_id", "ts", "frame_id", "feedback")
    shots = frames.where("feedback is null").groupBy("session_id", F.floor(_micros("ts") / _span(tick)).alias("tick"))
    shots = shots.agg(F.max_by(F.struct(*names[1:]), F.struct("ts", "frame_id")).alias("s")).select("session_id", *(F.col(f"s.{c}").alias(c) for c in names[1:]))
    open_ = _gated(shots, looks, bucket).where("_told <> 'glare_strong'").withColumnRenamed("_told", "feedback")
    return stable_frames(_keyed(open_, as_of_year).where("key is not null"), "session_id", ["ts", "frame_id"], "frame_id", "key", required, bucket)


def _vote(history: list[str], key: str, required: int) -> tuple[list[str], str | None]:
    """The history after a key, and the stable key if there is one, upon which the history starts over."""
    history = [*history, key][-2 * required :]
    stable = next((k for k in dict.fromkeys(history) if history.count(k) >= required), None)
    return ([] if stable is not None else history), stable


class _InOrder(StatefulProcessor):
    """Votes of a session's rows, held back until the watermark has passed the end of their tick.

    A row that comes later than the watermark never arrives here, so a tick that the watermark has passed is whole: its rows
    are taken by time, feedback first, and its last frame votes unless the feedback at its time was strong glare. A
    session is forgotten once it had no row for `ttl`; a row after such a pause starts it anew.
    """

    def __init__(self, required: int, tick: int, ttl: int, every: bool):
        self.required, self.tick, self.ttl, self.every = required, tick, ttl, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at bigint, shot int, frame_id bigint, feedback string, key string")
        self.kept = handle.getValueState("kept", "feedback string, history array<string>, last bigint")

    def handleInputRows(self, key, rows, timerValues):
        ends: set[int] = set()
        for pdf in rows:
            blank = lambda c, pdf=pdf: pdf[c].astype(object).where(pdf[c].notna(), None)
            told = blank("feedback")
            self.held.appendList([(int(t), int(f is None), int(i), f, k) for t, i, f, k in zip(pdf["at"], pdf["frame_id"], told, blank("key"), strict=True)])
            ends.update((pdf["at"] // self.tick).unique().tolist())
        for tick in ends:
            self._wake(int(tick + 1) * self.tick)
        return iter(())

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        until = mark // self.tick * self.tick
        held = sorted((tuple(r) for r in self.held.get()), key=lambda r: r[:3]) if self.held.exists() else []
        ready = [r for r in held if r[0] < until]
        if ready:
            rest = held[len(ready) :]
            self.held.put(rest) if rest else self.held.clear()
            out = self._fold(ready)
            if out:
                yield pd.DataFrame([(key[0], f, k) for f, k in out], columns=["session_id", "frame_id", "stable_key"])
        elif not held and self.kept.exists() and self.kept.get()[2] + self.ttl < mark:
            self.kept.clear()

    def _fold(self, rows: list[tuple]) -> list[tuple[int, str]]:
        feedback, history, last = self.kept.get() if self.kept.exists() else ("ok", [], rows[0][0])
        history, out = list(history), []

        def vote(shot: tuple | None) -> None:
            nonlocal history
            if shot is not None and shot[2] != "glare_strong" and shot[1] is not None:
                history, stable = _vote(history, shot[1], self.required)
                if stable is not None:
                    out.append((shot[0], stable))

        shot, tick = None, None
        for at, is_shot, frame, told, own in rows:
            if at // self.tick != tick:
                vote(shot)
                shot, tick = None, at // self.tick
            if at - last > self.ttl:
                feedback, history = "ok", []
            last = at
            if not is_shot:
                feedback = told
            elif self.every:
                vote((frame, own, feedback))
            else:
                shot = (frame, own, feedback)
        vote(shot)
        self.kept.update((feedback, history, last))
        self._wake(last + self.ttl + 1000)
        return out

    def close(self) -> None:
        pass


STREAM_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_VOTES = "session_id bigint, frame_id bigint, stable_key string"


def _in_event_order(rows: DataFrame, processor: _InOrder) -> DataFrame:
    """The state lies in RocksDB, which timers need: it is set for this session."""
    prepare(rows.sparkSession)
    for k, v in STREAM_CONF.items():
        rows.sparkSession.conf.set(k, v)
    slim = rows.select(F.col("session_id").cast("long").alias("session_id"), "ts", _micros("ts").alias("at"), F.col("frame_id").cast("long").alias("frame_id"), "feedback", "key")
    return slim.groupBy("session_id").transformWithStateInPandas(processor, _VOTES, "append", "eventTime")


def stable_stream(frames: DataFrame, required: int = 2, ttl: str = "10 minutes", late: str | None = "1 minute") -> DataFrame:
    """stable_frames for a stream of (session_id, ts, frame_id, key); a session without frames for ttl is forgotten.

    Frames are voted on in the order of their times, a second's frames once the watermark has passed it. Frames later than
    `late` are dropped; with None, frames carries its own watermark on ts.
    """
    marked = frames if late is None else frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = marked.withColumns({"feedback": F.lit(None).cast("string"), "key": F.coalesce("key", F.lit(""))})
    return _in_event_order(rows, _InOrder(required, 1_000_000, _span(ttl), every=True))


def stream_scan(frames: DataFrame, as_of_year: int, required: int = 2, tick: str = OCR_TICK, late: str = "1 minute", ttl: str = "10 minutes") -> DataFrame:
    """scan_frames of a stream, with the same votes for any order of arrival within `late`; later rows are dropped.

    A tick is read once the watermark has passed it. Zones are read before the shuffle, so that state and shuffle hold
    keys in place of texts. A session without rows for ttl is forgotten, its feedback with it.
    """
    keyed = _keyed(frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), as_of_year)
    return _in_event_order(keyed, _InOrder(required, _span(tick), _span(ttl), every=False))
