"""The greedy timer over runs of any length, many tasks a run.

A timer takes an opportunity from `interval` after the one it took before, so each choice depends on the last. What a stretch of the run does
to the choice is known without that: a stretch, called segment, is a function from the time that is due when it begins to the time that is due
when it ends. Opportunities are dealt out by ranges of (keys, time) in segments of about SEGMENT times. A key that lies in one segment is one
sorted pass. For the others:

- exits: each segment tells the times that can be due after it. Only its opportunities up to `interval` after its first one can be the first that is taken there.
- links: each of these times meets the segment in which it comes due, and becomes the time due after that one.
- pointer doubling over the links, from the time that is due at the start, finds for each segment the one time that is due in it: as many
  rounds as the logarithm of the segments of a key.
- every segment is then one sorted pass of its own.

Segments hold a bounded number of times, whatever the keys: what a task holds doesn't grow with the table. Keys over several segments have
together fewer than twice as many rows in the tables of segments as there are segments (each but one begins at a boundary), that is one for
each SEGMENT / 2 opportunities; these tables are broadcast, and nothing else is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import finite
from tidemark.sources.tables import scratch

#: Times of a segment: 32 MB of doubles.
SEGMENT = 1 << 22

NODE = ["_hot", "_segment", "_due"]
LINKS = "_hot int, _segment int, _due double, _next_segment int, _next double"


def written(rows: DataFrame, what: str) -> DataFrame:
    path = scratch(rows.sparkSession, what)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def ends_of(times: np.ndarray, step: float) -> np.ndarray:
    """For each of the sorted times the last one of the same segment that a timer takes which takes this one."""
    here = np.arange(len(times))
    following = np.searchsorted(times, times + step)
    ends = np.where(following < len(times), following, here)
    while True:
        further = ends[ends]
        if np.array_equal(further, ends):
            return ends
        ends = further


def passed(rows: DataFrame, by: Sequence[str], time: str, step: float) -> DataFrame:
    """by and time of what is taken of rows (by, _segment, time, _due), each segment from its own _due on: one sorted pass with one number as state."""
    rows = rows.select(*by, "_segment", time, "_due")
    at = len(by) + 1
    schema = T.StructType([rows.schema[c] for c in [*by, time]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, due = None, 0.0
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(at)), strict=True)
            taken = []
            for i, (key, t, begun) in enumerate(zip(keys, batch.column(at).to_pylist(), batch.column(at + 1).to_pylist(), strict=True)):
                if key != now:
                    now, due = key, begun
                if t >= due:
                    taken.append(i)
                    due = t + step
            if taken:
                yield batch.take(pa.array(taken)).select(schema.names)

    return rows.repartition(*by, "_segment").sortWithinPartitions(*by, "_segment", time).mapInArrow(run, schema)


def entered(times: DataFrame, spans: DataFrame, starts: DataFrame, step: float) -> DataFrame:
    """NODE: the time that is due in each segment in which one comes due.

    times: _hot, _segment, _t; spans: _hot, _segment, _first, _last; starts: _hot, _due. The last two are bounded by the number of segments.
    """
    spark = times.sparkSession
    known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for hot, parts in spans.groupBy("_hot").agg(F.sort_array(F.collect_list(F.struct("_segment", "_first", "_last"))).alias("p")).collect():
        known[hot] = tuple(np.array(c) for c in zip(*parts, strict=True))
    begins = {r["_hot"]: r["_due"] for r in starts.collect()}
    shared = spark.sparkContext.broadcast((known, begins))

    def place(hot: int, dues: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The segments in which the times come due, -1 after the last; a time before the segment's first is due with that."""
        segments, firsts, lasts = shared.value[0][hot]
        k = np.searchsorted(lasts, dues)
        inside = np.minimum(k, len(lasts) - 1)
        return np.where(k < len(lasts), segments[inside], -1), np.maximum(dues, firsts[inside])

    def exits(key: tuple, group: pa.Table) -> pa.Table:
        hot, segment = (k.as_py() for k in key)
        t = np.sort(group.column("_t").to_numpy())
        entries = np.arange(min(len(t), int(np.searchsorted(t, t[0] + step)) + 1))
        begin = shared.value[1].get(hot)
        if begin is not None and t[0] <= begin <= t[-1]:
            entries = np.append(entries, np.searchsorted(t, begin))
        to, due = place(hot, np.unique(t[ends_of(t, step)[entries]] + step))
        to, due = to[to >= 0].astype(np.int32), due[to >= 0]
        return pa.table({"_hot": pa.array(np.full(len(to), hot, np.int32)), "_segment": to, "_due": due})

    def follow(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        hot, segment = key[0].as_py(), key[1].as_py()
        dues = right.column("_due").to_numpy()
        if not len(dues):
            return pa.table({f.name: pa.array([], f.type) for f in arrow})
        t = np.sort(left.column("_t").to_numpy())
        to, following = place(hot, t[ends_of(t, step)[np.searchsorted(t, dues)]] + step)
        last = to < 0
        columns = [np.full(len(dues), hot, np.int32), np.full(len(dues), segment, np.int32), dues, pa.array(to.astype(np.int32), mask=last), pa.array(following, mask=last)]
        return pa.table(dict(zip(arrow.names, columns, strict=True)))

    arrow = pa.schema([("_hot", pa.int32()), ("_segment", pa.int32()), ("_due", pa.float64()), ("_next_segment", pa.int32()), ("_next", pa.float64())])
    firsts = [(hot, int(to[0]), float(due[0])) for hot, begin in begins.items() for to, due in [place(hot, np.array([begin]))] if to[0] >= 0]
    start = spark.createDataFrame(firsts, "_hot int, _segment int, _due double")
    dues = written(times.groupBy("_hot", "_segment").applyInArrow(exits, "_hot int, _segment int, _due double").union(start).distinct(), "timer-dues")
    # A segment with more times that may be due than it is meant to hold is read by several tasks, each with a share of them.
    shares = dues.groupBy("_hot", "_segment").agg(F.ceil(F.count(F.lit(1)) / SEGMENT).cast("int").alias("_shares"))
    left = times.join(F.broadcast(shares), ["_hot", "_segment"]).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    right = dues.join(F.broadcast(shares), ["_hot", "_segment"]).withColumn("_share", F.pmod(F.hash("_due"), "_shares"))
    group = ["_hot", "_segment", "_share"]
    links = written(left.select(*group, "_t").groupBy(*group).cogroup(right.select(*group, "_due").groupBy(*group)).applyInArrow(follow, LINKS), "timer-links")
    reached, rounds = start, max((len(v[0]) for v in known.values()), default=1)
    while rounds > 1:
        ahead = links.where("_next is not null").select("_hot", F.col("_next_segment").alias("_segment"), F.col("_next").alias("_due"), *(F.col(c).alias(f"from{c}") for c in NODE[1:]))
        found = reached.select("_hot", *(F.col(c).alias(f"from{c}") for c in NODE[1:]))
        reached = written(reached.union(ahead.join(F.broadcast(found), ["_hot", "from_segment", "from_due"]).select(*NODE)).distinct(), "timer-reached")
        rounds = -(-rounds // 2)
        if rounds > 1:
            jumped = ahead.join(links, NODE).select("_hot", F.col("from_segment").alias("_segment"), F.col("from_due").alias("_due"), "_next_segment", "_next")
            links = written(jumped, "timer-links")
    return reached


def timed_times(opportunities: DataFrame, step: float, by: Sequence[str], time: str, start: str, segment: int = SEGMENT) -> DataFrame:
    """by and time of what is taken; see sampling.timed. segment: times of a segment."""
    key = F.struct(F.lit(0).alias("_"), *by).alias("_key")  # a struct is compared with its nulls
    narrow = opportunities.select(key, F.col(time).cast("double").alias("_t"), F.col(start).cast("double").alias("_start"))
    begun = written(narrow.groupBy("_key").agg((F.min("_start") + step).alias("_due")).where("_due is not null"), "timer-begun")
    all_times = written(narrow.where(finite(F.col("_t"))).select("_key", F.col("_t")).distinct(), "timer-times")
    segments = -(-all_times.count() // segment)
    named = [F.col(f"_key.{b}").alias(b) for b in by]
    if segments <= 1:
        return passed(all_times.join(begun, "_key").select(*named, F.lit(0).alias("_segment"), F.col("_t").alias(time), "_due"), by, time, step)
    cut = written(all_times.repartitionByRange(segments, "_key", "_t").withColumn("_segment", F.spark_partition_id()), "timer-segments")
    spans = cut.groupBy("_key", "_segment").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    many = spans.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("_segment").alias("_at")).where("_n > 1")
    # Each partition begins at most one key that goes on beyond it, so the number of that partition names the key.
    hot = written(many.select("_key", F.col("_at").alias("_hot")), "timer-hot")
    times = cut.join(F.broadcast(hot), "_key")
    spans = written(spans.join(F.broadcast(hot), "_key").select("_hot", "_segment", "_first", "_last"), "timer-spans")
    due = entered(times.select("_hot", "_segment", "_t"), spans, begun.join(F.broadcast(hot), "_key").select("_hot", "_due"), step)
    parts = times.join(F.broadcast(due), ["_hot", "_segment"]).select(*named, "_segment", F.col("_t").alias(time), "_due")
    rest = cut.join(F.broadcast(hot), "_key", "left_anti").join(begun, "_key").select(*named, "_segment", F.col("_t").alias(time), "_due")
    return passed(parts.unionByName(rest), by, time, step)
