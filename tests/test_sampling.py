import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sampling as S
from tidemark.sources import adapters as A


def test_every_n(spark):
    df = spark.range(7).withColumnRenamed("id", "forward_index")
    assert [r[0] for r in df.where(S.every_n_forwards(3)).orderBy("forward_index").collect()] == [2, 5]
    assert df.where(S.always()).count() == 7
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            S.every_n_forwards(bad)


def test_timed(spark):
    t = [(1, x, 100.0) for x in (105.0, 109.9, 110.0, 119.9, 120.0, 131.0)] + [(2, 100.0, 100.0)]
    kept = S.timed(spark.createDataFrame(t, "run int, t double, t0 double"), timedelta(seconds=10), ["run"])
    assert sorted((r["run"], r["t"]) for r in kept.collect()) == [(1, 110), (1, 120), (1, 131)]
    with pytest.raises(ValueError):
        S.timed(kept, 0, ["run"])


def timer_by_hand(rows, step):
    """The definition: each run in order of time, one number as state."""
    starts, runs, found = {}, {}, []
    for run, t, t0 in rows:
        runs.setdefault(run, set()).update(() if t is None else (t,))
        if t0 is not None:
            starts[run] = min(starts.get(run, t0), t0)
    for run, times in runs.items():
        due = starts[run] + step if run in starts else float("inf")
        for t in sorted(times):
            if t >= due:
                found.append((run, t))
                due = t + step
    return sorted(found, key=str)


@pytest.mark.parametrize("step", [0.5, 90.0, 5000.0])
def test_timed_over_segments(spark, step):
    """A run with most of the rows, gaps, bursts, equal times, nulls, a run without start, a late start and small runs, cut into many segments."""
    rng = random.Random(step)
    rows = [("hot", round(rng.expovariate(0.001), 1), 3.0) for _ in range(1500)]
    rows += [("hot", 900.0 + i / 64, None) for i in range(400)] + [("hot", 1000.0, 4.0)] * 300
    rows += [(None, float(rng.randrange(4000)), 2000.0) for _ in range(400)] + [("never", float(i), None) for i in range(300)]
    rows += [("late", float(i), 1e9) for i in range(200)] + [(f"k{i % 40}", float(rng.randrange(300)), 0.0) for i in range(300)] + [("hot", None, None), ("none", None, 1.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run string, t double, t0 double").repartition(5)
    want = timer_by_hand(rows, step)
    for segment in (150, 1 << 22):
        assert sorted(((r["run"], r["t"]) for r in S.timed(df, step, ["run"], segment=segment).collect()), key=str) == want
    assert S.timed(df.limit(0), step, ["run"]).count() == 0


def test_timed_without_keys(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("t"), F.lit(0.0).alias("t0"))
    assert sorted(r["t"] for r in S.timed(df, 30, [], segment=50).collect()) == [float(t) for t in range(30, 1000, 30)]


def test_numbering_phases_ranks_and_paths(spark):
    rows = spark.createDataFrame([("forward_complete", "outputs", 0, 3), ("forward_complete", "output_gradients", 0, 4), ("backward_observed", "output_gradients", 1, 5)], "state string, signal string, source_rank int, event_seq int")
    assert S.by_phase(rows).count() == 2 and S.of_rank(rows).count() == 2 and S.of_rank(rows, "all").count() == 3
    with pytest.raises(ValueError):
        S.of_rank(rows, "some")
    assert [r["sample_id"] for r in S.numbered(rows, ["source_rank"], "event_seq").orderBy("event_seq").collect()] == [0, 1, 0]
    one = spark.range(1).select(S.gradient_path(F.lit("output.output")).alias("a"), S.plain_dtype(F.lit("torch.float32")).alias("b")).first()
    assert (one["a"], one["b"]) == ("grad_output.output", "float32")


def test_only_the_first_event_of_a_sample_counts(spark):
    rows = spark.createDataFrame([(0, 1, "b", 5), (0, 1, "b", 5), (0, 1, "b", 9)], "source_rank int, sample_id int, state string, event_seq int")
    assert S.first_of_each(rows).count() == 2


def test_leaf_modules(spark):
    df = spark.createDataFrame([("a",), ("a.b",), ("a.b.c",), ("d",), ("",)], "module string")
    assert sorted(r[0] for r in A.leaf_modules(df).collect()) == ["", "a.b.c", "d"]


def test_nested_leaves(spark):
    df = spark.createDataFrame([(1, '{"z": 1, "a": [2, {"b": 3.5}], "s": "no", "n": null}'), (2, "no json"), (3, None)], "i int, j string")
    assert sorted((r["tensor_path"], r["value"]) for r in A.nested_leaves(df, "j", ["i"]).collect()) == [("output.a.0", 2), ("output.a.1.b", 3.5), ("output.z", 1)]


def test_leaves_of_any_depth(spark):
    deep = "7"
    for _ in range(9):
        deep = f'{{"k": [0, {deep}]}}'
    df = spark.createDataFrame([(1, deep), (2, None), (3, "no json"), (4, "5")], "i int, j string")
    found = {(r["i"], r["tensor_path"]): r["value"] for r in A.nested_leaves(df, "j", ["i"]).collect()}
    assert found[(1, "output" + ".k.1" * 9)] == 7 and found[(4, "output")] == 5 and len(found) == 11


def test_numbers_over_all_rows(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("event"))
    assert {r["event"]: r["sample_id"] for r in S.numbered(df, [], "event").collect()} == {i: i for i in range(5000)}


def test_deciders_of_ones_own(spark):
    """Every second one that is asked for, with a failure that is not taken."""

    def decide(state, row):
        if row["t"] == 3:
            raise KeyError("three")
        n = (state or 0) + 1
        return n, n % 2 == 0

    df = spark.createDataFrame([(g, t, f"{g}{t}") for g in "ab" for t in range(6)], "g string, t int, x string").repartition(3)
    taken = S.decided(df, decide, ["g"], ["t"])
    assert taken.columns == df.columns and sorted((r["g"], r["t"]) for r in taken.collect()) == [("a", 1), ("a", 4), ("b", 1), ("b", 4)]
    failed = S.decided(df, decide, ["g"], ["t"], errors=True).collect()
    assert sorted((r["g"], r["t"], r["error_type"]) for r in failed) == [("a", 3, "KeyError"), ("b", 3, "KeyError")]


def test_changes_of_events_across_days(spark):
    rng = random.Random(5)
    rows = [(i, f"2024-01-{rng.choice([1, 1, 2, 5, 9]):02d} {rng.randrange(24):02d}:00:00", rng.choice("xy"), rng.choice([None, float(rng.randrange(50))])) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    want, last = [], {}
    for i, ts, kind, v in sorted(rows, key=lambda r: (r[1], r[0])):
        if kind in last and v is not None and last[kind] is not None:
            want.append((kind, v - last[kind]))
        last[kind] = v
    assert sorted((r["module"], r["value"]) for r in A.event_change_rows(df).collect()) == sorted(want)


def test_what_cannot_be_read_follows_the_policy(spark):
    from tidemark.sources.observations import parse

    df = spark.createDataFrame([(1, '{"k": 2}'), (2, '{"k": "x"}'), (3, "no"), (4, None)], "i int, j string")
    good, bad = parse(df, "j", "k bigint")
    assert [(r["i"], r["k"]) for r in good.collect()] == [(1, 2)] and bad.count() == 3
    good, bad = parse(df, "j", "k bigint", "ignore")
    assert good.count() == 1 and bad.count() == 0
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        parse(df, "j", "k bigint", "raise")[0].collect()
    with pytest.raises(ValueError):
        parse(df, "j", "k bigint", "hide")
