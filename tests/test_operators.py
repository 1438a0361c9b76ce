"""Frames: multisets, ranks, as-of, NaN in aggregates, series and overlaps."""

import math
from collections import Counter
import random

import pytest
from pyspark.sql import functions as F

from tessel.operators import filters, order, reduce, search, series, sets

NAN, INF = float("nan"), float("inf")


def ids(spark, xs, name="id", kind="bigint"):
    return spark.createDataFrame([(x,) for x in xs], f"{name} {kind}")


def values(df):
    return sorted((r[0] for r in df.collect()), key=lambda v: (v is None, v))


def test_sets(spark):
    a, b = ids(spark, [10, 20, 20, 30, 40, 40, 50, 60, 60, 70]), ids(spark, [20, 20, 40, 40, 60, 60, 80])
    assert values(sets.intersect(a, b)) == [20, 20, 40, 40, 60, 60]
    assert values(sets.intersect(a, b, dedup=True, most=2)) == [20, 40]
    assert values(sets.difference(ids(spark, [1, 1, 2, 2, 3, 3]), ids(spark, [2]))) == [1, 1, 3, 3]
    assert values(sets.difference(ids(spark, [1, 1, 2]), ids(spark, []), dedup=True)) == [1, 2]
    assert values(sets.union([ids(spark, [1, 3, 5]), ids(spark, [3, 5, 7])], most=2, ascending=False)) == [5, 7]
    got = values(sets.dedup_doubles(ids(spark, [0.0, -0.0, 1.0, 1.0, NAN, NAN], "v", "double"), "v"))
    assert sum(math.isnan(v) for v in got) == 2 and len(got) == 4
    a, b = set(range(50)), set(range(25, 90))
    assert sets.intersect(ids(spark, a), ids(spark, b)).count() + sets.difference(ids(spark, a), ids(spark, b)).count() == len(a)
    assert values(sets.without_deleted(ids(spark, range(40)), ids(spark, range(3, 40)), "id")) == [0, 1, 2]


def test_filters(spark):
    v = ids(spark, [1.0, 2.0, NAN, None, 3.0], "v", "double")
    assert values(filters.in_range(v, "v", 2.0, INF)) == [2.0, 3.0]
    times = spark.createDataFrame([(i, i) for i in range(1, 11)], "doc_id bigint, time bigint")
    assert values(filters.in_time_range(times, "doc_id", "time", 3, 7)) == [3, 4, 5, 6, 7]
    assert values(filters.in_time_range(times, "doc_id", "time", 3, 7, most=2)) == [3, 4]
    counts = spark.createDataFrame([(1, 10), (2, 5), (3, 20), (4, 3), (5, 15)], "id bigint, count bigint")
    assert values(filters.with_count_at_least(counts, "id", "count", 10)) == [1, 3, 5]


def test_overlap_join_gives_each_pair_once(spark):
    a = [(i, i * 3.0, i * 3.0 + 10) for i in range(20)]
    b = [(i, i * 7.0 - 5, i * 7.0) for i in range(12)]
    got = filters.range_overlap_join(spark.createDataFrame(a, "i int, s double, e double"), spark.createDataFrame(b, "j int, t double, f double"), ("s", "e"), ("t", "f"), 4.0)
    want = sorted((i, j) for i, s, e in a for j, t, f in b if s <= f and e >= t)
    assert sorted((r.i, r.j) for r in got.collect()) == want


def test_overlap_join_divides_a_crowded_bucket(spark, monkeypatch):
    monkeypatch.setattr(filters, "LOT", 10, raising=False)
    monkeypatch.setattr(filters, "TESTS", 200, raising=False)
    a = [(i // 2, float(i % 7), i % 7 + 3.0) for i in range(100)] + [(50, None, 1.0), (51, 2.0, None), (52, 30.0, -30.0)]
    b = [(i // 3, float(i % 5) - 1, float(i % 5)) for i in range(120)] + [(60, None, None), (61, -40.0, 40.0)]
    got = filters.range_overlap_join(spark.createDataFrame(a, "i int, s double, e double"), spark.createDataFrame(b, "j int, t double, f double"), ("s", "e"), ("t", "f"), 20.0)
    want = sorted((i, j) for i, s, e in a for j, t, f in b if None not in (s, e, t, f) and s <= f and e >= t)
    rows = got.select("i", "j", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.i, r.j) for r in rows) == want
    assert max(Counter(r.task for r in rows).values()) < len(want) / 8
    assert filters.range_overlap_join(got.select("i", "s", "e").where("false"), got.select("j", "t", "f"), ("s", "e"), ("t", "f"), 20.0).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_ranks(spark, parts):
    data = [(float((i * 7919) % 101), i) for i in range(300)] + [(NAN, 300), (None, 301)]
    df = spark.createDataFrame(data, "v double, i int")
    key = lambda x: (1, x) if x is not None and not math.isnan(x) else (0, 0) if x is None else (2, 0)
    want = {i: n for n, (_, i) in enumerate(sorted(data, key=lambda r: (key(r[0]), r[1])), 1)}
    assert {r.i: r["rank"] for r in order.ranked(df, "v", "i", parts=parts).collect()} == want
    down = order.ranked(df, "v", "i", ascending=False, parts=parts).orderBy("rank").collect()
    assert math.isnan(down[0].v) and down[-1].v is None and [r["rank"] for r in down] == list(range(1, 303))
    last = order.ranked_nan_last(df.where("v IS NOT NULL"), "v", "i", ascending=False).orderBy("rank").collect()
    assert math.isnan(last[-1].v) and last[0].v == 100.0
    assert order.ranked(df.where("false"), "v", "i").count() == 0


def test_asof(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 2, 10.0), ("a", 5, 20.0), ("a", 5, 21.0), ("c", 1, 1.0)], "k string, t int, v double")
    got = {r.id: (r.asof_time, r.asof_value) for r in search.asof(left, right, "k", "t", "v").collect()}
    assert got == {1: (5, 21.0), 2: (None, None), 3: (None, None)}
    got = {r.id: r.asof_time for r in search.asof(left, right, "k", "t", "v", forward=True).collect()}
    assert got == {1: 5, 2: 2, 3: None}


def test_bounds(spark):
    v = ids(spark, [1, 3, 3, 5])
    for t, want in ((0, (0, 4, 0)), (3, (1, 2, 3)), (6, (4, 3, 4))):
        assert tuple(v.agg(search.at_least(F.col("id"), F.lit(t)), search.at_most(F.col("id"), F.lit(t)), search.after_at_most(F.col("id"), F.lit(t))).first()) == want


def test_reductions_of_nan_and_nothing(spark):
    v = F.col("v")
    empty, nan = ids(spark, [], "v", "double"), ids(spark, [1.0, NAN, 3.0, 5.0, NAN], "v", "double")
    one = lambda df, f: df.agg(f(v).alias("x")).first().x
    assert one(empty, reduce.sum_f64) == 0 and one(empty, reduce.min_f64) == INF and one(empty, reduce.max_f64) == -INF and math.isnan(one(empty, reduce.avg)) and math.isnan(one(empty, reduce.variance)) and one(empty, reduce.present) == 0
    assert math.isnan(one(nan, reduce.min_f64)) and math.isnan(one(nan, reduce.max_f64)) and math.isnan(one(nan, reduce.avg)) and one(nan, reduce.present) == 1
    assert one(nan, reduce.variance) == pytest.approx(8 / 3)
    assert one(ids(spark, [float(i) for i in range(1, 101)], "v", "double"), reduce.variance) == pytest.approx(833.25)
    grouped = nan.withColumn("g", F.lit(1))
    assert reduce.mean_deviation(grouped, ["g"], "v").first().mad == pytest.approx(4 / 3)
    big = ids(spark, [2**63 - 1] * 3, "v")
    assert int(one(big, reduce.sum_u64)) == 3 * (2**63 - 1) % 2**64
    p = reduce.percentiles(ids(spark, [1.0, 2.0, 3.0, 4.0], "v", "double"), [], "v", [50.0, -1.0, 100.0]).first().p
    assert p[0] == 2.5 and math.isnan(p[1]) and p[2] == 4.0
    rng = random.Random(1)
    for _ in range(3):
        rows = [(g, rng.choice([0.0, -0.0, 1e-9, -3.5, 7.25, 7.3, 1e12, -1e12, rng.gauss(0, 50)])) for g in (1, 2, None) for _ in range(rng.randint(1, 60))] + [(7, None), (2, None)]
        got = {r.g: list(r.p) for r in reduce.percentiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", [0.0, 33.3, 75.0, 100.0]).collect()}
        assert set(got) == {1, 2, None, 7} and all(math.isnan(x) for x in got[7])
        for g in (1, 2, None):
            own = sorted(x for k, x in rows if k == g and x is not None)
            for q, x in zip((0.0, 33.3, 75.0, 100.0), got[g]):
                at = q / 100 * (len(own) - 1)
                lo, hi = own[math.floor(at)], own[math.ceil(at)]
                assert x == pytest.approx(lo + (hi - lo) * (at - math.floor(at)))


def test_series(spark):
    data = [("a", i, v) for i, v in enumerate([1.0, 2.0, 2.0, NAN, NAN, 1.0])] + [("b", 0, 5.0), ("c", 0, 9.0), ("c", 1, 4.0)]
    df = spark.createDataFrame(data, "s string, t int, v double")
    as_dict = lambda d: {r[0]: r[1] for r in d.collect()}
    assert as_dict(series.changes(df, "s", ["t"], "v")) == {"a": 4.0, "b": 0.0, "c": 1.0}
    assert as_dict(series.resets(df, "s", ["t"], "v")) == {"a": 0.0, "b": 0.0, "c": 1.0}
    assert as_dict(series.increase(df, "s", ["t"], "v")) == {"a": 0.0, "b": 0.0, "c": 4.0}
    line = spark.createDataFrame([(i, 2.0 * i + 1) for i in range(5)], "t int, v double")
    assert line.agg(series.slope(F.col("v"), F.col("t")).alias("x")).first().x == pytest.approx(2)
    assert line.agg(series.predicted(F.col("v"), F.col("t"), F.lit(10.0)).alias("x")).first().x == pytest.approx(21)
    assert line.where("t = 3").agg(series.predicted(F.col("v"), F.col("t"), F.lit(10.0)).alias("x")).first().x == 7
    steps = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", 1, 2), ("b", 2, 1)], "s string, t int, v int")
    assert as_dict(order.is_sorted(steps, "s", ["t"], "v")) == {"a": True, "b": False}
