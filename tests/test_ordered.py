"""Sliced scans must equal plain windows, whatever the slice size."""

import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.operators import ordered as o


def _frame(spark, seed=3):
    rng = random.Random(seed)
    rows = []
    for key, n in (("hot", 600), ("warm", 90), ("cold", 5), ("one", 1)):
        t = 0
        for i in range(n):
            t += rng.choice([0, 0, 1, 5, 1000])
            rows.append((key, t, i, rng.choice([None, 1, 2, 3]), rng.choice([None, None, "a", "b"])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t bigint, i bigint, v bigint, s string")


def test_scan_equals_plain_window(spark):
    df = _frame(spark)
    sliced = o.with_slices(df, ["k"], "t", target=50)
    assert sliced.where("k = 'hot'").select("slice").distinct().count() > 4
    assert sliced.where("k = 'cold' and slice is not null").count() == 0
    got = o.scan(sliced, ["k"], ["t", "i"], {
        "pos": o.position(),
        "total": o.running_sum(F.col("v")),
        "top": o.running_max(F.col("v"), inclusive=False),
        "low": o.running_min(F.col("v")),
        "seen": o.last_seen(F.col("s")),
        "seen_before": o.last_seen(F.col("s"), inclusive=False),
        "coming": o.next_seen(F.col("s")),
        "prev": o.previous(F.col("v")),
        "foll": o.following(F.col("v")),
    }).withColumn("prev", F.col("prev.v")).withColumn("foll", F.col("foll.v")).drop("slice")
    w = Window.partitionBy("k").orderBy("t", "i")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "*",
        F.row_number().over(w).cast("bigint").alias("pos"),
        F.sum("v").over(up).alias("total"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("top"),
        F.min("v").over(up).alias("low"),
        F.last("s", True).over(up).alias("seen"),
        F.last("s", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("seen_before"),
        F.first("s", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("coming"),
        F.lag("v").over(w).alias("prev"),
        F.lead("v").over(w).alias("foll"),
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_quantiles(spark):
    df = _frame(spark, 9).where("v is not null").withColumn("x", F.col("v") * 7 + F.col("i") % 13)
    rows = {}
    for r in df.collect():
        rows.setdefault(r.k, []).append(r.x)
    got = {r.k: r.q for r in o.nearest_rank(df, ["k"], "x", 0.75, "q").collect()}
    med = {r.k: r.m for r in o.rounded_median(df, ["k"], "x", "m").collect()}
    for k, xs in rows.items():
        xs.sort()
        assert got[k] == xs[max(0, math.ceil(0.75 * len(xs)) - 1)]
        mid = len(xs) // 2
        want = xs[mid] if len(xs) % 2 else math.floor((xs[mid - 1] + xs[mid]) / 2 + 0.5)
        assert med[k] == want


def test_whole_mark_survives_and_skips_slicing(spark):
    df = _frame(spark).where("k <> 'hot' and k <> 'warm'")
    sliced = o.with_slices(df, ["k"], "t", target=50)
    assert o.is_whole(sliced)
    once = o.scan(sliced, ["k"], ["t", "i"], {"pos": o.position()})
    assert o.is_whole(once.where("pos > 0").join(once.select("k").distinct(), "k", "left"))
    assert not o.is_whole(o.with_slices(_frame(spark), ["k"], "t", target=50))


def test_slices_hold_against_outliers_and_repeats(spark):
    rng = random.Random(8)
    rows = [("a", 10**15 + i) for i in range(4000)] + [("a", 0), ("a", 10**17)]
    rows += [("b", int(10**9 * rng.random() ** 4)) for _ in range(3000)] + [("c", i) for i in range(30)]
    df = o.with_slices(spark.createDataFrame(rows, "k string, t bigint"), ["k"], "t", target=100)
    sizes = df.where("slice is not null").groupBy("k", "slice").count().groupBy("k").agg(F.max("count").alias("most"), F.count("*").alias("n")).collect()
    assert {r.k for r in sizes} == {"a", "b"} and all(r.most <= 200 and r.n >= 30 for r in sizes)
    ordered_slices = [r.slice for r in df.where("k = 'b'").orderBy("t").select("slice").collect()]
    assert ordered_slices == sorted(ordered_slices)
