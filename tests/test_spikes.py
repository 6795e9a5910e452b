import random

import numpy as np
from pyspark.sql import functions as F

from lumenspar.operators.spikes import GAMMA, _counted, flag_groups, flag_readings, hour_fences, sketch_bins


def series(rng, k, n, level=50.0, noise=1.0):
    return [(k, i * 10_000, level + rng.gauss(0, noise), i) for i in range(n)]


def flags(spark, rows, sources, **o):
    r = spark.createDataFrame([(*x, "c") for x in rows], "key bigint, t bigint, v double, arrival bigint, unit string")
    s = spark.createDataFrame(sources, "key bigint, unit string, continuous boolean")
    return {(x["key"], x["t"], x["why"]) for x in flag_readings(r, s, "key", **o).collect()}


def test_spikes_runs_levels_and_stuck(spark):
    rng = random.Random(5)
    a = series(rng, 1, 400)
    for i in (50, 120, 121, 122):
        a[i] = (1, i * 10_000, 500.0, i)
    for i in range(200, 400):  # a lasting change of level is normal
        a[i] = (1, i * 10_000, a[i][2] + 30, i)
    for i in range(300, 312):
        a[i] = (1, i * 10_000, 81.5, i)
    for i in range(350, 354):  # four in a row are a level, not a spike
        a[i] = (1, i * 10_000, 300.0 + i, i)
    got = flags(spark, a, [(1, "watt", True)])
    assert {(t // 10_000, w) for _, t, w in got} == {(i, "spike") for i in (50, 120, 121, 122)} | {(i, "stuck") for i in range(300, 312)}


def test_impossible_counts_everywhere_and_first_arrival_wins(spark):
    rows = [(1, 0, 101.0, 5), (1, 0, 50.0, 1), (2, 0, -1.0, 0), (3, 0, -20.0, 0), (3, 1, -300.0, 0), (4, 0, 1.5, 0), (5, 0, -1.0, 0), (2, 5, None, 0), (None, 5, -1.0, 0), (2, 9, float("nan"), 0)]
    got = flags(spark, rows, [(1, "percent", True), (2, "job", False), (3, "celsius", True), (4, "fraction", None)])
    assert got == {(2, 0, "impossible"), (3, 1, "impossible"), (4, 0, "impossible")}  # key 5 is no known source


def test_short_and_discrete_series_have_no_spikes(spark):
    rng = random.Random(1)
    a, b = series(rng, 1, 59), series(rng, 2, 100)
    a[30] = b[30] = None
    rows = [x for x in a + b if x] + [(1, 300_000, 900.0, 0), (2, 300_000, 900.0, 0)]
    assert flags(spark, rows, [(1, "watt", True), (2, "job", False)]) == set()


def test_hot_source_is_split_without_losing_anything(spark):
    rng = random.Random(2)
    a = series(rng, 1, 3000)
    hits = rng.sample(range(10, 2990, 12), 40)
    for i in hits:
        a[i] = (1, i * 10_000, 5000.0, i)
    for i in range(1491, 1511):
        a[i] = (1, i * 10_000, 50.25, i)
    whole = flags(spark, a, [(1, "watt", True)])
    split = flags(spark, a, [(1, "watt", True)], hot_rows=500, segment_rows=300)
    assert whole == split
    assert {t // 10_000 for _, t, w in whole if w == "stuck"} >= set(range(1491, 1511)) - set(hits)


def test_hot_source_with_outages_and_sparse_stretches(spark):
    rng = random.Random(4)
    t, a = 0, []
    for i in range(1600):  # bursts, long outages, and from 1200 on readings far apart
        t += 50_000_000 if i in (400, 801) else 2_000_000 if i >= 1200 else 10_000
        a.append((1, t, 50 + rng.gauss(0, 1), i))
    for i in (400, 401, 700, 801, 802, 803, 1250, 1300, 1301, 1599):  # at restart, in a row, in a sparse stretch, at the end
        a[i] = (*a[i][:2], 5000.0, i)
    for i in range(1400, 1412):
        a[i] = (*a[i][:2], 50.25, i)
    rows = a + [(1, a[i][1], 9000.0, 5000 + i) for i in range(0, 1600, 7)]  # copies that came later aren't readings
    n = {x[1]: i for i, x in enumerate(a)}
    for o in ({}, {"hot_rows": 500, "segment_rows": 100}, {"hot_rows": 500, "segment_rows": 33}, {"hot_rows": 500, "segment_rows": 1}):
        got = {(n[x], w) for _, x, w in flags(spark, rows, [(1, "watt", True)], **o)}
        assert got == {(i, "spike") for i in (400, 401, 700, 801, 802, 803, 1250, 1300, 1301)} | {(i, "stuck") for i in range(1400, 1412)}, o


def test_groups(spark):
    rng = random.Random(3)
    rows = [(1, f"g{i}", rng.gauss(100, 5), "watt", False) for i in range(500)] + [(1, "low", 1.0, "watt", False), (1, "neg", -5.0, "watt", False), (1, "hot", 1e6, "watt", False), (2, "q", 1e9, "job", True), (2, "n", -1.0, "job", True), (1, "none", None, "watt", False), (1, "hot", 1e6, "watt", False)]
    df = spark.createDataFrame(rows, "src bigint, grp string, x double, unit string, only boolean")
    got = {(r["src"], r["grp"], r["why"]) for r in flag_groups(df, "src", "grp", "x", "unit", impossible_only=F.col("only")).collect()}
    assert got == {(1, "low", "outside"), (1, "neg", "impossible"), (1, "hot", "outside"), (2, "n", "impossible")}
    assert flag_groups(df.where("false"), "src", "grp", "x", "unit").count() == 0


def test_quiet_hours_have_their_own_fences(spark):
    """Spikes in quiet hours are far below what the loud hours of the same source do all the time; cut or not."""
    rng = random.Random(6)
    a = []
    for i in range(24 * 60 * 6):  # six days, a reading a minute; hours 0 to 5 quiet, the others loud
        quiet = i // 60 % 24 < 6
        a.append((1, i * 60_000, 50 + rng.gauss(0, 0.01 if quiet else 40), i))
    hits = [day * 1440 + m for day, m in ((0, 90), (1, 100), (1, 200), (2, 30), (3, 301), (4, 222), (5, 17), (5, 345))]
    for i in hits:
        a[i] = (*a[i][:2], a[i][2] + 5.0, i)
    whole = flags(spark, a, [(1, "watt", True)], context=20)
    assert {t // 60_000 for _, t, w in whole if t // 60_000 // 60 % 24 < 6 and w == "spike"} >= set(hits)
    assert flags(spark, a, [(1, "watt", True)], context=20, hot_rows=1000, segment_rows=700) == whole


def test_fences_are_the_sketch_quartiles():
    rng = np.random.default_rng(1)
    step = np.abs(rng.normal(0, 3, 4000)) * (rng.random(4000) > 0.1)
    g, hour = rng.integers(0, 3, 4000), rng.integers(0, 24, 4000)
    got = hour_fences(*_counted(g, hour, sketch_bins(step)), 4, 4.5, 50)
    for i in range(3):
        for h in range(24):
            own = step[(g == i) & (hour == h)]
            b = np.sort(sketch_bins(own if len(own) >= 50 else step[g == i]))
            q1, q3 = (0.0 if x <= -20000 else 2 * GAMMA**x / (GAMMA + 1) for x in (float(b[int(q * (len(b) - 1))]) for q in (0.25, 0.75)))
            assert got[i, h] == max(q3 + 4.5 * (q3 - q1), 1e-12)
    assert np.isinf(got[3]).all()
