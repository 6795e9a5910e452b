import random

import pytest

from lumenspar.operators.late_events import LateEventStore, late_event_aggregates, outcomes

P = 300_000


def brute(rows):
    """Per (k, period): what was published, what is final, how many late and cut off."""
    first = {}
    for k, t, v, a, tie in rows:
        if t is None or v is None or a is None or v != v:
            continue
        if (k, t) not in first or (a, tie, v) < first[k, t]:
            first[k, t] = (a, tie, v)
    groups = {}
    for (k, t), (a, _, v) in first.items():
        groups.setdefault((k, t - t % P), []).append((t, v, a))
    out = {}
    for (k, p), rs in groups.items():
        rs.sort()
        end = (p + P) * 1000
        on = [v for t, v, a in rs if a <= end + 60_000_000]
        live = [v for t, v, a in rs if a <= end + 7_200_000_000]
        rise = lambda x: sum(max(0, b - a) for a, b in zip(x, x[1:]))
        agg = lambda x: (len(x), sum(x), min(x), max(x), x[-1], rise(x)) if x else (0, *[None] * 5)
        out[k, p] = agg(on) + agg(live) + (len(live) - len(on), len(rs) - len(live))
    return out


@pytest.mark.parametrize("every", [1, 3, 8, 1000])
def test_matches_brute_force(spark, every):
    rng = random.Random(every)
    rows = []
    for _ in range(3000):
        k = rng.choice([1, 1, 1, 2, None])
        t = rng.randrange(0, 6 * P) - 2 * P
        delay = rng.choice([-5, 1, 30, 500, 4000, 9000]) * 1000
        rows.append((k, rng.choice([t, t, None]) if rng.random() < 0.05 else t, rng.choice([None, float("nan")]) if rng.random() < 0.05 else float(rng.randrange(100)), (t + delay) * 1000 if rng.random() > 0.02 else None, rng.randrange(5)))
    rows += rows[:200]  # repeated rows
    rows += [(k, t, v, a and a + 1, tie) for k, t, v, a, tie in rows[:200]]  # written again later
    df = spark.createDataFrame([(*r, "x") for r in rows], "key bigint, t bigint, v double, arrival bigint, tie int, period_start string")
    got = {(r["key"], r["period_start"]): r for r in late_event_aggregates(df, "key", tie="tie", checkpoint_every=every).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for k, w in want.items():
        r = got[k]
        g = tuple(r[c] for c in ("n_first", "sum_first", "min_first", "max_first", "last_first", "rise_first", "n", "sum", "min", "max", "last", "rise", "n_late", "n_cut"))
        assert g == pytest.approx(w), k


def test_replay_restores_the_preceding_checkpoint(spark):
    rows = [(1, i * 1000, float(i), i * 1_000_000, 0) for i in range(100)] + [(1, 95_500, 7.0, (P + 100_000) * 1000, 0)]
    r = late_event_aggregates(spark.createDataFrame(rows, "key bigint, t bigint, v double, arrival bigint, tie int"), "key").collect()[0]
    assert (r["n_first"], r["n"], r["n_late"]) == (100, 101, 1)
    assert r["replayed"] == 5  # readings 96..99 and the late one: 96 on-time readings came from the checkpoint


def test_empty_and_outcomes(spark):
    df = spark.createDataFrame([], "key string, t bigint, v double, arrival bigint")
    assert late_event_aggregates(df, "key").count() == 0
    df = spark.createDataFrame([("a", 0, 1.0, (P + 61_000) * 1000), ("a", 1, 1.0, (P + 7_200_001) * 1000), ("b", 0, 1.0, (P + 60_000) * 1000)], "key string, t bigint, v double, arrival bigint")
    assert {tuple(r) for r in outcomes(late_event_aggregates(df, "key"), "key").collect()} == {("a", 0, "corrected"), ("a", 0, "cut_off")}


def test_store_replaces_the_periods_a_batch_touches(spark, tmp_path):
    rng = random.Random(8)
    schema = "key bigint, t bigint, v double, arrival bigint, tie bigint"
    rows = []
    for _ in range(1500):
        t = rng.randrange(0, 4 * P)
        rows.append((rng.choice([1, 1, 2, None]), t, rng.choice([None, float(rng.randrange(50)), 7.0]), (t + rng.choice([1, 30, 500, 4000, 9000]) * 1000) * 1000 + rng.randrange(1000), rng.randrange(3)))
    rows.sort(key=lambda r: r[3])
    store, latest, touched = LateEventStore(spark, str(tmp_path / "state"), groups=3), {}, []
    for i in range(4):
        df = spark.createDataFrame(rows[i * 375 : (i + 1) * 375], schema)
        assert store.process(df, f"b{i}", str(tmp_path / f"o{i}"), "key", tie="tie")
        got = spark.read.parquet(str(tmp_path / f"o{i}")).collect()
        touched.append(len(got))
        latest |= {(r["key"], r["period_start"]): tuple(r)[:-1] for r in got}
    assert not store.process(df, "b0", str(tmp_path / "o0"), "key", tie="tie") and spark.read.parquet(str(tmp_path / "o0")).count() == touched[0]
    want = {(r["key"], r["period_start"]): tuple(r)[:-1] for r in late_event_aggregates(spark.createDataFrame(rows, schema), "key", tie="tie").collect()}
    assert set(latest) == set(want) and all(latest[k] == pytest.approx(w) for k, w in want.items())
    far = spark.createDataFrame([(9, 10**10, 1.0, 10**13, 0), (1, 0, 1.0, 10**13, 0)], schema)  # the old periods are final now
    assert store.process(far, "far", str(tmp_path / "far"), "key", tie="tie") and [r["key"] for r in spark.read.parquet(str(tmp_path / "far")).collect()] == [9]
    assert store.process(far.where("false"), "none", str(tmp_path / "none"), "key", tie="tie")
