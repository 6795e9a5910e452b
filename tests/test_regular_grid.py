import random

import pytest

from lumenspar.operators import regular_grid as grid


def regular_grid(df, key, **options):
    """Readings that carry their step and kind."""
    return grid.regular_grid(df, df.select(key, "step_ms", "kind").distinct(), key, **options)


def brute(rows, step):
    keys = {}
    for k, t, v, kind in rows:
        if t is not None and v is not None and v == v:
            keys.setdefault((k, kind), []).append((t, v))
    out = {}
    for (k, kind), rs in keys.items():
        rs.sort()
        lo, hi = rs[0][0] // step, rs[-1][0] // step
        for s in range(lo, hi + 1):
            inside = [v for t, v in rs if t // step == s]
            inc = None
            for (t, v), (nt, nv) in zip(rs, rs[1:]):
                d = nv if nv < v else nv - v
                if nt == t:
                    part = d if t // step == s else None
                else:
                    lap = min(nt, (s + 1) * step) - max(t, s * step)
                    part = d * lap / (nt - t) if lap > 0 or (nt // step == s and nt == s * step and lap == 0) or t // step == s else None
                if part is not None:
                    inc = (inc or 0) + part
            out[k, s * step] = ("observed" if inside else "missing", len(inside), sum(inside) / len(inside) if inside and kind != "counter" else None, inc if kind == "counter" else None)
    return out


@pytest.mark.parametrize("segment", [10, 35, 21_600_000])
def test_matches_brute_force(spark, segment):
    rng = random.Random(segment)
    rows = []
    for k, kind in (("a", "counter"), ("b", "gauge"), ("c", None), (None, "counter")):
        t, c = -500, 0.0
        for _ in range(150):
            t += rng.choice([0, 1, 5, 9, 10, 11, 40, 95])
            c = rng.choice([c + rng.randrange(9), 0.0 if rng.random() < 0.1 else c])
            rows.append((k, t, c, kind))
    rows += [("a", None, 1.0, "counter"), ("b", 3, None, "gauge"), ("one", 7, 5.0, "counter")]
    df = spark.createDataFrame([(*r, 10, "x") for r in rows], "key string, t bigint, v double, kind string, step_ms bigint, slot string")
    got = {(r["key"], r["slot_start"]): r for r in regular_grid(df, "key", segment_ms=segment, fill="null").collect()}
    want = brute(rows, 10)
    assert set(got) == set(want)
    for k, (status, n, value, inc) in want.items():
        r = got[k]
        assert (r["status"], r["n"]) == (status, n), k
        if status == "observed":
            assert r["value"] == pytest.approx(value), k
        if status == "missing" or (inc is not None and k[0] != "one"):
            assert (r["increment"] or 0) == pytest.approx(inc or 0), k


def test_counter_total_is_kept(spark):
    rows = [("a", t, float(v)) for t, v in ((0, 0), (25, 10), (61, 40), (99, 5), (170, 30))]
    df = spark.createDataFrame([(*r, 10, "counter") for r in rows], "key string, t bigint, v double, step_ms bigint, kind string")
    assert regular_grid(df, "key").agg({"increment": "sum"}).first()[0] == pytest.approx(10 + 30 + 5 + 25)


def test_fill_and_empty(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 10, "gauge"), ("a", 45, 9.0, 10, "gauge")], "key string, t bigint, v double, step_ms bigint, kind string")
    lin = {r["slot_start"]: r["value"] for r in regular_grid(df, "key").where("status = 'missing'").collect()}
    assert lin == pytest.approx({10: 3.0, 20: 5.0, 30: 7.0})
    assert {r["value"] for r in regular_grid(df, "key", fill="last").where("status = 'missing'").collect()} == {0.0}
    assert regular_grid(df.where("false"), "key").count() == 0


def test_first_by_and_unknown_sources(spark):
    df = spark.createDataFrame([("a", 0, 5.0, 2, 10, "counter"), ("a", 0, 1.0, 1, 10, "counter"), ("a", 20, 4.0, 3, 10, "counter"), ("b", 1, 1.0, 1, 0, "gauge")], "key string, t bigint, v double, by bigint, step_ms bigint, kind string")
    got = {(r["key"], r["slot_start"]): (r["status"], r["n"], r["increment"]) for r in regular_grid(df, "key", first_by=("by",)).collect()}
    assert got == {("a", 0): ("observed", 1, 1.5), ("a", 10): ("missing", 0, 1.5), ("a", 20): ("observed", 1, 0.0)}
