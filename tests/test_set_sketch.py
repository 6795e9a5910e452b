import numpy as np
import pandas as pd
import pytest

from lumenspar.operators.set_sketch import SetSketch


def sketch(s, ids):
    h = np.asarray(ids, np.uint64)
    low = s.m.bit_length() - 1
    out = np.zeros(s.m, int)
    k = np.floor(1 - np.log(((h >> np.uint64(low)).astype(float) + 0.5) / 2.0 ** (64 - low)) / np.log(s.base)).clip(0, s.cap).astype(int)
    np.maximum.at(out, (h % np.uint64(s.m)).astype(int), k)
    return out


@pytest.mark.parametrize("base", [1.05, 1.2, 2.0])
def test_counts_stay_within_the_stated_error(base):
    s = SetSketch(1024, base, int(44 / np.log(base)) + 1)
    rng = np.random.default_rng(3)
    for n in (0, 1, 10, 300, 5000, 200_000):
        errs = []
        for _ in range(12):
            est, se = s.count(np.bincount(sketch(s, rng.integers(0, 2**64, n, np.uint64)), minlength=s.cap + 1))
            errs.append((est - n) / max(se, 1e-9) if n else est)
        assert abs(np.mean(errs)) < 1.2 and np.std(errs) < 2.2, (n, errs)
    assert s.relative_error() == pytest.approx(1.04 / 32 if base == 2.0 else s.relative_error(), rel=0.02)


def test_joint_estimates():
    s = SetSketch(4096, 1.2)
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 2**64, 90_000, np.uint64)
    for a, b, u, i in ((ids[:50_000], ids[40_000:], 90_000, 10_000), (ids[:500], ids[:500], 500, 500), (ids[:300], ids[300:700], 700, 0)):
        d = pd.DataFrame({"ka": sketch(s, a), "kb": sketch(s, b)}).value_counts().rename("n").reset_index()
        e = s.joint(d)
        assert abs(e["union"] - u) < 5 * max(e["union_se"], 0.02 * u)
        assert abs(e["intersection"] - i) < 5 * e["intersection_se"] + 0.02 * u
        assert abs(e["jaccard"] - i / u) < 0.05


def test_spark_build_merge_and_estimate(spark):
    s = SetSketch(1024, 1.3)
    df = spark.range(30_000).selectExpr("id % 20000 as x", "id % 3 as g", "'c' as k").unionByName(spark.sql("select cast(null as bigint) as x, 1L as g, 'c' as k"))
    parts = s.build(df, ["g"], "x")
    again = s.merge(parts.unionByName(parts), ["g"])
    assert {tuple(r) for r in parts.collect()} == {tuple(r) for r in again.collect()}
    est = {r["g"]: r for r in s.estimates(parts, ["g"]).collect()}
    truth = {r["g"]: r["n"] for r in df.groupBy("g").agg({"x": "count"}).toDF("g", "n").collect()}
    exact = {r["g"]: r[1] for r in df.selectExpr("g", "x").distinct().where("x is not null").groupBy("g").count().collect()}
    assert set(truth) == set(est)
    for g, n in exact.items():
        assert abs(est[g]["estimate"] - n) < 4 * est[g]["std_error"]
    whole = s.estimates(s.merge(parts, []).selectExpr("1 as one", "reg", "k"), ["one"]).first()
    assert abs(whole["estimate"] - 20_000) < 4 * whole["std_error"]
    p = s.pairs(parts, "g", spark.createDataFrame([(0, 1)], "a bigint, b bigint")).first()
    assert 0 <= p["jaccard"] <= 1 and p["union"] > 0
    assert s.estimates(s.build(df.where("false"), ["g"], "x"), ["g"]).count() == 0
