import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenspar import model
from lumenspar.functions import sketch
from lumenspar.metricql import Engine, QueryError, parse
from lumenspar.metricql import syntax as S

# restated worked example: (metric, tags, samples)
DATA = [
    ("req.count", ["host:a", "route:/x"], [(0, 1), (10, 2), (20, 3), (30, 4), (40, 5), (50, 6)]),
    ("req.count", ["host:b", "route:/x"], [(0, 10), (10, 20), (20, 30), (30, 40), (40, 50), (50, 60)]),
    ("req.count", ["host:a", "route:/y"], [(0, 100), (30, 400)]),
    ("temp", ["host:a"], [(0, 20), (10, 30), (30, 40), (40, 50)]),
    ("cpu.rate", ["host:a"], [(0, 2), (10, 4)]),
    ("lat.bucket", ["upper_bound:1"], [(0, 2)]), ("lat.bucket", ["upper_bound:5"], [(0, 6)]), ("lat.bucket", ["upper_bound:10"], [(0, 10)]), ("lat.bucket", ["upper_bound:+Inf"], [(0, 10)]),
    ("neg.bucket", ["upper_bound:-10"], [(0, 1)]), ("neg.bucket", ["upper_bound:0"], [(0, 2)]), ("neg.bucket", ["upper_bound:+Inf"], [(0, 4)]),
]


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(m, t, s, float(v)) for m, t, xs in DATA for s, v in xs]
    df = spark.createDataFrame(rows, "metric string, texts array<string>, ts_s bigint, value double")
    df = df.withColumn("tags", model.parse_tags(F.col("texts"))).withColumn("series_key", model.series_key(F.col("metric"), F.col("tags"))).drop("texts").cache()
    return Engine(spark, df, {"req.count": "count", "temp": "gauge", "cpu.rate": "rate", "lat": "distribution"})


def ask(engine, q, interval, **o):
    out = {}
    for r in engine.query(q, 0, 59, interval, **o).lines.orderBy("b").collect():
        out.setdefault(r["scope"], []).append(r["v"])
    return out


@pytest.mark.parametrize(
    ("q", "interval", "want"),
    [
        ("sum:req.count{*}", 60, {"*": [731]}),
        ("sum:req.count{*} by {route}", 60, {"route:/x": [231], "route:/y": [500]}),
        ("sum:req.count{route:/x} by {route}", 30, {"route:/x": [66, 165]}),
        ("avg:req.count{route:/x} by {route}", 30, {"route:/x": [33, 82.5]}),
        ("max:req.count{route:/x}", 30, {"*": [60, 150]}),
        ("min:req.count{route:/x}", 30, {"*": [6, 15]}),
        ("count:req.count{*} by {route}", 60, {"route:/x": [2], "route:/y": [1]}),
        ("avg:temp{*}", 30, {"*": [25, 45]}),
        ("avg:temp{*}.rollup(max)", 30, {"*": [30, 50]}),
        ("avg:temp{*}.rollup(count)", 30, {"*": [2, 2]}),
        ("avg:temp{*}.rollup(last)", 30, {"*": [30, 50]}),
        ("sum:req.count{route:/x,host:a}.rollup(avg)", 30, {"*": [2, 5]}),
        ("sum:req.count{*} by {route}.as_rate()", 30, {"route:/x": [2.2, 5.5], "route:/y": [100 / 30, 400 / 30]}),
        ("avg:req.count{*} by {route}.rollup(max)", 30, {"route:/x": [16.5, 33], "route:/y": [100, 400]}),
        ("avg:temp{*}", 10, {"*": [20, 30, None, 40, 50, None]}),
        ("avg:temp{*}.fill(zero)", 10, {"*": [20, 30, 0, 40, 50, 0]}),
        ("avg:temp{*}.fill(linear)", 10, {"*": [20, 30, 35, 40, 50, None]}),
        ("avg:temp{*}.fill(last, 10)", 10, {"*": [20, 30, 30, 40, 50, 50]}),
        ("diff(avg:temp{*})", 10, {"*": [None, 10, None, None, 10, None]}),
        ("moving_avg(avg:temp{*}, 2)", 10, {"*": [20, 25, 30, 40, 45, 50]}),
        ("clamp_min(avg:temp{*}, 35)", 10, {"*": [35, 35, None, 40, 50, None]}),
        ("timeshift(avg:temp{*}, 10)", 10, {"*": [30, None, 40, 50, None, None]}),
        ("sum:req.count{host:a} by {route} / sum:req.count{*} by {route}", 60, {"route:/x": [21 / 231], "route:/y": [1]}),
        ("avg:temp{*} / 0", 60, {"*": [None]}),
        ('top(sum:req.count{*} by {route}, 1, "sum")', 60, {"route:/y": [500]}),
        ("histogram_quantile(0.5, max:lat.bucket{*} by {upper_bound})", 60, {"*": [4]}),
        ("histogram_quantile(0.9, max:lat.bucket{*} by {upper_bound})", 60, {"*": [8.75]}),
        ("histogram_quantile(0.2, max:lat.bucket{*} by {upper_bound})", 60, {"*": [1]}),
        ("histogram_quantile(1, max:lat.bucket{*} by {upper_bound})", 60, {"*": [10]}),
        ("histogram_quantile(0, max:lat.bucket{*} by {upper_bound})", 60, {"*": [0]}),
        ("histogram_quantile(0.25, max:neg.bucket{*} by {upper_bound})", 60, {"*": [-10]}),
        ("sum:req.count{route IN (/x,/z*)}", 60, {"*": [231]}),
        ("sum:req.count{!host:b}", 60, {"*": [521]}),
        ("-sum:req.count{host:b} + 1", 60, {"*": [-209]}),
        ("abs(2 - 5)", 60, {"*": [3]}),
    ],
)
def test_answers(engine, q, interval, want):
    got = ask(engine, q, interval)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v), q


def test_nothing_selected_is_no_series(engine):
    assert ask(engine, "sum:req.count{host:zz}.fill(zero)", 60) == {}
    r = engine.query("sum:req.count{*} by {route} - sum:req.count{route:/x} by {route}", 0, 59, 60)
    assert len(r.warnings()) == 1 and "route:/y" in r.warnings()[0]


def test_variables(engine):
    assert ask(engine, "sum:req.count{$R,host:a}", 60, bound={"r": ["route:/x", "route:/y"]}) == {"*": [521]}
    r = engine.query("sum:req.count{$r}", 0, 59, 60, bound={"r": []})
    assert r.warnings() and r.lines.first()["v"] == 731
    with pytest.raises(QueryError, match="bound"):
        engine.query("sum:req.count{$r}", 0, 59)


@pytest.mark.parametrize("q", ["p95:temp{*}", "sum:lat{*}", "avg:temp{*}.as_rate()", "dist:lat{*}", "timeshift(avg:temp{*}, 7)", "histogram_quantile(2, sum:lat.bucket{*} by {upper_bound})", "histogram_quantile(0.5, sum:lat.bucket{*})", "sum:temp{*}.rollup(avg, 10) + sum:temp{*}.rollup(avg, 20)"])
def test_refused(engine, q):
    with pytest.raises(QueryError):
        engine.query(q, 0, 59, 0 if "rollup" in q else 10)


@pytest.mark.parametrize(
    ("q", "col"),
    [("", 1), ("avg:http.x{service:api by {route}", 27), ("avg:x{}", 7), ("foo:x{*}", 1), ("avg:x{*}.fill(odd)", 15), ("avg:x{*} by {a,a}", 17), ("top(avg:x{*}, 1+1)", 15), ("nope(avg:x{*})", 1), ("avg:x{*}.as_rate().as_rate()", 20), ("avg:x{*}.rollup(avg, 0)", 22), ("é", 1), ("avg:x{*} avg", 10)],
)
def test_error_columns(q, col):
    with pytest.raises(QueryError) as e:
        parse(q)
    assert e.value.col == col, e.value


_name = st.from_regex(r"[a-z][a-z0-9_.]{0,6}", fullmatch=True)
_value = st.from_regex(r"[a-z0-9/*:.]{1,6}", fullmatch=True)
_matcher = st.one_of(st.builds(S.Matcher, _name, st.tuples(_value), st.booleans()), st.builds(S.Matcher, _name, st.lists(_value, min_size=1, max_size=3).map(tuple), st.booleans(), st.just(True)), st.builds(lambda v: S.Matcher(var=v), _name))
_query = st.builds(S.Query, st.sampled_from(S.AGGREGATORS), _name, st.lists(_matcher, max_size=3).map(tuple), st.lists(_name, max_size=2, unique=True).map(tuple), st.sampled_from([(), (S.Modifier("as_rate"),), (S.Modifier("rollup", "max", 60), S.Modifier("fill", "last"))]))
_num = st.integers(0, 10**6).map(lambda x: S.Number(x / 8))
_node = st.recursive(st.one_of(_query, _num), lambda n: st.one_of(st.builds(S.Binary, st.sampled_from("+-*/"), n, n), st.builds(S.Unary, n), st.builds(lambda x: S.Call("abs", (x,)), n), st.builds(lambda x, k: S.Call("top", (x, k, S.Text("sum"))), n, _num)), max_leaves=6)


@settings(max_examples=300, deadline=None)
@given(_node)
def test_parsing_what_was_printed_is_the_identity(n):
    assert parse(str(n)) == n


def test_sketch_error_and_merge(spark):
    vals = [((-1) ** i) * (i**1.5) for i in range(4000)] + [0.0] * 50
    df = spark.createDataFrame([(i % 7, v) for i, v in enumerate(vals)] + [(1, None)], "g int, v double")
    whole = sketch.bins(df, [], "v")
    merged = sketch.merge(sketch.bins(df, ["g"], "v"), [])
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in merged.collect()}
    qs = {f"q{i}": q for i, q in enumerate((0, 0.05, 0.5, 0.9, 0.99, 1))}
    got = sketch.quantiles(whole.selectExpr("1 as k", "*"), sketch.exact(df, [], "v").selectExpr("1 as k", "*"), ["k"], qs).first()
    s = sorted(vals)
    for c, q in qs.items():
        want = s[int(q * (len(s) - 1))]
        assert abs(got[c] - want) <= sketch.ALPHA * abs(want) * 1.01 + 1e-9
    c = sketch.collapse(whole.selectExpr("1 as k", "*"), ["k"], 16)
    assert c.groupBy("sign").count().where("count > 16").count() == 0
    assert c.agg({"count": "sum"}).first()[0] == len(vals)
