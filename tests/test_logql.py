import fnmatch
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenspar.logql import LogQueryError, compile_filter, parse
from lumenspar.logql import syntax as S
from lumenspar.logql.compile import flatten
from lumenspar.operators import logs


def texts(v):
    return [x for d in v.values() for x in texts(d)] if isinstance(v, dict) else [x for d in v for x in texts(d)] if isinstance(v, list) else [v] if isinstance(v, str) else []


def match(n, r, flat):
    if isinstance(n, S.All):
        return True
    if isinstance(n, S.And):
        return all(match(x, r, flat) for x in n.nodes)
    if isinstance(n, S.Or):
        return any(match(x, r, flat) for x in n.nodes)
    if isinstance(n, S.Not):
        return not match(n.node, r, flat)
    g = lambda s, p: fnmatch.fnmatchcase(s, p.replace("[", "[[]").replace("?", "[?]"))
    if isinstance(n, S.Label):
        v = next((t[4:] for t in r["tags"] or [] if t.startswith("env:")), "") if n.key == "env" else r[n.key] or ""
        return v != "" if n.value == "*" else g(v, n.value)
    if isinstance(n, S.Text):
        return any(g(x.lower(), f"*{n.text.lower()}*") for x in [r["message"] or "", *(t for p, t, _, s, _ in flat if s)])
    vals = [(t, x) for p, t, x, _, obj in flat if p == n.path and not obj]
    if n.op == "range":
        return any(x is not None and n.lo <= x <= n.hi for _, x in vals)
    if n.op != "=":
        return any(x is not None and {">": x > n.lo, ">=": x >= n.lo, "<": x < n.lo, "<=": x <= n.lo}[n.op] for _, x in vals)
    if n.value == "*":
        return bool(vals)
    try:
        num = float(n.value)
    except ValueError:
        num = None
    return any(g(t, n.value) or (num is not None and x == num) for t, x in vals)


QUERIES = ["", "service:api", "service:a* -host:h1", "status:error OR status:warn", "time*out", '"REFUSED by"', "@ms:250", "@ms:>100", "@ms:[10 TO 300]", "-@ms:>100", "@http.status:5*", "@items.sku:B2", "@x:*", "@flag:true", "@n:null", "env:dev", "-env:*", "(service:api OR @ms:<20) NOT refused", "@http:*", "trace_id:ab*", "@ms:2.5e2", "host:*", "100%", "a_b"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(150):
        attrs = {k: v for k, v in {"ms": rng.choice([5, 250, 250.0, 300, "250"]), "http": {"status": rng.choice([200, 503])}, "items": [{"sku": "A1"}, {"sku": rng.choice(["B2", "C3"])}], "x": rng.choice(["timeout", "refused by peer", "100%", "axb"]), "flag": rng.random() < 0.5, "n": None, "http.status": "500"}.items() if rng.random() < 0.6}
        a = json.dumps(attrs) if rng.random() < 0.9 else rng.choice([None, "", "{broken", "[1]"])
        out.append({"seq": i, "ts": 1000 * (i // 3), "message": rng.choice(["connection Refused BY peer", "time is out", None, "", "ok a_b"]), "status": rng.choice(["error", "warn", "info"]), "service": rng.choice(["api", "app", "worker", None]), "source": "s", "host": rng.choice(["h1", "h2", ""]), "tags": rng.choice([["env:dev", "env:prod"], ["x"], [], None]), "attrs": a, "trace_id": rng.choice(["abcd", None]), "span_id": None})
    return out


SCHEMA = "seq bigint, ts bigint, message string, status string, service string, source string, host string, tags array<string>, attrs string, trace_id string, span_id string"


def test_brute_force(spark, rows):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).cache()
    for q in QUERIES:
        want = {r["seq"] for r in rows if match(parse(q), r, flatten(r["attrs"]))}
        assert {r["seq"] for r in compile_filter(df, q).collect()} == want, q


def test_pages_cover_everything_once(spark, rows):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).cache()
    for newest in (True, False):
        seen, after = [], ""
        while True:
            page = logs.search(df, "-status:warn", 0, 10**9, 17, newest, after).collect()
            if not page:
                break
            seen += [(r["ts"], r["seq"]) for r in page]
            after = logs.cursor(*seen[-1])
        assert seen == sorted(((r["ts"], r["seq"]) for r in rows if r["status"] != "warn"), reverse=newest)
    h = logs.histogram(df, "", 0, 10**9, 7000, "@items.sku").collect()
    assert sum(r["n"] for r in h) == len(rows)
    assert logs.auto_step(0, 3_600_000) == 60_000
    f = {(r["key"], r["value"]): r["n"] for r in logs.facets(df, "", ["@items.sku", "host"], 0, 10**9, 10).collect()}
    assert f["@items.sku", "A1"] == sum("A1" in (r["attrs"] or "") for r in rows)
    assert ("host", "") not in f


@pytest.mark.parametrize(("q", "col"), [("level:error", 1), ("a (b", 5), ("- a", 1), ('"open', 1), ("@x", 1), ("@x:[5 TO 1]", 4), ("a OR", 5), ("@x:>abc", 5), ("service:", 9)])
def test_errors(q, col):
    with pytest.raises(LogQueryError) as e:
        parse(q)
    assert e.value.col == col


_word = st.from_regex(r"[a-z*]{1,5}", fullmatch=True)
_atom = st.one_of(st.builds(S.Text, st.one_of(_word, st.text(min_size=1, max_size=4).filter(lambda s: "\x00" not in s))), st.builds(S.Label, st.sampled_from(S.LABELS), _word), st.builds(lambda p, v: S.Attr(p, "=", v), _word, _word), st.builds(lambda p, o, x: S.Attr(p, o, lo=float(x)), _word, st.sampled_from([">", ">=", "<", "<="]), st.integers(-9, 9)), st.builds(lambda p, a, b: S.Attr(p, "range", lo=float(min(a, b)), hi=float(max(a, b))), _word, st.integers(-9, 9), st.integers(-9, 9)))
_tree = st.recursive(_atom, lambda n: st.one_of(st.builds(S.Not, n), st.builds(S.And, st.lists(n, min_size=2, max_size=3).map(tuple)), st.builds(S.Or, st.lists(n, min_size=2, max_size=3).map(tuple))), max_leaves=6)


@settings(max_examples=300, deadline=None)
@given(_tree)
def test_parsing_what_was_printed_is_the_identity(n):
    assert parse(str(n)) == n
