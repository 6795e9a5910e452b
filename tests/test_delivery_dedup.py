import json
import random

import pytest

from lumenspar.operators.delivery_dedup import STATE, SeenBitmaps, duplicates

SCHEMA = "delivery_id bigint, topic string, rec_offset bigint, payload string, message string"


def brute(rows):
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    whole = {}
    for i, topic, off, p, _ in rows:
        find(("d", i))
        if topic is not None and off is not None:
            par[find(("d", i))] = find(("o", topic, off))
        try:
            o = json.loads(p) if p else None
        except ValueError:
            o = None
        whole[i] = isinstance(o, dict)
        if whole[i] and topic is not None and all(o.get(k) is not None for k in ("producer", "epoch", "pseq")):
            par[find(("d", i))] = find(("p", topic, o["producer"], str(o["epoch"]), str(o["pseq"])))
    groups = {}
    for i in whole:
        groups.setdefault(find(("d", i)), []).append(i)
    return {i for g in groups.values() for i in g} - {min(g, key=lambda i: (not whole[i], i)) for g in groups.values()}


def payload(rng, pseq):
    o = {"producer": rng.choice("ab"), "epoch": rng.randrange(2), "pseq": rng.choice([pseq, str(pseq)])}
    s = json.dumps(o) if rng.random() < 0.8 else json.dumps(dict(reversed(o.items())), indent=1)
    return rng.choice([s, s, s, s[: rng.randrange(1, len(s))], None, "[1]", "{}"])


@pytest.mark.parametrize("seed", range(3))
def test_matches_union_find(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["x", "y", None]) if rng.random() < 0.2 else "x", rng.choice([rng.randrange(60), None]) if rng.random() < 0.3 else rng.randrange(60), payload(rng, rng.randrange(40)), "z") for i in range(300)]
    rows += rows[:10]
    got = [r[0] for r in duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_long_chain_and_hub(spark):
    j = lambda n: json.dumps({"producer": "a", "epoch": 0, "pseq": n})
    chain = [(2 * i + k, "x", i + k, j(i), "") for i in range(60) for k in (0, 1)]  # offset i and i + 1 share pseq i
    hub = [(1000 + i, "y", i, j(7), "") for i in range(200)]
    rows = chain + hub
    assert {r[0] for r in duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_batches_and_redelivered_batch(spark, tmp_path):
    j = lambda n: json.dumps({"producer": "a", "epoch": 0, "pseq": n})
    s = SeenBitmaps(spark, str(tmp_path / "seen"))
    one = spark.createDataFrame([(1, "x", 5, j(1), ""), (2, "x", 5, None, ""), (3, "x", 40000, "{", "")], SCHEMA)
    two = spark.createDataFrame([(4, "x", 9, j(1), ""), (5, "x", 40000, j(2), ""), (6, "x", 41, j(3), ""), (7, "x", 42, j("odd"), "")], SCHEMA)
    assert s.process(one, "1", str(tmp_path / "o1"))
    assert s.process(two, "2", str(tmp_path / "o2"))
    assert not s.process(two, "2", str(tmp_path / "o2")) and not s.process(one, "1", str(tmp_path / "o1"))  # an old batch is not worked again
    read = lambda n: sorted(r[0] for r in spark.read.parquet(str(tmp_path / n)).collect())
    assert (read("o1"), read("o2")) == ([1, 3], [6, 7])


def test_batches_keep_what_came_first_where_the_table_keeps_the_whole_copy(spark, tmp_path):
    j = lambda n: json.dumps({"producer": "a", "epoch": 0, "pseq": n})
    one = [(5, "x", 1, "{", ""), (6, "x", 2, j(2), ""), (7, "x", 3, j(3), "")]
    two = [(8, "x", 1, j(1), ""), (9, "x", 2, j(3), "")]  # the first whole copy of offset 1; a link of offsets 2 and 3
    s = SeenBitmaps(spark, str(tmp_path / "seen"))
    for n, rows in enumerate((one, two)):
        assert s.process(spark.createDataFrame(rows, SCHEMA), str(n), str(tmp_path / f"o{n}"))
    kept = {r[0] for n in (0, 1) for r in spark.read.parquet(str(tmp_path / f"o{n}")).collect()}
    assert kept == {5, 6, 7}
    dups = {r[0] for r in duplicates(spark.createDataFrame(one + two, SCHEMA)).collect()}
    assert dups == brute(one + two) == {5, 7, 9}


def test_empty(spark):
    assert duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dense_and_sparse_containers(spark, tmp_path):
    rows = [(i, "x", i, None, "") for i in range(5000)] + [(10_000 + i, "x", 70_000 + 40_000 * i, None, "") for i in range(5)] + [(20_000, None, 1, None, ""), (20_001, "x", None, None, "")]
    s = SeenBitmaps(spark, str(tmp_path / "seen"), groups=3)
    cut = lambda a, b: spark.createDataFrame(rows[a:b], SCHEMA)
    assert s.process(cut(0, 3000), "a", str(tmp_path / "a")) and s.process(cut(2000, len(rows)), "b", str(tmp_path / "b")) and s.process(cut(0, 5005), "c", str(tmp_path / "c"))
    read = lambda n: sorted(r[0] for r in spark.read.schema("delivery_id bigint").parquet(str(tmp_path / n)).collect())
    assert read("a") == list(range(3000)) and read("b") == list(range(3000, 5000)) + [10_000 + i for i in range(5)] + [20_000, 20_001] and read("c") == []
    got = s.read(s.manifest(), {0, 1, 2}, STATE).selectExpr("sum(case when bits is null then bitmap_count(bitmap) else size(bits) end)", "count_if(bitmap is not null)").first()
    assert tuple(got) == (5005, 1)
