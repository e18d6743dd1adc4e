import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators.timejoin import asof_nearest, interp_join, sync_streams, update_from_nearest
from furrow.plans.skew import carry, exact_quantiles, ordinal


def brute(left, right, tol):
    out = {}
    for lid, k, t in left:
        near = sorted((abs(rt - t), rt, rid) for rid, rk, rt in right if rk == k)
        out[lid] = near[0][2] if near and (tol is None or near[0][0] <= tol) else None
    return out


@pytest.fixture(params=[1, 3, 40])
def ranges(spark, request):
    """Number of ranges a carry cuts into, without merging small ones."""
    before = {k: spark.conf.get(k) for k in (
        "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("tol", [5, None, 0])
def test_asof_equals_brute_force_with_a_hot_key(spark, ranges, tol):
    rng = random.Random(1)
    key = lambda: "hot" if rng.random() < 0.5 else rng.choice("abc")
    left = [(i, key(), rng.randrange(400)) for i in range(400)]
    right = [(i, key(), rng.randrange(400)) for i in range(200)]
    ldf = spark.createDataFrame(left, "lid int, k string, t long")
    rdf = spark.createDataFrame(right, "rid int, k string, t long")
    out = asof_nearest(ldf, rdf, "t", ["k"], tol, order=["rid"])
    assert {r["lid"]: r["r_rid"] for r in out.collect()} == brute(left, right, tol)


def test_ties_and_inclusive_bound(spark):
    left = spark.createDataFrame([(1, 10.0), (2, 21.0), (3, 31.5)], "lid int, t double")
    right = spark.createDataFrame([("a", 9.0), ("b", 11.0), ("c", 20.0), ("d", 30.0)], "rid string, t double")
    out = asof_nearest(left, right, "t", tolerance=1.0, order=["rid"])
    assert {r["lid"]: r["r_rid"] for r in out.collect()} == {1: "a", 2: "c", 3: None}


def test_copies_and_partitions_do_not_matter(spark):
    left = spark.createDataFrame([(i, "k", 100) for i in range(50)], "lid int, k string, t long")
    right = spark.createDataFrame([(i, "k", 100 + i % 2) for i in range(60)], "rid int, k string, t long")
    seen = set()
    for n in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out = asof_nearest(left, right, "t", ["k"], 5, order=["rid"])
        seen.add(tuple(sorted((r["lid"], r["r_rid"]) for r in out.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen == {tuple((i, 0) for i in range(50))}


def test_update_keeps_values_where_the_match_is_null(spark):
    images = spark.createDataFrame([(1, 0.0, 1.0, 1.0, 1.0), (2, 100.0, 2.0, 2.0, 2.0)], "id int, t double, lat double, lon double, alt double")
    drone = spark.createDataFrame([(5.0, None, 9.0, None, 7.0), (105.1, 8.0, 8.0, 8.0, 8.0)], "t double, lat double, lon double, alt double, altitude double")
    out = update_from_nearest(images, drone, "t", tolerance=5.0).orderBy("id").collect()
    assert tuple(out[0])[2:] == (1.0, 9.0, 7.0)
    assert tuple(out[1])[2:] == (2.0, 2.0, 2.0)


def test_interpolation_extends_both_ends(spark, ranges):
    right = spark.createDataFrame([(10.0, 1.0), (20.0, 3.0), (40.0, 1.0)], "t double, v double")
    stamps = [0.0, 10.0, 15.0, 20.0, 30.0, 40.0, 50.0]
    left = spark.createDataFrame([(t,) for t in stamps], "t double")
    out = {r["t"]: r["v"] for r in interp_join(left, right, "t", ["v"]).collect()}
    assert [out[t] for t in stamps] == [-1.0, 1.0, 2.0, 3.0, 2.0, 1.0, 0.0]


def test_a_single_sample_cannot_be_interpolated(spark):
    right = spark.createDataFrame([(10.0, 1.0)], "t double, v double")
    left = spark.createDataFrame([(5.0,), (10.0,)], "t double")
    assert [r["v"] for r in interp_join(left, right, "t", ["v"]).collect()] == [None, None]


def test_sync_drops_rows_without_partner(spark):
    first = spark.createDataFrame([(0,), (10,), (20,), (100,)], "t long")
    second = spark.createDataFrame([(1, "a"), (12, "b"), (23, "c")], "t long, n string")
    third = spark.createDataFrame([(0, "x"), (21, "y")], "t long, n string")
    out = sync_streams([first, second, third], "t", threshold=5)
    assert sorted((r["t"], r["s1_n"], r["s2_n"]) for r in out.collect()) == [(0, "a", "x"), (20, "c", "y")]
    free = sync_streams([first, second, third], "t", threshold=None)
    assert sorted((r["t"], r["s1_n"], r["s2_n"]) for r in free.collect()) == [
        (0, "a", "x"), (10, "b", "x"), (20, "c", "y"), (100, "c", "y")]
    period = sync_streams([first, second], "t")
    assert period.count() == 3


def test_carry_across_ranges_without_values(spark, collect, ranges):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 50, None), ("k", 99, "z"), ("j", 5, None)], "k string, t long, v string")
    out = carry(df, ["k"], "t", {"p": "v"}, {"n": "v"})
    assert collect(out.select("k", "t", "p", "n"), "k", "t") == [
        ("j", 5, None, None), ("k", 1, None, "z"), ("k", 50, "a", "z"), ("k", 99, "a", None)]


def test_carry_two_deep_and_several_columns_equals_brute_force(spark, ranges):
    rng = random.Random(4)
    stamps = {k: rng.sample(range(900), n) for k, n in (("hot", 300), ("a", 40), (None, 60))}
    data = [(k, t, t if rng.random() < 0.1 else None, -t if rng.random() < 0.3 else None)
            for k, own in stamps.items() for t in own]
    df = spark.createDataFrame(data, "k string, t long, v long, w long")
    out = carry(df, ["k"], "t", {"pv": "v", "pw": "w"}, {"nv": "v"}, depth=2).collect()
    assert len(out) == len(data)
    deep = lambda found: tuple([*found, None, None][:2])
    for r in out:
        own = sorted(d for d in data if d[0] == r["k"])
        before, after = [d for d in own[::-1] if d[1] < r["t"]], [d for d in own if d[1] > r["t"]]
        assert (r["pv"], r["pv_2"]) == deep([d[2] for d in before if d[2] is not None])
        assert (r["pw"], r["pw_2"]) == deep([d[3] for d in before if d[3] is not None])
        assert (r["nv"], r["nv_2"]) == deep([d[2] for d in after if d[2] is not None])


def test_rows_without_stamp_or_key(spark, ranges):
    left = spark.createDataFrame([(1, None, 5), (2, "k", None), (3, None, None), (4, "k", 7)], "lid int, k string, t long")
    right = spark.createDataFrame([(1, None, 4), (2, "k", 9), (3, "k", None)], "rid int, k string, t long")
    out = asof_nearest(left, right, "t", ["k"], order=["rid"])
    assert {r["lid"]: r["r_rid"] for r in out.collect()} == {1: 1, 2: None, 3: None, 4: 2}
    inner = asof_nearest(left, right, "t", ["k"], order=["rid"], how="inner")
    assert sorted(r["lid"] for r in inner.collect()) == [1, 4]
    empty = asof_nearest(left, right.limit(0), "t", ["k"], order=["rid"])
    assert sorted((r["lid"], r["r_rid"]) for r in empty.collect()) == [(i, None) for i in (1, 2, 3, 4)]
    assert asof_nearest(left.limit(0), right, "t", ["k"], order=["rid"]).count() == 0


def test_ordinals_with_a_hot_key(spark):
    rng = random.Random(2)
    data = [(i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.randrange(50)) for i in range(3000)]
    df = spark.createDataFrame(data, "id int, k string, v int").repartition(5)
    out = ordinal(df, ["v", "id"], ["k"], "n")
    got = {r["id"]: r["n"] for r in out.collect()}
    want = {}
    for k in {d[1] for d in data}:
        for n, d in enumerate(sorted((d for d in data if d[1] == k), key=lambda d: (d[2], d[0]))):
            want[d[0]] = n
    assert got == want


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=101), "b": rng.normal(size=1), "c": np.repeat(2.5, 40)}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "k string, x double")
    out = exact_quantiles(df, "x", ["k"], {"lo": 0.05, "mid": 0.37, "hi": 0.95})
    for r in out.collect():
        assert [r["lo"], r["mid"], r["hi"]] == pytest.approx(list(np.quantile(values[r["k"]], [0.05, 0.37, 0.95])))
