"""Bucketed scans against brute force, whatever the bucket size."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajq.operators import asof, rows, windows
from trajq.plans import lineage, ordered
from trajq.plans.quantiles import exact_quantiles

MS = 1_000_000


def seq(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_causal_fixture(spark):
    src = seq(spark, [(1, "s", i, t) for i, t in enumerate([10, 20, 20, 40])], "k int, stream string, sample_idx long, t_ns long")
    ticks = seq(spark, [(1, t) for t in (9, 10, 19, 20, 39, 40, 55)], "k int, t_ns long")
    for size in (7, 1000):
        out = asof.asof_causal(ticks, src, ["k"], ["s"], max_age=10, size=size).orderBy("t_ns").collect()
        assert [r.last_s.sample_idx if r.last_s else 0 for r in out] == [0, 0, 0, 2, 2, 3, 3]
        assert [r.valid_s for r in out] == [False, True, True, True, False, True, False]


@pytest.mark.parametrize("size", [3, 17, 100000])
def test_nearest_matches_brute_force(spark, size):
    rng = random.Random(size)
    data = {s: sorted(rng.sample(range(300), 25)) for s in ("a", "b")}
    ticks = list(range(0, 300, 4))
    src = seq(spark, [(1, s, i, t) for s, ts in data.items() for i, t in enumerate(ts)], "k int, stream string, sample_idx long, t_ns long")
    grid = seq(spark, [(1, i, t) for i, t in enumerate(ticks)], "k int, tick long, t_ns long")
    for tie in ("earlier", "later"):
        out = asof.asof_nearest(grid, src, ["k"], ["a", "b"], size=size, tie=tie).collect()
        assert len(out) == len(ticks)
        for r in out:
            for s in ("a", "b"):
                gaps = [abs(t - r.t_ns) for t in data[s]]
                best = [i for i, g in enumerate(gaps) if g == min(gaps)]
                assert r[f"gap_{s}"] == min(gaps)
                assert r[f"near_{s}"].sample_idx == (best[0] if tie == "earlier" else best[-1])


def runs_of(ids, step):
    out = []
    for i in sorted(ids):
        if out and i - out[-1][-1] <= step:
            out[-1].append(i)
        else:
            out.append([i])
    return out


@pytest.mark.parametrize("size", [2, 5, 1000])
@pytest.mark.parametrize("step", [1, 2])
def test_runs_match_brute_force(spark, size, step):
    rng = random.Random(size * 10 + step)
    ids = {k: [i for i in range(120) if rng.random() < 0.7] for k in (1, 2)}
    df = seq(spark, [(k, i) for k, v in ids.items() for i in v], "k int, idx long")
    want = {(k, g[0], g[-1], len(g)) for k, v in ids.items() for g in runs_of(v, step)}
    table = ordered.runs(df, ["k"], "idx", max_step=step, size=size, agg={"top": ("max", F.col("idx"))}).collect()
    assert {(r.k, r.run_start, r.run_end, r.run_len) for r in table} == want
    assert len(table) == len(want) and all(r.top == r.run_end for r in table)
    per_row = ordered.runs(df, ["k"], "idx", max_step=step, size=size, rows=True).collect()
    assert {(r.k, r.run_start, r.run_end, r.run_len) for r in per_row} == want
    assert len(per_row) == sum(len(v) for v in ids.values())


def test_contiguous_runs_keep_50_and_51(spark):
    valid = [True] * 49 + [False] + [True] * 50 + [False] + [True] * 51
    df = seq(spark, [(1, i, v) for i, v in enumerate(valid)], "k int, idx long, valid boolean")
    out = windows.contiguous_runs(df, ["k"], "idx", F.col("valid"), size=16)
    assert sorted(r.n for r in out.groupBy("run_start").agg(F.count("*").alias("n")).collect()) == [50, 51]


def test_segments_fixture(spark):
    on = {2, 3, 4, 5, 7, 8, 15, 16, 17}
    df = seq(spark, [(1, i, i / 10, i in on) for i in range(20)], "k int, idx long, t double, on boolean")
    out = windows.segments(df, ["k"], "idx", F.col("on"), F.col("t"), size=4).orderBy("start").collect()
    assert [(round(r.start, 6), round(r.end, 6)) for r in out] == [(0.2, 0.8), (1.5, 1.7)]


def bridged(valid, fillable, max_gap):
    out = list(valid)
    ids = [i for i, v in enumerate(valid) if v]
    for a, b in zip(ids, ids[1:]):
        if 0 < b - a - 1 <= max_gap and all(fillable[a + 1:b]):
            out[a + 1:b] = [True] * (b - a - 1)
    return out


@pytest.mark.parametrize("max_gap", [0, 1, 3, 8])
def test_bridge_gaps_matches_brute_force(spark, max_gap):
    rng = random.Random(max_gap)
    valid = [rng.random() < 0.5 for _ in range(200)]
    fillable = [rng.random() < 0.85 for _ in range(200)]
    df = seq(spark, [(1, i, v, f) for i, (v, f) in enumerate(zip(valid, fillable))], "k int, idx long, ok boolean, fill boolean")
    for size in (4, 50):
        out = windows.bridge_gaps(df, ["k"], "idx", F.col("ok"), F.col("fill"), max_gap, size=size).orderBy("idx").collect()
        assert [r.valid for r in out] == bridged(valid, fillable, max_gap)


@pytest.mark.parametrize("size", [3, 64])
def test_horizon_and_offsets(spark, size):
    lengths = {1: 7, 2: 30}
    df = seq(spark, [(e, i, float(10 * e + i)) for e, n in lengths.items() for i in range(n)], "e int, i long, x double")
    for r in windows.action_horizon(df, ["e"], "i", F.col("x"), horizon=5, size=size).collect():
        last = lengths[r.e] - 1
        assert r.chunk == [10 * r.e + min(r.i + k, last) for k in range(5)]
        assert r.chunk_is_pad == [r.i + k > last for k in range(5)]
    offsets = {"base": -100, "now": 0, "next": 6}
    for r in windows.delta_offsets(df, ["e"], "i", F.col("x"), offsets, size=size).collect():
        last = lengths[r.e] - 1
        for n, o in offsets.items():
            assert r[n] == 10 * r.e + min(max(r.i + o, 0), last)
            assert r[f"{n}_is_pad"] == (not 0 <= r.i + o <= last)


def test_fill_and_row_index_do_not_depend_on_buckets(spark):
    rng = random.Random(5)
    data = [(k, t, rng.choice([None, float(t)])) for k in (1, 2) for t in rng.sample(range(100), 40)]
    df = seq(spark, data, "k int, t long, v double")
    for backward in (False, True):
        seen = None
        for size in (1, 9, 1000):
            out = ordered.fill(df, ["k"], "t", {"f": F.col("v")}, size=size, inclusive=False, backward=backward)
            got = sorted((r.k, r.t, r.f) for r in out.select("k", "t", F.coalesce("f", F.lit(-1.0)).alias("f")).collect())
            assert seen is None or seen == got
            seen = got
    idx = ordered.row_index(df, ["k"], "t", "n", size=7).orderBy("k", "t").collect()
    assert [r.n for r in idx] == list(range(40)) * 2


def test_global_index_is_the_total_order(spark):
    names = [f"episode_{i}" for i in range(200)]
    df = seq(spark, [(n,) for n in names], "name string").repartition(7)
    out = {r.name: r.i for r in ordered.global_index(df, ["name"], "i").collect()}
    assert [out[n] for n in sorted(names)] == list(range(200))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 3000])
def test_quantiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    values = {"cont": rng.normal(size=n), "ties": rng.integers(0, 3, size=n).astype(float), "flat": np.zeros(n)}
    df = seq(spark, [(k, float(x)) for k, v in values.items() for x in v], "k string, x double")
    asked = {"a": 0.0, "b": 0.01, "c": 0.05, "d": 0.5, "e": 0.9, "f": 0.999, "g": 1.0}
    for accuracy in (100, 10_000):
        for r in exact_quantiles(df, ["k"], F.col("x"), asked, accuracy=accuracy).collect():
            assert r.n == n
            for name, q in asked.items():
                assert r[name] == pytest.approx(np.percentile(values[r.k], 100 * q), abs=1e-9)


def test_interval_join_and_ranges(spark):
    s = seq(spark, [(1, t) for t in range(0, 100, 3)], "k int, t_ns long")
    iv = seq(spark, [(1, 0, 10, 40), (1, 1, 35, 36), (1, 2, 50, 20)], "k int, c int, start_ns long, end_ns long")
    got = {(r.t_ns, r.c) for r in rows.interval_join(s, iv, ["k"], size=8).collect()}
    assert got == {(t, c) for t in range(0, 100, 3) for c, a, b in ((0, 10, 40), (1, 35, 36)) if a <= t <= b}


def test_command_validation(spark):
    df = seq(spark, [([0.0] * 6, [0.0] * 6), ([float("nan")] + [0.0] * 5, [0.0] * 6), ([0.0] * 6, [1001.0] + [0.0] * 5), ([0.0] * 5, [0.0] * 6)],
             "arm array<double>, hand array<double>")
    assert [r[0] for r in df.select(rows.command_validate(F.col("arm"), F.col("hand"))).collect()] == [True, False, False, False]


def test_lookups_of_any_size_split_a_hot_key(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"))
    lookup = spark.createDataFrame([(0, "a"), (0, "b"), (5, "c")], "k long, v string")
    for how in ("inner", "left"):
        want = sorted((r.k, r.t, r.v or "") for r in rows.join(lookup, "k", how).collect())
        for most in (100, 0):  # broadcast, then dealt into parts
            got = lineage.lookup_join(rows, lookup, ["k"], how, by=F.col("t"), max_rows=most)
            assert got.columns == ["k", "t", "v"] and sorted((r.k, r.t, r.v or "") for r in got.collect()) == want
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lineage.lookup_join(rows, lookup, ["k"], by=F.col("t"), max_rows=0)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(k#\d+L, _part", plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
