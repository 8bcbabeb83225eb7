"""Keyed permutations, endless mixes and draws with replacement."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trajq.operators import endless


def test_permutations_of_any_size_and_back(spark):
    sizes = [1, 2, 3, 7, 64, 101]
    df = spark.createDataFrame([(n, i, e) for n in sizes for i in range(n) for e in (0, 1)], "n long, i long, epoch long")
    to = endless.permuted(F.col("i"), F.col("n"), F.lit("d"), F.col("epoch"), seed=3)
    back = endless.permuted(F.col("to"), F.col("n"), F.lit("d"), F.col("epoch"), seed=3, inverse=True)
    rows = df.withColumn("to", to).withColumn("back", back).collect()
    order = {}
    for r in rows:
        assert r.back == r.i
        order.setdefault((r.n, r.epoch), []).append((r.i, r.to))
    for (n, _), pairs in order.items():
        assert sorted(t for _, t in pairs) == list(range(n))
    assert sorted(order[101, 0]) != sorted(order[101, 1]) and sum(i == t for i, t in order[101, 0]) < 15


def test_permutations_are_even(spark):
    """Each of the six orders of three rows comes up about as often (chi-square, 5 degrees, 0.1 %)."""
    df = spark.range(3000).select(F.col("id").alias("e"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("i"))
    to = endless.permuted(F.col("i"), F.lit(3).cast("bigint"), F.col("e"))
    got = Counter(tuple(r.o) for r in df.withColumn("to", to).groupBy("e").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "to"))), lambda s: s["to"]).alias("o")).collect())
    assert len(got) == 6 and sum((c - 500) ** 2 / 500 for c in got.values()) < 20.5


def test_shares_hold_at_any_length(spark):
    weights = {"a": 0.5, "b": 0.3, "c": 1 / 7, "d": 1 - 0.8 - 1 / 7}
    rows = spark.range(4000).select("id", endless.slots(F.col("id"), weights).alias("s")).select("id", "s.*").orderBy("id").collect()
    seen = Counter()
    for r in rows:
        assert r.nth == seen[r.dataset]
        seen[r.dataset] += 1
        assert all(abs(seen[k] - w * (r.id + 1)) < 4 for k, w in weights.items())
    far = spark.range(10**12, 10**12 + 1000).select(endless.slots(F.col("id"), weights).alias("s")).groupBy("s.dataset").count().collect()
    assert all(abs(r["count"] - weights[r.dataset] * 1000) < 4 for r in far)
    with pytest.raises(ValueError):
        endless.shares({"a": 0.5, "b": 0.4})


def test_scarce_sets_repeat_and_a_restart_goes_on(spark):
    small, large = spark.range(7).withColumn("x", F.lit(1)), spark.range(500)
    sets = {"small": (small, 0.4), "large": (large, 0.6)}
    whole = {r.position: r for r in endless.endless_mix(sets, ["id"], 0, 1000).collect()}
    assert sorted(whole) == list(range(1000))
    assert Counter(r.dataset for r in whole.values()) == {"small": 400, "large": 600}
    per = Counter((r.epoch, r.id) for r in whole.values() if r.dataset == "small")
    assert all(c == 1 for c in per.values()) and {e for e, _ in per} == set(range(58))  # every row once an epoch
    assert len({r.id for r in whole.values() if r.dataset == "large" and r.epoch == 0}) == 500
    again = endless.endless_mix(sets, ["id"], 640, 700).collect()
    assert len(again) == 60 and all(whole[r.position] == r for r in again)
    numbered = {k: (df.withColumn("n", F.col("id")), w) for k, (df, w) in sets.items()}
    assert {r.position: r.id for r in endless.endless_mix(numbered, [], 0, 50, number="n").collect()} == {k: whole[k].id for k in range(50)}
    with pytest.raises(Exception, match="empty data set"):
        endless.endless_mix({"small": (small.limit(0), 0.5), "large": (large, 0.5)}, ["id"], 0, 3).collect()


def test_draws_with_replacement(spark):
    rng = random.Random(2)
    rows = [(g, i, t) for g, n in (("a", 5), ("b", 1), (None, 3)) for i in range(n) for t in range(rng.randrange(1, 4))]
    df = spark.createDataFrame(rows, "g string, i long, t long")
    got = endless.sample_with_replacement(df, ["g"], ["i"], 2500).collect()
    for g, n in (("a", 5), ("b", 1), (None, 3)):
        drawn = {r.draw: r.i for r in got if r.g == g}
        assert sorted(drawn) == list(range(2500))  # k draws, duplicates kept
        counts = Counter(drawn.values())
        assert len(counts) == n and sum((c - 2500 / n) ** 2 / (2500 / n) for c in counts.values()) < {5: 18.5, 1: 0.1, 3: 13.9}[n]
        for t in range(20):
            assert sorted(r.t for r in got if r.g == g and r.draw == t) == sorted(x[2] for x in rows if x[0] == g and x[1] == drawn[t])
    few = endless.sample_with_replacement(df, ["g"], ["i"], 4, at_most_all=True).select("g", "draw").distinct().groupBy("g").count().collect()
    assert {r.g: r["count"] for r in few} == {"a": 4, "b": 1, None: 3}
    assert endless.sample_with_replacement(df.limit(0), ["g"], ["i"], 3).count() == 0
