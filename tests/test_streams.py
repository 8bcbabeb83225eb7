"""Streams in several batches against the batch result."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajq.operators import histograms
from trajq.plans.lineage import scratch_dir
from trajq.streaming import histogram


def rows_of(rng, n):
    scale = rng.choice([1e-6, 1.0, 1e9])
    return [(k, [rng.gauss(0, 1) * scale, rng.choice([0.0, 5.0]), 7.25, rng.expovariate(1) if rng.random() < 0.9 else float("nan")]) for k in range(n)]


VECTORS = "i long, v array<double>"


def batch_result(spark, rows):
    flat = spark.createDataFrame(rows, VECTORS).select(F.posexplode("v").alias("dim", "x"))
    h = histograms.dyadic_histogram(flat)
    return h, {r.dim: (r.n, r.q01, r.q99) for r in histograms.dyadic_quantiles(h).collect()}


def run_stream(spark, folder, build, per_batch, schema, mode):
    """Rows of every micro-batch of a stream over the files of a folder."""
    got = []
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
    q = build(source).writeStream.outputMode(mode).option("checkpointLocation", scratch_dir(spark, "state")).trigger(availableNow=True).foreachBatch(lambda df, i: got.append(df.collect())).start()
    q.awaitTermination()
    return got, q


@pytest.mark.parametrize("per_batch", [1, 3, 100])
def test_streamed_quantiles_equal_the_batch_ones(spark, tmp_path, per_batch):
    rng = random.Random(7)
    rows = [r for n in (1, 40, 3, 200, 60) for r in rows_of(rng, n)]
    rng.shuffle(rows)
    for k in range(6):
        spark.createDataFrame(rows[k::6], VECTORS).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
    got, _ = run_stream(spark, str(tmp_path / "in"), lambda s: histogram.stream_histograms(s, "v"), per_batch, VECTORS, "update")
    last = {r.dim: r for batch in got for r in batch}
    h, want = batch_result(spark, rows)
    assert {d: (r.n, r.q01, r.q99) for d, r in last.items()} == want
    counts = {(r.dim, r.level, r.bin): r["count"] for r in h.collect()}
    assert counts == {(d, r.level, r.first + i): c for d, r in last.items() for i, c in enumerate(r.counts) if c}


def test_histograms_merge_in_any_grouping(spark):
    rng = random.Random(3)
    rows = [r for n in (1, 50, 300) for r in rows_of(rng, n)]
    flat = spark.createDataFrame(rows, VECTORS).select((F.col("i") % 5).alias("part"), F.posexplode("v").alias("dim", "x"))
    whole = sorted(map(tuple, histograms.dyadic_histogram(flat.drop("part")).collect()))
    parts = histograms.dyadic_histogram(flat, ["part"]).drop("part")
    half = [histograms.merge_histograms(histograms.dyadic_histogram(flat.where(w), ["part"]).drop("part")) for w in ("part < 2", "part >= 2")]
    for merged in (histograms.merge_histograms(parts), histograms.merge_histograms(half[0].unionByName(half[1]))):
        assert sorted(map(tuple, merged.select("dim", "level", "bin", "count", "min", "max").collect())) == whole
    assert histograms.merge_histograms(parts.limit(0)).count() == 0


def test_levels_agree_and_bound_the_bins(spark):
    rng = random.Random(5)
    pairs = [(0.0, 0.0), (1.0, 1.0), (0.0, 4096.0), (0.0, 4095.999), (-1e300, 1e300), (1e-290, 2e-290), (-3.0, -3.0), (2.0**52, 2.0**52 + 1), (0.1, 0.1 + 2**-40)]
    for _ in range(300):
        a, b = (rng.choice([-1, 1]) * math.ldexp(rng.random(), rng.randrange(-60, 60)) for _ in range(2))
        pairs.append((min(a, b), max(a, b)))
    df = spark.createDataFrame(pairs, "lo double, hi double").select("lo", "hi", histograms.level_of(F.col("lo"), F.col("hi")).alias("level"))
    for r in df.collect():
        assert r.level == histogram.level_of(r.lo, r.hi)
        bins = math.floor(r.hi / 2.0**r.level) - math.floor(r.lo / 2.0**r.level) + 1
        assert bins <= 4096 and (bins >= 2047 or r.level <= math.frexp(max(abs(r.lo), abs(r.hi)) or 1)[1] - 53 or r.lo == r.hi)
    x = np.array([3.0, -1.0, 2.5])
    one, two = histogram.Histogram(), histogram.Histogram()
    one.add(x)
    for v in x:
        two.add(np.array([v, math.inf]))
    assert one.row() == two.row()


MS = 1_000_000
FRAMES = "rollout string, t_ns long, value array<double>, reset boolean"


def run_batches(spark, tmp_path, batches, schema, build):
    """One file a batch; the rows of each micro-batch and the query's progress."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return run_stream(spark, str(tmp_path / "in"), build, 1, schema, "append")


def state_rows(query):
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_rollouts_end_on_event_time(spark, tmp_path):
    row = lambda r, ms, v, reset=False: (r, (10**6 + ms) * MS, [float(v)], reset)
    batches = [
        [row("a", 1_000, 1), row("a", 2_000, 4), row("b", 2_000, 7)],
        [row("a", 1_500, 2), row("a", 500, 9), row("c", 12_000, 1)],  # late rows of an open rollout; the stream goes on
        [row("b", 1_900, 8), row("b", 9_500, 5), row("c", 12_500, 3)],  # b has ended: late; then it starts anew
        [row("d", 100_000, 1)],
        [row("b", 100_100, 6), row("d", 200_000, 0, True)],
    ]
    got, q = run_batches(spark, tmp_path, batches, FRAMES, lambda s: stream_baseline(s, 3_000, 12_000))
    rows = sorted((r.rollout, r.t_ns // MS - 10**6, r.delta and r.delta[0], r.is_baseline, r.late) for b in got for r in b)
    assert rows == [
        ("a", 500, 8.0, False, True), ("a", 1_000, 0.0, True, False), ("a", 1_500, 1.0, False, False), ("a", 2_000, 3.0, False, False),
        ("b", 1_900, None, False, True), ("b", 2_000, 0.0, True, False), ("b", 9_500, 0.0, True, False), ("b", 100_100, 0.0, True, False),
        ("c", 12_000, 0.0, True, False), ("c", 12_500, 2.0, False, False), ("d", 100_000, 0.0, True, False)]
    assert state_rows(q) == 0  # the last row put the watermark past every rollout, and d was reset


def stream_baseline(frames, idle_ms, delay_ms):
    from trajq.streaming.baseline import stream_baseline_delta

    return stream_baseline_delta(frames, idle_ms=idle_ms, delay_ms=delay_ms)


SAMPLES = "recording_id long, stream string, sample_idx long, t_ns long, last boolean"


def test_recordings_in_pieces_are_judged_once(spark, tmp_path):
    from trajq.streaming.gate import assembled

    sec = 1_000 * MS
    one = [(r, s, i, (100 * r + i) * sec, i == 9) for r in (1, 2) for s in ("left", "rgb") for i in range(10)]
    one.sort(key=lambda r: r[2])  # pieces of all streams side by side
    rest = [(3, "rgb", i, (300 + i) * sec, False) for i in range(5)]  # its glove never comes
    none = [(4, "rgb", 0, 310 * sec, True), (4, None, None, 311 * sec, True)]  # marked as finished with one stream
    late = [(4, "left", 5, 312 * sec, True)]
    batches = [one[:10], one[10:25], one[25:] + rest, none, late + [(9, "rgb", 0, 4_000 * sec, False)], [(9, "rgb", 1, 90_000 * sec, False)]]
    got, q = run_batches(spark, tmp_path, batches, SAMPLES, lambda s: assembled(s, ("left", "rgb"), idle_ms=600_000, remember_ms=3_600_000, delay_ms=500_000))
    batches_of = {}
    for k, rows in enumerate(got):
        for r in rows:
            batches_of.setdefault((r.recording_id, r.complete), set()).add(k)
    samples = sorted((r.recording_id, r.stream, r.sample_idx, r.t_ns) for b in got for r in b)
    want = sorted(r[:4] for r in one + rest + none[:1])
    assert [r for r in samples if r[0] != 9] == want
    assert {k: len(v) for k, v in batches_of.items() if k[0] != 9} == {(1, True): 1, (2, True): 1, (3, False): 1, (4, True): 1}
    assert state_rows(q) <= 3  # recording 9 only: all others are forgotten
