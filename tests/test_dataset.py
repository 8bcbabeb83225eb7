"""Statistics, vectors, datasets, evaluation and resampling."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajq.functions import layout, rotations, vectors
from trajq.operators import dataset as ds
from trajq.operators import evaluate as ev
from trajq.operators import padfit, sampling, stats, windows
from trajq.operators import resample as rs
from trajq.plans.stages import Stages
from trajq.sources import canonical, files


def test_moments_do_not_depend_on_partitions(spark):
    x = np.random.default_rng(0).normal(size=(40, 3))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    for n in (1, 5):
        out = {r.dim: r for r in stats.vector_moments(stats.flat_dims(df.repartition(n), [], "v")).collect()}
        for d in range(3):
            assert out[d]["mean"] == pytest.approx(x[:, d].mean()) and out[d]["std"] == pytest.approx(x[:, d].std())
    one = stats.vector_moments(stats.flat_dims(df.limit(1), [], "v"))
    assert one.count() == 0


def test_histogram_quantile_is_the_left_edge(spark):
    df = spark.createDataFrame([(0, float(i)) for i in range(101)], "dim int, x double")
    r = stats.histogram_quantiles(df, quantiles={"q50": 0.5}, bins=10).first()
    counts, edges = np.histogram(np.arange(101.0), bins=10)
    assert r.q50 == pytest.approx(edges[np.searchsorted(np.cumsum(counts), 0.5 * 101)])


def test_norm_stats_multi_rotation_rule(spark):
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    frame = lambda i: [0.0] * 10 + [float(i), 2.0 * i, 0.0] + eye + [0.0] * 13
    df = spark.createDataFrame([(0, i, frame(i), frame(i + 1)) for i in range(6)], "episode_index long, frame_index long, state array<double>, action array<double>")
    out = {(r.key, r.dim): r for r in stats.norm_stats_multi([(df, ["right"])], horizon=3, size=4).collect()}
    want = [min(i + k + 1, 6) - i for i in range(6) for k in range(3)]
    assert out["actions", 10]["mean"] == pytest.approx(np.mean(want)) and out["actions", 10]["std"] == pytest.approx(np.std(want))
    assert out["actions", 13]["constant"] or out["actions", 13]["mean"] == pytest.approx(1.0)
    assert out["state", 0].constant and out["state", 0]["std"] == 1.0 and out["state", 0].q01 == -1.0


def test_pad_fit_floor_and_percentiles(spark):
    rows = []
    for hand in ("left", "right"):
        for p, pad in enumerate(layout.PADS):
            for i in range(4):
                scale = 0.0 if (hand, p) == ("left", 0) else 1.0 + p
                rows.append(("r", hand, pad, i, i, 2, 2, [scale * i] * 4))
    df = spark.createDataFrame(rows, "recording_id string, hand string, pad int, sample_idx long, t_ns long, h int, w int, force array<double>")
    out = {(r.hand, r.pad): r for r in padfit.pad_norm_fit(df).collect()}
    assert len(out) == 30
    pool = np.repeat(np.arange(4.0), 4)
    high = np.percentile(pool, 99.9) - np.percentile(pool, 5)
    assert out["right", 0].base == pytest.approx(np.percentile(pool, 5)) and out["right", 0].scale == pytest.approx(high)
    scales = [high * (1 + p) for p in range(15)] * 2
    assert out["left", 0].scale == pytest.approx(0.05 * np.median(scales[1:]))
    assert out["left", 0].threshold == pytest.approx(0.1)


def test_task_scale_follows_task(spark):
    rows, tasks = [], []
    for i in range(10):
        task = "light" if i < 4 else "hard" if i < 8 else "rare" if i == 8 else None
        tasks.append((f"r{i}", task))
        top = {"light": 0.2, "hard": 5.0}.get(task, 1.0)
        for hand in ("left", "right"):
            rows += [(f"r{i}", hand, pad, k, k, 4, 3, [top * (k % 5) / 4] * 12) for pad in (0, 1) for k in range(20)]
    df = spark.createDataFrame(rows, "recording_id string, hand string, pad int, sample_idx long, t_ns long, h int, w int, force array<double>")
    t = spark.createDataFrame(tasks, "recording_id string, task string")
    out = {r.task: r for r in padfit.task_scale_fit(df, t, frames=20).collect()}
    assert set(out) == {"light", "hard", None} and out["hard"].scale > 10 * out["light"].scale
    cov = padfit.task_scale_coverage(t, padfit.task_scale_fit(df, t, frames=20)).first()
    assert (cov.matched, cov.total) == (8, 10)


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [[3.0, 4.0, 5.0], [5.0, 6.0, 7.0]])], "s array<double>, a array<array<double>>")
    d = df.select(vectors.delta_mask(F.col("a"), F.col("s"), [False, True]).alias("d")).first().d
    assert d == [[3, 2, 5], [5, 4, 7]]
    assert df.select(vectors.absolute_mask(F.col("a"), F.col("s"), None)).first()[0] == df.first().a
    assert vectors.bool_mask(2, -2, 2) == [True, True, False, False, True, True] and vectors.bool_mask(2, 0, 2) == [True] * 4
    x = spark.createDataFrame([(v,) for v in (-9.0, -1.0, 0.0, 8.0, 99.0)], "x double")
    assert [r[0] for r in x.select(vectors.pressure_gray(F.col("x"))).collect()] == [0, 0, 28, 255, 255]
    n = x.select(vectors.normalize_pressure(F.col("x"), F.lit(0.0), F.lit(1.0))).collect()
    assert [r[0] for r in n] == [-1, -1, 0, 8, 8]
    with pytest.raises(Exception, match="wider"):
        df.select(vectors.pad_to_width(F.col("s"), 2)).collect()
    assert df.select(vectors.pad_to_width(F.col("s"), 2, strict=False)).first()[0] == [1, 2, 3]
    edges = np.linspace(-1, 1, 257)[:-1]
    vals = [-1.5, -1.0, -0.999, 0.0, 0.5, 0.9999, 1.0, 2.0]
    got = spark.createDataFrame([(vals,)], "v array<double>").select(vectors.discretize(F.col("v"))).first()[0]
    assert got == (np.digitize(vals, edges) - 1).tolist()
    g = np.arange(35.0).reshape(5, 7)
    pooled = spark.createDataFrame([(g.reshape(-1).tolist(),)], "v array<double>").select(vectors.grid_pool(F.col("v"), F.lit(5), F.lit(7), 3)).first()[0]
    cut = lambda n: [(i * n // 3, -(-(i + 1) * n // 3)) for i in range(3)]
    assert pooled == pytest.approx([g[a:b, c:d].mean() for a, b in cut(5) for c, d in cut(7)])


def matrix(r6):
    a, b = np.array(r6[:3]), np.array(r6[3:])
    b1 = a / np.linalg.norm(a)
    p = b - b1 @ b * b1
    b2 = p / np.linalg.norm(p)
    return np.stack([b1, b2, np.cross(b1, b2)], axis=1)


def test_rotations_against_matrices(spark):
    rng = np.random.default_rng(3)
    rows = [(rng.normal(size=32).tolist(), rng.normal(size=32).tolist(), [True] * 10 + [i != 1] * 22) for i in range(4)]
    df = spark.createDataFrame(rows, "a array<double>, s array<double>, m array<boolean>")
    d = rotations.rotation_delta(df.withColumn("d", F.col("a")), "d", "s", mask="m")
    d = rotations.rotation_absolute(d.withColumn("back", F.col("d")), "back", "s", mask="m").where(F.size("back") == 32).where(F.col("back")[0] < 99)
    for i, r in enumerate(d.collect()):
        rel = matrix(r.a[3:9]) @ matrix(r.s[3:9]).T
        assert r.d[3:9] == pytest.approx(np.concatenate([rel[:, 0], rel[:, 1]]).tolist())
        assert r.d[:3] == pytest.approx((np.array(r.a[:3]) - r.s[:3]).tolist())
        assert (r.d[10:20] == r.a[10:20]) == (i == 1)
        assert matrix(r.back[3:9]) == pytest.approx(matrix(r.a[3:9])) and r.back[20:] == r.a[20:]
    zero = rotations.matrix_from_rot6d(df.withColumn("z", F.array_repeat(F.lit(0.0), 6)), {"r": ("z", 0)}).first().r
    assert zero == np.eye(3).reshape(-1).tolist()


def test_pack_decode_round_trip(spark):
    arms = [[1.0, 2.0, 3.0, 10.0, -20.0, 30.0], [0.0] * 6, [5.0, 5.0, 5.0, 179.5, 0.0, 0.0], [5.0, 5.0, 5.0, 100.0, 100.0, 100.0]]
    df = spark.createDataFrame([(a, [float(i) for i in range(6)]) for a in arms], "arm array<double>, hand array<double>")
    p = df.withColumn("p", rotations.pack_canonical({"right": F.col("arm")}, {"right": F.col("hand")}))
    d = rotations.decode_canonical(p, "p", ["right"])
    for r in d.select("arm", "hand", F.col("right_arm").alias("a"), F.col("right_hand").alias("h"), "p").collect():
        assert r.a == pytest.approx(r.arm, abs=1e-6) and r.h == r.hand and r.p[:10] == [0] * 10 and len(r.p) == 32
    mask = spark.range(1).select(rotations.action_mask()).first()[0]
    assert [i for i, m in enumerate(mask) if not m] == [9, 19]


def test_repack_and_rename(spark):
    df = spark.sql("SELECT 1 AS a, struct(2 AS c, 3 AS d) AS b")
    r = ds.repack(df, {"x": {"y": "b/c", "z": "none"}, "k": "a"}, optional=["none"])
    assert r.first().asDict(recursive=True) == {"x": {"y": 2}, "k": 1}
    with pytest.raises(KeyError):
        ds.repack(df, {"x": "none"})
    out = ds.rename_by_regex(df, {"b/(.*)": r"q/\1", "a": None})
    assert out.first().asDict(recursive=True) == {"q": {"c": 2, "d": 3}}
    with pytest.raises(ValueError, match="already exists"):
        ds.rename_by_regex(df, {"b/.*": "same"})
    with pytest.raises(ValueError, match="aliases"):
        ds.rename_by_regex(df, {"a": "b"})


def test_stride_sample_fixture(spark):
    e = spark.createDataFrame([(0, 61), (1, 56)], "episode_index long, length long")
    out = sorted(tuple(r) for r in ds.stride_sample(e).collect())
    assert out == [(0, 0, 0), (0, 5, 5), (0, 10, 10), (1, 0, 61), (1, 5, 66)]


def test_splits_and_anomalies(spark):
    s = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train")], "uuid string, split string")
    assert [r.uuid for r in ds.split_disjoint(s).collect()] == ["a"]
    eps = spark.createDataFrame([("a",), ("b",)], "uuid string")
    with pytest.raises(Exception, match="more than once"):
        ds.split_select(eps, s, "train").collect()
    e = spark.createDataFrame([(d, i) for d in (0, 1) for i in range(3)], "dataset int, episode_index long")
    a = spark.createDataFrame([(0, 1), (0, 9), (1, 0)], "dataset int, episode_index long")
    assert sorted((r.dataset, r.episode_index) for r in ds.exclude_anomalous(e, a).collect()) == [(0, 1), (0, 2), (1, 1), (1, 2)]
    every = spark.createDataFrame([(d, i + 1) for d in (0, 1) for i in range(3)], "dataset int, episode_index long")
    assert ds.exclude_anomalous(e, every).count() == 6


def test_match_by_unique_length(spark):
    runs = spark.createDataFrame([("u", 0, 50), ("u", 60, 70), ("u", 200, 70)], "uuid string, run_start long, run_len long")
    eps = spark.createDataFrame([("u", 0, 50), ("u", 1, 70)], "uuid string, episode_index long, length long")
    good, bad = ds.match_by_unique_length(runs, eps)
    assert [(r.episode_index, r.run_start) for r in good.collect()] == [(0, 0)]
    assert [(r.length, r.n_runs, r.n_episodes) for r in bad.collect()] == [(70, 2, 1)]


def test_first_n_and_weights(spark):
    e = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "name string, ok boolean")
    assert [r.name for r in sampling.first_n_accepted(e, F.col("ok"), 2).where("chosen").orderBy("name").collect()] == ["a", "c"]
    with pytest.raises(Exception, match="fewer than 3"):
        sampling.first_n_accepted(e, F.col("ok"), 3).collect()
    with pytest.raises(ValueError, match="weights"):
        sampling.weighted_mix({"x": (e, 0.5)}, ["name"])


def test_exclude_list_shapes(spark):
    shapes = [json.dumps({"exclude_reasons": {"a": "blur", "b": "x"}}), json.dumps({"episodes": ["a", "b"]}), json.dumps(["a", "b"]), "# no\n a \n\nb\n",
              json.dumps({"excluded_episodes": {"a": 1, "b": 2}})]
    for s in shapes:
        df = spark.createDataFrame([(s,)], "value string")
        assert sorted(r.item for r in files.parse_exclude_list(df).collect()) == ["a", "b"]


def test_csv_header_and_bad_lines(spark, tmp_path):
    d = tmp_path / "day" / "rec1"
    d.mkdir(parents=True)
    (d / "rgb_head.csv").write_text("frame_index,timestamp_s\n0,1.5\nbad,line\n1,1.75\n2,\n")
    (d / "depth_head.csv").write_text("0,2.5\n1,3.5\n")
    out = files.read_ts_csv(spark, str(tmp_path)).orderBy("stream", "block", "line").collect()
    assert [(r.recording_id, r.stream, r.t_ns) for r in out] == [
        ("rec1", "depth_head", 2_500_000_000), ("rec1", "depth_head", 3_500_000_000), ("rec1", "rgb_head", 1_500_000_000), ("rec1", "rgb_head", 1_750_000_000)]
    assert [r.recording_id for r in files.scan_recordings(spark, str(tmp_path)).collect()] == ["rec1"]
    assert [r.episode for r in files.scan_by_date(spark, str(tmp_path), dates=["day"]).collect()] == ["rec1"]


def test_npz_reader(spark, tmp_path):
    d = tmp_path / "rec1"
    d.mkdir()
    np.savez(d / "left_hand_data.npz", timestamps=np.array([1.0, 1.5, 2.0]), tactile_0=np.arange(8.0).reshape(2, 2, 2),
             tf_tactile_x_0=np.ones((2, 2, 2)), tf_tactile_y_0=np.zeros((2, 2, 2)))
    (d / "right_hand_data.npz").write_bytes(b"PK broken")
    out = files.read_npz_tactile(spark, str(tmp_path)).orderBy("sample_idx").collect()
    assert [(r.recording_id, r.hand, r.pad, r.t_ns, r.force) for r in out] == [
        ("rec1", "left", 0, 10**9, [0, 1, 2, 3]), ("rec1", "left", 0, 15 * 10**8, [4, 5, 6, 7])]


def test_canonical_is_not_overwritten(spark, tmp_path):
    vec = [0.5] * 32
    f = spark.createDataFrame([(vec, vec, [True] * 32, i / 30, i, 0, i, 0) for i in range(5)],
                              "`observation.state` array<double>, action array<double>, action_mask array<boolean>, timestamp double, frame_index long, episode_index long, index long, task_index int")
    e = spark.createDataFrame([(0, 5)], "episode_index long, length long")
    t = spark.createDataFrame([(0, "move")], "task_index int, task string")
    root = str(tmp_path / "set")
    canonical.write_canonical(f, e, t, root)
    back = canonical.read_canonical(spark, root)
    assert back["frames"].count() == 5 and back["info"].first().total_frames == 5 and back["episodes"].first().to_index == 5
    with pytest.raises(Exception, match="(?i)already exists"):
        canonical.write_canonical(f, e, t, root)


def test_stats_validation(spark):
    good = spark.createDataFrame([(h, p, 0.0, 1.0, 0.1, "pad30", "train") for h in ("left", "right") for p in layout.PADS],
                                 "hand string, pad int, base double, scale double, threshold double, tag string, fit_split string")
    canonical.validate_stats(good, tag="pad30")
    for column, value, message in (("tag", "other", "tagged"), ("fit_split", "val", "train-only"), ("base", float("nan"), "finite"), ("scale", 0.0, "positive")):
        with pytest.raises(ValueError, match=message):
            canonical.validate_stats(good.withColumn(column, F.lit(value)), tag="pad30")


def latents(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist(), rng.normal(size=4).tolist(), i != 2) for i in range(4)]
    return rows, spark.createDataFrame(rows, "id long, z array<double>, z_star array<double>, valid boolean")


def test_contrastive_error_sends_in_proportion(spark):
    """Parts of a pool's matrix: a fixed number a side until one would hold too many bytes."""
    sizes = spark.createDataFrame([(10, 32), (5_000, 32), (400_000, 32), (2_000_000, 32), (8_000_000, 32), (400_000, 4096)], "n long, d int")
    assert [r.t for r in sizes.select(ev._sides(F.col("n"), F.col("d"), 1024).alias("t")).collect()] == [1, 5, 16, 16, 62, 391]


def test_contrastive_error(spark):
    rows, df = latents(spark)
    got = {r.id: r.error for r in ev.contrastive_error(df.withColumn("pool", F.floor(F.col("id") / 8)), pool=["pool"], valid=F.col("valid"), temperature=0.5, tile=3).collect()}
    keep = [r for r in rows if r[3]]
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    logits = unit(np.array([r[1] for r in keep])) @ unit(np.array([r[2] for r in keep])).T / 0.5
    ce = lambda m: np.log(np.exp(m).sum(1)) - np.diag(m)
    want = 0.5 * (ce(logits) + ce(logits.T))
    assert [got[r[0]] for r in keep] == pytest.approx(want.tolist()) and set(got) == {0, 1, 3}
    assert [r.error for r in ev.contrastive_error(df.where("id = 0")).collect()] == [0.0]


def corr(x, y):
    return 0.0 if np.std(x) < 1e-12 or np.std(y) < 1e-12 else float(np.corrcoef(x, y)[0, 1])


def test_permutation_tests(spark):
    x, y = [1.0, 2.0, 4.0, 3.0, 6.0, 5.0], [2.0, 1.0, 5.0, 3.0, 4.0, 6.0]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    obs = abs(corr(x, y))
    want = np.mean([abs(corr(x, p)) >= obs - 1e-12 for p in itertools.permutations(y)])
    exact = rs.exact_permutation_test(df, "id", "x", "y").first()
    assert exact.total == 720 and exact.p == pytest.approx(want)
    mc = rs.permutation_test(df, "id", "x", "y", resamples=3000).first()
    assert mc.observed == pytest.approx(corr(x, y)) and abs(mc.p - want) < 0.03
    diffs = [a - b + 0.8 for a, b in zip(x, y)]
    dd = spark.createDataFrame(list(enumerate(diffs)), "id long, d double")
    flips = np.mean([abs(np.mean(np.array(s) * diffs)) >= abs(np.mean(diffs)) - 1e-12 for s in itertools.product([-1, 1], repeat=6)])
    assert abs(rs.sign_flip_test(dd, "id", "d", resamples=3000).first().p - flips) < 0.03
    ci = rs.bootstrap_ci(df, "id", "x", "y", resamples=500).first()
    assert ci.lo < corr(x, y) < ci.hi <= 1.0000001
    d = rs.derangement_pair(df.select("id"), ["id"]).collect()
    assert sorted(r.partner_i for r in d) == list(range(6)) and all(r.partner_i != r._i for r in d)


def test_resampling_of_nine_units_against_every_pairing(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=9)
    y = x * 0.6 + rng.normal(size=9)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double").repartition(4)
    perms = np.array(list(itertools.permutations(range(9))))
    r = (x - x.mean()) / x.std() @ ((y - y.mean()) / y.std())[perms].T / 9
    want = np.mean(np.abs(r) >= abs(corr(x, y)) - 1e-12)
    exact = rs.exact_permutation_test(df, "id", "x", "y").first()
    assert (exact.total, exact.p) == (len(perms), pytest.approx(want)) and exact.observed == pytest.approx(corr(x, y))
    mc = rs.permutation_test(df, "id", "x", "y").first()
    assert mc.resamples == 200_000 and mc.n == 9 and abs(mc.p - want) < 4 * np.sqrt(want * (1 - want) / 200_000) + 1e-5
    signs = np.array(list(itertools.product([-1, 1], repeat=9))) @ x / 9
    want = np.mean(np.abs(signs) >= abs(x.mean()) - 1e-12)
    assert abs(rs.sign_flip_test(df, "id", "x").first().p - want) < 0.02
    ci = rs.bootstrap_ci(df, "id", "x", "y").first()
    at = np.random.default_rng(1).integers(0, 9, (10_000, 9))
    lo, hi = np.percentile([corr(x[i], y[i]) for i in at], [2.5, 97.5])
    assert ci.resamples == 10_000 and abs(ci.lo - lo) < 0.06 and abs(ci.hi - hi) < 0.02
    assert rs.permutation_test(df, "id", "x", "y", resamples=2500).first() == rs.permutation_test(df.repartition(7), "id", "x", "y", resamples=2500).first()
    ten = df.unionByName(df.limit(1).withColumn("id", F.lit(99).cast("long")))
    assert rs.exact_permutation_test(ten, "id", "x", "y", resamples=1500).first().total == 1500
    flat = df.withColumn("x", F.lit(2.0))
    assert rs.permutation_test(flat, "id", "x", "y", resamples=100).first().p == 1.0


def test_draws_are_the_same_in_tasks_and_in_text(spark):
    rows = spark.range(3).withColumnRenamed("id", "r").crossJoin(spark.range(4).withColumnRenamed("id", "i"))
    got = {(r.r, r.i): r.h for r in rows.withColumn("h", rs.draw(5, F.col("r"), F.col("i"), portable=True)).collect()}
    table = rs.draws(5, np.arange(3), 4, portable=True)
    assert all(table[r, i] == h for (r, i), h in got.items())
    plain = rs.draws(5, np.arange(4000), 8)
    assert len(np.unique(plain)) == plain.size and plain.min() >= 0 and np.abs((plain & 1).mean(axis=0) - 0.5).max() < 0.05


def test_holm(spark):
    df = spark.createDataFrame([(0, 0.04), (1, 0.01), (2, 0.03)], "i int, p double")
    assert [r.p_holm for r in ev.holm_adjust(df, order=["i"]).orderBy("i").collect()] == pytest.approx([0.06, 0.03, 0.06])


def test_prediction_summary_active_subset(spark):
    rows = [(0, 0, [0.0] * 4, [0.0] * 4), (0, 1, [0.0] * 4, [0.1] * 4)]
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, pred array<double>, target array<double>")
    r = ev.prediction_summary(ev.row_errors(df)).first()
    assert (r.samples, r.active_samples) == (2, 1) and r.mae == pytest.approx(0.05) and r.active_mae == pytest.approx(0.1)
    none = ev.prediction_summary(ev.row_errors(df.where("frame_index = 0"))).first()
    assert none.active_mae is None


def test_stages_undo_from_the_inside_out(spark):
    add, sub = (lambda d: d.withColumn("x", F.col("x") + 1)), (lambda d: d.withColumn("x", F.col("x") - 1))
    mul, div = (lambda d: d.withColumn("x", F.col("x") * 2)), (lambda d: d.withColumn("x", F.col("x") / 2))
    s = Stages().push((add,), (sub,)).push((mul,), (div,))
    df = spark.createDataFrame([(3.0,)], "x double")
    assert s.apply(df).first().x == 8.0 and s.undo(s.apply(df)).first().x == 3.0


def test_numbering(spark):
    e = spark.createDataFrame([("b", 2), ("a", 3)], "name string, length long")
    eps = windows.renumber(e, ["name"])
    assert [(r.name, r.episode_index, r.from_index) for r in eps.orderBy("episode_index").collect()] == [("a", 0, 0), ("b", 1, 3)]
    f = spark.createDataFrame([("b", 0), ("b", 1), ("a", 0), ("a", 1), ("a", 2)], "name string, frame_index long")
    assert sorted(r["index"] for r in windows.renumber_frames(f, eps, ["name"]).collect()) == [0, 1, 2, 3, 4]
