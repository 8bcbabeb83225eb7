"""Writes that die half way: result store, dataset commit; statistics that merge."""

import random

import pytest
from pyspark.sql import functions as F

from trajq.operators import stats
from trajq.sources import canonical, storage
from trajq.sources.results import ResultStore

CALLS = "recording long, hand string, model string, rate double"


def work(rows):
    """Two rows for an odd recording, one for an even one, none for recording 9; recording 7 fails."""
    n = F.when(F.col("recording") == 9, 0).otherwise(1 + F.col("recording") % 2).cast("int")
    error = F.when(F.col("recording") == 7, "no answer")
    return rows.withColumn("k", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")))).withColumn("error", error)


@pytest.fixture
def inputs(spark):
    return spark.createDataFrame([(i, h, "m", 2.0) for i in range(10) for h in ("left", "right")] + [(None, "left", "m", 2.0)], CALLS)


def keys_of(df):
    return sorted((-1 if r.recording is None else r.recording, r.hand, getattr(r, "k", 0)) for r in df.collect())


def expected(inputs, failed=(7,)):
    out = []
    for r in inputs.collect():
        n = {None: 0, 9: 0}.get(r.recording, 1 + (r.recording or 0) % 2)
        out += [(-1 if r.recording is None else r.recording, r.hand, k) for k in range(1, n + 1) if r.recording not in failed]
    return sorted(out)


def test_finished_keys_are_not_asked_again(spark, inputs, tmp_path):
    store = ResultStore(spark, str(tmp_path / "s"), ["recording", "hand", "model", "rate"])
    with pytest.raises(FileNotFoundError):
        store.rows()
    assert keys_of(store.todo(inputs)) == keys_of(inputs)
    assert keys_of(store.run(inputs.where("recording < 5"), work)) == expected(inputs.where("recording < 5"))
    asked = []

    def counted(rows):
        asked.extend(r.recording for r in rows.collect())
        return work(rows)

    assert keys_of(store.run(inputs, counted, blocks=3)) == expected(inputs)
    assert sorted(asked, key=str) == sorted([None, *[i for i in range(5, 10) for _ in (0, 1)]], key=str)
    assert keys_of(store.todo(inputs)) == [(7, "left", 0), (7, "right", 0)]  # what failed is left, what gave no rows is not
    before = len(store._runs("rows"))
    assert store.todo(inputs, attempts=1).isEmpty()
    store.run(inputs, work, attempts=1)
    assert len(store._runs("rows")) == before  # repeated: nothing added
    assert keys_of(store.run(inputs, lambda rows: work(rows).withColumn("error", F.lit(None).cast("string")))) == expected(inputs, failed=())


def test_a_run_killed_between_rows_and_entries(spark, inputs, tmp_path, monkeypatch):
    store = ResultStore(spark, str(tmp_path / "s"), ["recording", "hand", "model", "rate"])
    some = inputs.where("recording in (1, 2)")
    store.run(some, work)

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "_enter", die)
        with pytest.raises(KeyboardInterrupt):
            store.record(inputs.where("recording = 3"), work(inputs.where("recording = 3")))
    assert keys_of(store.rows()) == expected(some)  # rows without entries are not seen
    torn = tmp_path / "s" / "rows" / "run=t0"  # a folder whose job did not end
    torn.mkdir()
    (torn / "part-0.parquet").write_bytes(b"PAR1")
    asked = []
    store.run(inputs.where("recording in (1, 2, 3, 4)"), lambda rows: asked.extend(r.recording for r in rows.collect()) or work(rows))
    assert sorted(asked) == [4, 4]  # recording 3 was adopted, not asked again
    assert keys_of(store.rows()) == expected(inputs.where("recording in (1, 2, 3, 4)"))
    assert store.recover() == []


def test_two_runs_that_answer_the_same_key(spark, inputs, tmp_path):
    store = ResultStore(spark, str(tmp_path / "s"), ["recording", "hand", "model", "rate"])
    part = inputs.where("recording = 1 or recording is null")
    first = store.record(part, part.withColumn("k", F.lit(1)))
    store.record(part, part.withColumn("k", F.lit(2)))
    assert {(r.run, r.k) for r in store.rows().collect()} == {(first, 1)} and store.rows().count() == 3


def dataset(spark, n=5, said=5):
    vec = [0.5] * 32
    f = spark.createDataFrame([(vec, vec, [True] * 32, i / 30, i, 0, i, 0) for i in range(n)],
                              "`observation.state` array<double>, action array<double>, action_mask array<boolean>, timestamp double, frame_index long, episode_index long, index long, task_index int")
    return f, spark.createDataFrame([(0, said)], "episode_index long, length long"), spark.createDataFrame([(0, "move")], "task_index int, task string")


def test_a_dataset_is_there_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "set")
    with monkeypatch.context() as m:
        m.setattr(canonical, "put_once", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            canonical.write_canonical(*dataset(spark), root)
    with pytest.raises(Exception):
        canonical.read_canonical(spark, root)
    with pytest.raises(ValueError, match=r"0 \(5 of 6\)"):
        canonical.write_canonical(*dataset(spark, 5, 6), root)
    dropped = spark.createDataFrame([("bad", ["missing_x"])], "source_episode string, reasons array<string>")
    canonical.write_canonical(*dataset(spark), root, dropped=dropped)  # the half datasets do not stand in the way
    back = canonical.read_canonical(spark, root)
    assert back["frames"].count() == 5 and back["info"].first().total_frames == 5
    assert {r.column for r in back["norm_stats"].collect()} == set(canonical.FRAME_TYPES)
    assert {(r.source_episode, r.kept, r.length) for r in back["conversion_report"].collect()} == {("0", True, 5), ("bad", False, None)}
    assert len(canonical.remove_abandoned(spark, root)) == 2 and canonical.read_canonical(spark, root)["frames"].count() == 5
    with pytest.raises(FileExistsError):
        canonical.write_canonical(*dataset(spark), root)
    f, e, t = dataset(spark)
    with pytest.raises(ValueError, match="no episodes"):
        canonical.write_canonical(f.limit(0), e.limit(0), t, str(tmp_path / "none"))


def test_put_once(spark, tmp_path):
    path = str(tmp_path / "a" / "m.json")
    assert storage.put_once(spark, path, "ä1") and storage.read_text(spark, path) == "ä1"
    assert not storage.put_once(spark, path, "2") and storage.read_text(spark, path) == "ä1"
    assert storage.children(spark, str(tmp_path / "none")) == []


def test_moments_merge_in_any_grouping(spark):
    rng = random.Random(4)
    rows = [(e, [1e9 + rng.gauss(0, 1), rng.gauss(0, e + 1)], rng.random() < 0.3, None if rng.random() < 0.1 else rng.random()) for e in range(12) for _ in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(rows, "episode_index long, v array<double>, flag boolean, x double")
    entries = lambda keys: stats.column_entries(df.withColumns({"half": F.col("episode_index") % 2, "bit": F.rand(1) > 0.5}), ["v", "flag", "x"], keys)
    direct = {(r.column, r.dim): r for r in stats.moment_stats(stats.moment_rows(entries([]))).collect()}
    fine = stats.moment_rows(entries(["half", "episode_index", "bit"]), ["half", "episode_index", "bit"])
    ways = [stats.merge_moments(fine), stats.merge_moments(stats.merge_moments(fine, ["half"])), stats.merge_moments(stats.merge_moments(stats.merge_moments(fine, ["half", "episode_index"]), ["half"]))]
    for way in ways:
        got = {(r.column, r.dim): r for r in stats.moment_stats(way).collect()}
        assert got.keys() == direct.keys()
        for k, r in got.items():
            assert (r["count"], r.min, r.max) == (direct[k]["count"], direct[k].min, direct[k].max)
            assert r.mean == pytest.approx(direct[k].mean, rel=1e-12) and r.std == pytest.approx(direct[k].std, rel=1e-6)
    assert stats.merge_moments(fine.limit(0)).count() == 0
