"""Foreign dataset layouts, headers per file, real glove archives, bucket plans."""

import io
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trajq.operators import quality, tactile
from trajq.plans import ordered
from trajq.sources import canonical, files


def dataset(root, nested_meta, index_tasks):
    (root / "data/chunk-000").mkdir(parents=True)
    (root / "meta").mkdir()
    lengths = [3, 2]
    for e, n in enumerate(lengths):
        pq.write_table(pa.table({"episode_index": [e] * n, "frame_index": list(range(n))}), root / f"data/chunk-000/episode_{e:06d}.parquet")
    rows = [{"episode_index": e, "length": n} for e, n in enumerate(lengths)]
    if nested_meta:
        (root / "meta/episodes/chunk-000").mkdir(parents=True)
        pq.write_table(pa.Table.from_pylist(rows), root / "meta/episodes/chunk-000/file-000.parquet")
    else:
        (root / "meta/episodes.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    if index_tasks:
        pq.write_table(pa.table({"task_index": [0], "__index_level_0__": ["move"]}), root / "meta/tasks.parquet")
    else:
        (root / "meta/tasks.jsonl").write_text(json.dumps({"task_index": 0, "task": "move"}))
    (root / "meta/info.json").write_text(json.dumps({"total_frames": 5, "fps": 30, "features": {"a": {"dtype": "int64"}}}, indent=2))


@pytest.mark.parametrize("nested_meta, index_tasks", [(False, False), (True, True), (True, False)])
def test_dataset_layouts(spark, tmp_path, nested_meta, index_tasks):
    dataset(tmp_path, nested_meta, index_tasks)
    d = canonical.read_canonical(spark, str(tmp_path))
    assert d["frames"].count() == 5 and d["info"].first()["total_frames"] == 5 and d["tasks"].first()["task"] == "move"
    assert [(r.from_index, r.to_index) for r in d["episodes"].orderBy("episode_index").collect()] == [(0, 3), (3, 5)]


def test_each_file_has_its_own_header(spark, tmp_path):
    for name, text in {
        "a": "frame_index,epoch,exposure\n0,100.5,7\n1,101.5,8\n", "b": "frame_index,exposure,timestamp_s\n0,7,200.25\n1,oops\n2,9,x\n3,9,203\n",
        "c": "frame_index,exposure\n0,1\n6,1\n", "d": "exposure, time\n5, 300\n", "e": "1,2,3\n4,5,6\n", "f": "",
    }.items():
        (tmp_path / "rec").mkdir(exist_ok=True)
        (tmp_path / f"rec/{name}.csv").write_text(text)
    got = sorted((r.stream, r.frame_index, r.t_ns / 1e9) for r in files.read_frame_table(spark, str(tmp_path)).collect())
    assert got == [("a", 0, 100.5), ("a", 1, 101.5), ("b", 0, 200.25), ("b", 3, 203.0), ("c", 0, 0.0), ("c", 6, 0.2), ("d", 0, 300.0)]


def test_epoch_time_gloves_of_unequal_pads_to_a_verdict(spark):
    t0, arrays = 1.7e9, {"timestamps": 1.7e9 + np.arange(60) / 10}
    for pad in files.PAD_IDS:
        n = 50 if pad == 18 else 60
        arrays[f"tactile_{pad}"] = np.zeros((n, 2, 2)) if pad < 6 else np.ones((n, 2, 2))
    out = io.BytesIO()
    np.savez(out, **arrays)
    broken = io.BytesIO()
    np.savez(broken, **(arrays | {"tactile_0": np.zeros((60, 4))}))
    raw = spark.createDataFrame([("r", bytearray(out.getvalue())), ("s", bytearray(broken.getvalue()))], "path string, content binary")
    t = files.decode_npz(raw).select(F.col("path").alias("recording_id"), F.lit("left").alias("hand"), "pad", "sample_idx", "t_ns", "h", "w", F.col("force").cast("array<double>"))
    frames = quality.hand_frames(t)
    times = [r.t_ns for r in frames.orderBy("sample_idx").collect()]
    assert len(times) == 50 and times[0] == 0 and abs(times[-1] - 4.9e9) < 1e3 and t0
    assert tactile.finger_force(t).groupBy("part").count().select("count").distinct().collect()[0][0] == 50
    contact = "recording_id string, hand string, contact_id int, start_ns long, end_ns long, confirmed array<string>, skip boolean, object string"
    contacts = spark.createDataFrame([("r", "left", 0, 10**9, 3 * 10**9, ["thumb", "index"], False, "cup")], contact)
    losses = quality.loss_check(frames, contacts)
    assert sorted((r.finger, r.kind) for r in losses.collect()) == [("index", "hard"), ("thumb", "hard")]
    free = spark.createDataFrame([], "recording_id string, hand string, free_id int, start_ns long, end_ns long")
    noise = spark.createDataFrame([], "recording_id string, hand string, dur double, confirmed boolean")
    v = quality.hand_verdict(t.select("recording_id", "hand").distinct(), tactile.hard_fault(t), contacts, losses, free, noise)
    assert v.first()["verdict"] == "REJECT"


def test_windows_keep_their_bucket_after_a_join_on_the_key(spark, capsys):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(200).selectExpr("id % 2 AS k", "id AS i", "cast(id AS double) AS v").join(spark.range(2).withColumnRenamed("id", "k"), "k")
        summed = ordered.running_sum(rows, ["k"], "i", {"s": F.col("v")}, size=16)
        summed.explain("simple")
        plan = capsys.readouterr().out
        window = plan[plan.index("Window") :]
        assert re.search(r"Exchange hashpartitioning\(k#\d+L, _bucket#\d+L", window[: window.index("Join", 6) if "Join" in window[6:] else None])
        assert summed.agg(F.max("s")).first()[0] == sum(range(1, 200, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_hand_commands_without_time_or_target_are_left_out(spark, tmp_path):
    lines = ['{"recording_id": "r", "side": "left", "host_timestamp_ns": 9, "t_cmd_ns": 5, "target": [1, 2.5]}', '{"recording_id": "r", "t_cmd_ns": 6}', '{"recording_id": "r", "target": [1]}', '{"t_cmd_ns": 7, "tar', ""]
    (tmp_path / "rec").mkdir()
    (tmp_path / "rec" / "hand.jsonl").write_text("\n".join(lines))
    assert [(r.recording_id, r.t_cmd_ns, r.target) for r in files.read_hand_cmd(spark, str(tmp_path)).collect()] == [("r", 5, [1.0, 2.5])]
