"""Gate, integrity, loss, noise and verdict cases."""

from pyspark.sql import functions as F

from trajq.functions import responses
from trajq.operators import gate, quality, sampling
from trajq.operators import tactile as tac

CAMS = ("rgb", "depth", "wristL", "wristR")
GLOVES = ("tacL", "tacR")
T0 = 1_700_000_000_000_000_000


def recording(name, drop=(), gone=None):
    out = []
    for s in CAMS:
        out += [(name, s, i, T0 + round(i * 1e9 / 30)) for i in range(300)]
    for s in GLOVES:
        out += [(name, s, i, T0 - 20_000_000 + i * 20_000_000) for i in range(520) if not (s == "tacL" and i in drop)]
    return [r for r in out if r[1] != gone]


def test_sync_gate(spark):
    data = recording("clean") + recording("hole", drop=range(200, 230)) + recording("gone", gone="depth")
    data += [(r[0].replace("clean", "short"), *r[1:]) for r in recording("clean") if r[3] < T0 + 500_000_000]
    df = spark.createDataFrame(data, "recording_id string, stream string, sample_idx long, t_ns long")
    missing = spark.createDataFrame([("clean", []), ("hole", ["wrist_left.mp4"])], "recording_id string, missing array<string>")
    labels = {"rgb": "head RGB", "depth": "head depth", "wristL": "left wrist", "wristR": "right wrist", "tacL": "left glove", "tacR": "right glove"}
    for size in (gate.HOUR_NS, 700_000_000):
        out = {r.recording_id: r for r in gate.sync_gate(
            df, CAMS + GLOVES, cover_by=GLOVES, cover_of="rgb", missing_files=missing, labels=labels, size=size).collect()}
        assert out["clean"].passed and out["clean"].reason == "ok" and out["clean"].n_holes == 0
        hole = out["hole"]
        assert not hole.passed and hole.worst_stream == "tacL" and hole.maxgap_ms > 250
        assert hole.reason.startswith("missing video files: ['wrist_left.mp4']; ") and "blackout: worst gap" in hole.reason and "left glove" in hole.reason
        assert out["gone"].reason == "missing timestamp streams: ['head depth']" and out["gone"].n_holes == -1
        assert out["short"].reason == "common time window shorter than 1 s"


def test_pass_rate_keeps_jitter_and_rejects_loss(spark):
    def cam(lost=(), late=()):
        return [("r", "cam", i, T0 + round(i * 1e9 / 30) + (25_000_000 if i in late else 0)) for i in range(90) if i not in lost]

    glove = [("r", "glove", i, T0 - 10_000_000 + i * 25_000_000) for i in range(122)]
    for camera, accepted, invalid in ((cam(late={40}), True, 1), (cam(lost=range(35, 45)), False, 10)):
        df = spark.createDataFrame(camera + glove, "recording_id string, stream string, sample_idx long, t_ns long")
        out = gate.stream_passrate(gate.aligned_ticks(df, ["cam", "glove"]), ["cam", "glove"])
        row = {r.stream: r for r in out.collect()}["cam"]
        assert row.accepted is accepted and abs(row.invalid_frames - invalid) <= 1


def frames_of(spark, alive):
    """100 frames at 10 Hz, force 1 in the listed windows of each part."""
    rows = []
    for i in range(100):
        t = i / 10
        f = {p: float(any(a <= t <= b for a, b in alive.get(p, []))) for p in ("thumb", "index", "middle", "ring", "pinky", "palm")}
        rows.append(("r", "left", i, round(t * 1e9), *f.values(), sum(f.values()), any(f.values())))
    return spark.createDataFrame(rows, "recording_id string, hand string, sample_idx long, t_ns long, thumb double, index double, middle double, ring double, "
                                 "pinky double, palm double, total double, visible boolean")


def grasp(spark, confirmed, skip=False):
    return spark.createDataFrame([("r", "left", 0, 2 * 10**9, 5 * 10**9, confirmed, skip, "cup")],
                                 "recording_id string, hand string, contact_id int, start_ns long, end_ns long, confirmed array<string>, skip boolean, object string")


def kinds(spark, alive, confirmed, skip=False):
    out = quality.loss_check(frames_of(spark, alive), grasp(spark, confirmed, skip)).collect()
    return sorted((r.finger, r.kind) for r in out)


def test_loss_classes(spark):
    assert kinds(spark, {}, ["thumb", "index"]) == [("index", "hard"), ("thumb", "hard")]
    assert kinds(spark, {"thumb": [(2, 5)]}, ["thumb", "index"]) == [("index", "weak")]
    assert kinds(spark, {"thumb": [(2, 5)], "index": [(7, 8)]}, ["thumb", "index"]) == [("index", "suspect")]
    assert kinds(spark, {}, ["index"]) == [("index", "weak")]
    assert kinds(spark, {}, ["pinky", "palm"]) == []
    assert kinds(spark, {}, ["thumb", "index"], skip=True) == []


def test_noise_only_in_free_time(spark):
    free = spark.createDataFrame([("r", "left", 0, 0, 4 * 10**9)], "recording_id string, hand string, free_id int, start_ns long, end_ns long")
    out = quality.noise_candidates(frames_of(spark, {"index": [(1, 2), (6, 7)], "palm": [(1, 2)]}), free, rows_per_bucket=8).collect()
    assert [(r.start, r.end, r.fingers, r.peak) for r in out] == [(1.0, 2.0, ["index"], 2.0)]
    assert [r["rank"] for r in sampling.top_noise(quality.noise_candidates(frames_of(spark, {"index": [(1, 2)]}), free)).collect()] == [1]


def test_verdicts(spark):
    hands = spark.createDataFrame([("a", "left"), ("a", "right"), ("b", "left"), ("b", "right")], "recording_id string, hand string")
    faults = hands.withColumn("hard_fault", (F.col("recording_id") == "b") & (F.col("hand") == "left"))
    contact = "recording_id string, hand string, contact_id int, start_ns long, end_ns long, confirmed array<string>, skip boolean, object string"
    contacts = spark.createDataFrame([("a", "left", 0, 2 * 10**9, 5 * 10**9, ["thumb", "index"], False, ""), ("b", "left", 0, 0, 1, ["thumb"], False, "cup")], contact)
    losses = spark.createDataFrame([("a", "left", 0, 2 * 10**9, 5 * 10**9, "", ["thumb", "index"], False, 1, "index", "weak")],
                                   "recording_id string, hand string, contact_id int, start_ns long, end_ns long, object string, confirmed array<string>, whole_hand boolean, pos int, finger string, kind string")
    free = spark.createDataFrame([("a", "left", 0, 0, 4 * 10**9)], "recording_id string, hand string, free_id int, start_ns long, end_ns long")
    noise = spark.createDataFrame([("a", "left", 1.0, True), ("a", "left", 9.0, None)], "recording_id string, hand string, dur double, confirmed boolean")
    hv = quality.hand_verdict(hands, faults, contacts, losses, free, noise)
    got = {(r.recording_id, r.hand): r for r in hv.collect()}
    assert got["a", "left"].reason == ("possible tactile loss (needs human check): index reported touching object at 2.0-5.0s but is silent, "
                                       "while thumb in the same grasp respond")
    assert got["a", "left"].noise_pct == 0.25 and got["a", "right"].verdict == "PASS"
    assert got["b", "left"].verdict == "REJECT" and got["b", "left"].reason.startswith("[tier0]")
    errors = spark.createDataFrame([("c", "broken")], "recording_id string, error string")
    ev = quality.episode_verdict(hv, errors)
    assert {r.recording_id: r.verdict for r in ev.collect()} == {"a": "REVIEW", "b": "REJECT", "c": "ERROR"}
    s = quality.verdict_summary(ev).first()
    assert (s.n, s.reject, s.review, s.error) == (3, 1, 1, 1)
    assert [r.recording_id for r in quality.noise_report(ev).collect()] == ["a"]


def test_force_rules_differ(spark):
    t = spark.createDataFrame([("r", "left", 3, 0, 0, 2, 2, [0.5, -0.5, 0.02, 0.03])],
                              "recording_id string, hand string, pad int, sample_idx long, t_ns long, h int, w int, force array<double>")
    assert abs(tac.pad_series(t).first().value - 0.03) < 1e-9
    assert abs(tac.finger_force(t).first().force - 0.53) < 1e-9
    assert abs(tac.total_force(t).first().total - 0.05) < 1e-9


def test_responses(spark):
    raws = ['```json\n{"free": [[1, 2]], "contacts": []}\n```', 'Sure! {"free": [{"start": "3", "end": 4}]} bye', "nothing", "{broken}",
            '{"free": [["x", 1], 5, [1]], "contacts": [{"start": 1, "end": "2", "fingers": ["thumb"], "uncertain": true}, {"end": 2}]}']
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    out = {r.i: r for r in responses.normalize_responses(df).collect()}
    assert [(x.a, x.b) for x in out[0].free] == [(1.0, 2.0)] and [(x.a, x.b) for x in out[1].free] == [(3.0, 4.0)]
    assert out[2].json == "{}" and out[2].error is None and out[3].error == "malformed response"
    assert out[4].free == [] and [(c.start, c.end, c.confirmed, c.skip) for c in out[4].contacts] == [(1.0, 2.0, ["thumb"], True)]


def test_integrity(spark):
    cam = [("r", s, T0 + round(i * 1e9 / 30) + (200_000_000 if i > 50 else 0)) for s in ("a", "b") for i in range(100)]
    cam += [("r", "b", T0 + 9 * 10**9)]
    c = spark.createDataFrame(cam, "recording_id string, stream string, t_ns long")
    counts = spark.createDataFrame([("r", "a", 97), ("r", "b", 101)], "recording_id string, stream string, n_frames long")
    gloves = spark.createDataFrame([("r", "left", T0 + i * 20_000_000) for i in range(50)], "recording_id string, hand string, t_ns long")
    rec = spark.createDataFrame([("r",)], "recording_id string")
    issues = quality.integrity_check(c, counts, gloves, rec, ["a", "b", "d"]).first().issues
    assert issues[0] == "a: video has 97 frames vs 100 timestamp rows (diff -3)"
    assert issues[1] == "a: 1 abnormal frame interval(s), max 233ms (median 33ms), first at t=1.7s"
    assert issues[2].startswith("b: 2 abnormal") and issues[3] == "d: missing file"
    assert issues[4] == "stream durations differ: a=3.5s, b=9.0s" and issues[5] == "right_hand: missing file"
