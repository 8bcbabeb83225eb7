"""Archives by member against whole archives."""

import io
import random

import numpy as np
import pytest

from trajq.sources import archives, files


class Counting(io.BytesIO):
    """A file that counts what is read of it."""

    def __init__(self, data):
        super().__init__(data)
        self.read_bytes = 0

    def read(self, n=-1):
        out = super().read(n)
        self.read_bytes += len(out)
        return out


def glove(n, seed, shear=True, h=6, w=7):
    rng = np.random.default_rng(seed)
    out = {"timestamps": np.arange(n) / 30 + seed}
    for pad in files.PAD_IDS:
        out[f"tactile_{pad}"] = rng.normal(size=(n, h, w)).astype(np.float32)
        if shear:
            out |= {f"tf_tactile_{k}_{pad}": rng.normal(size=(n, h, w)) for k in "xy"}
    return out


def test_two_pads_read_only_their_bytes():
    arrays = glove(20_000, 1)
    data = archives.saved(arrays)
    file = Counting(data)
    ranges = archives.ranges_of(file, (3, 18), 8_192)
    assert file.read_bytes < 100_000 and ranges == [(p, a, min(20_000, a + 8_192)) for p in (3, 18) for a in range(0, 20_000, 8_192)]
    file.read_bytes = 0
    parts = list(archives.series_of(file, 18, 8_192, 16_384))
    assert sum(len(p["t_ns"]) for p in parts) == 8_192
    assert np.array_equal(np.concatenate([p["grid"] for p in parts]), arrays["tactile_18"][8_192:16_384])
    want = 8_192 * (6 * 7 * (4 + 8 + 8) + 8)  # a range of a pad, its shears and its times
    assert want <= file.read_bytes < 1.3 * want + 100_000 and file.read_bytes < len(data) / 20


@pytest.fixture
def tree(tmp_path):
    rng = random.Random(1)
    for rec in range(3):
        (tmp_path / f"rec{rec}").mkdir()
        for hand in ("left", "right"):
            a = glove(rng.randrange(1, 300), rec, shear=rec != 1)
            if rec == 2:
                a["tactile_0"] = a["tactile_0"][:5]
                a["tf_tactile_x_1"] = a["tf_tactile_x_1"][:2]
                a.pop("tactile_4")
            (tmp_path / f"rec{rec}" / f"{hand}_hand_data.npz").write_bytes(archives.saved(a, compressed=rec == 0))
    bad = tmp_path / "bad"
    bad.mkdir()
    whole = archives.saved(glove(50, 9))
    (bad / "left_hand_data.npz").write_bytes(whole[: len(whole) // 2])
    (bad / "right_hand_data.npz").write_bytes(b"PK broken")
    odd = tmp_path / "odd"
    odd.mkdir()
    (odd / "left_hand_data.npz").write_bytes(archives.saved(glove(5, 3) | {"tactile_5": np.zeros((5, 4))}))
    (odd / "right_hand_data.npz").write_bytes(archives.saved({"tactile_1": np.zeros((5, 2, 2))}))
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "left_hand_data.npz").write_bytes(archives.saved(glove(0, 3)))
    return str(tmp_path)


def rows_of(df):
    return sorted((r.recording_id, r.hand, r.pad, r.sample_idx, r.t_ns, r.h, r.w, str(r.force), str(r.shear_x), str(r.shear_y)) for r in df.collect())


def test_members_give_what_whole_archives_give(spark, tree):
    want = rows_of(files.read_npz_tactile(spark, tree))
    assert {r[0] for r in want} == {"rec0", "rec1", "rec2"} and len(want) > 1000
    assert rows_of(archives.read_npz_members(spark, tree, rows=64)) == want
    some = rows_of(archives.read_npz_members(spark, tree, pads=(3, 18)))
    assert [r for r in some if r[0] != "odd"] == [r for r in want if r[2] in (3, 18)]  # only what is wanted is looked at


def test_written_archives_are_whole(spark, tmp_path):
    data = archives.saved(glove(30, 4))
    df = spark.createDataFrame([("r1/left_hand_data.npz", bytearray(data)), ("r2/right_hand_data.npz", bytearray(data))], "path string, content binary")
    for _ in range(2):  # repeating it is harmless
        assert archives.write_archives(df, str(tmp_path / "out")).count() == 2
    assert archives.read_npz_members(spark, str(tmp_path / "out"), pads=(0,)).count() == 60
