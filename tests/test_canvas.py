"""Canvases against painting pad by pad."""

import random

import numpy as np
import pytest

from trajq.functions import layout
from trajq.operators.tactile import frame_canvases

TACTILE = "recording_id long, hand string, pad int, sample_idx long, t_ns long, h int, w int, force array<double>"


def painted(pads, hand, kind):
    """Each pad's gray grid, enlarged by nearest neighbour into its box, in the order of the pads."""
    canvas = np.zeros((224, 224), np.uint8)
    for j, pad in enumerate(layout.PADS):
        if pad not in pads:
            continue
        g = np.rint((np.clip(pads[pad], -1, 8) + 1) * (255 / 9)).astype(np.uint8)
        if kind == "hand":
            cx, cy, bw, bh = layout.BOXES[pad]
            cx = 1 - cx if hand == "left" else cx
            g = np.rot90(g) if pad == 18 else g
        else:
            row, col = divmod(j, 4)
            cx, cy, bw, bh = (col + 0.5) / 4, (row + 0.5) / 4, 0.25, 0.25
        x0, x1, y0, y1 = (max(0, min(224, round(v * 224))) for v in (cx - bw / 2, cx + bw / 2, cy - bh / 2, cy + bh / 2))
        rows = np.minimum((np.arange(y1 - y0) * (1 / ((y1 - y0) / g.shape[0]))).astype(int), g.shape[0] - 1)
        cols = np.minimum((np.arange(x1 - x0) * (1 / ((x1 - x0) / g.shape[1]))).astype(int), g.shape[1] - 1)
        canvas[y0:y1, x0:x1] = g[rows][:, cols]
    return canvas


@pytest.mark.parametrize("kind", ["hand", "grid"])
def test_canvases_are_painted_in_pad_order(spark, kind):
    rng = random.Random(3)
    frames, rows = {}, []
    for rec in range(2):
        for hand in ("left", "right"):
            for s in range(70):
                pads = {p: np.array([[rng.uniform(-2, 9) for _ in range(w)] for _ in range(h)]) for p in layout.PADS if rng.random() < 0.9 for h, w in [rng.choice([(2, 2), (5, 3), (9, 14)])]}
                frames[rec, hand, s] = pads
                rows += [(rec, hand, p, s, 0, *g.shape, g.reshape(-1).tolist()) for p, g in pads.items()]
    rows += [(0, "left", 99, 0, 0, 1, 1, [5.0])]  # not a pad
    rng.shuffle(rows)
    got = frame_canvases(spark.createDataFrame(rows, TACTILE), layout=kind).collect()
    assert {(r.recording_id, r.hand, r.sample_idx) for r in got} == set(frames) and len(got) == len(frames)
    for r in got:
        assert bytes(r.canvas) == painted(frames[r.recording_id, r.hand, r.sample_idx], r.hand, kind).tobytes()


def test_channels_and_nothing(spark):
    df = spark.createDataFrame([(1, "left", 3, 0, 0, 1, 1, [8.0])], TACTILE)
    one, three = (frame_canvases(df, channels=c).first().canvas for c in (1, 3))
    assert len(three) == 3 * 224 * 224 and bytes(three[::3]) == bytes(one) == bytes(three[2::3]) and max(one) == 255
    assert frame_canvases(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="layout"):
        frame_canvases(df, layout="foot")


def test_a_pad_without_finite_values_fails_the_fit(spark):
    from trajq.operators.padfit import pad_norm_fit

    rows = [(1, "left", p, s, 0, 1, 2, [float(s), float("nan") if p == 3 else 1.0]) for p in (0, 3) for s in range(9)]
    assert pad_norm_fit(spark.createDataFrame(rows, TACTILE)).count() == 2
    rows += [(1, "right", 5, 0, 0, 1, 2, [float("nan"), float("inf")])]
    with pytest.raises(Exception, match="no finite training values for pad right 5"):
        pad_norm_fit(spark.createDataFrame(rows, TACTILE)).collect()
