"""Column functions on numeric vectors (array columns) and readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def _clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / (std + 1e-6) per dimension; longer statistics are cut to the vector."""
    return F.transform(x, lambda v, i: (v - mean[i]) / (std[i] + EPS))


def unzscore(x: Column, mean: Column, std: Column) -> Column:
    """Inverse of zscore; dimensions beyond the statistics use mean 0 and std 1."""
    return F.transform(x, lambda v, i: v * (F.coalesce(F.get(std, i), F.lit(1.0)) + EPS) + F.coalesce(F.get(mean, i), F.lit(0.0)))


def quantile_norm(x: Column, q01: Column, q99: Column) -> Column:
    """Map [q01, q99] to [-1, 1] per dimension."""
    return F.transform(x, lambda v, i: (v - q01[i]) / (q99[i] - q01[i] + EPS) * 2.0 - 1.0)


def unquantile_norm(x: Column, q01: Column, q99: Column) -> Column:
    """Inverse of quantile_norm; dimensions beyond the statistics pass through."""
    return F.transform(
        x, lambda v, i: F.when(i < F.size(q01), (v + 1.0) / 2.0 * (F.get(q99, i) - F.get(q01, i) + EPS) + F.get(q01, i)).otherwise(v)
    )


def bool_mask(*dims: int) -> list[bool]:
    """Positive counts add True, negative counts False: (2, -2, 1) -> TTFFT."""
    out: list[bool] = []
    for d in dims:
        out += [d > 0] * abs(d)
    return out


def _shift(chunk: Column, state: Column, mask: Sequence[bool] | None, sign: int) -> Column:
    if mask is None:
        return chunk
    on = F.array(*[F.lit(sign if m else 0) for m in mask])
    one = lambda row: F.transform(
        row, lambda v, i: F.when(i < len(mask), v + F.get(on, i) * F.get(state, i)).otherwise(v)
    )
    return F.transform(chunk, one)


def delta_mask(chunk: Column, state: Column, mask: Sequence[bool] | None) -> Column:
    """Subtract the state from every row of a chunk on the masked leading dimensions."""
    return _shift(chunk, state, mask, -1)


def absolute_mask(chunk: Column, state: Column, mask: Sequence[bool] | None) -> Column:
    """Inverse of delta_mask."""
    return _shift(chunk, state, mask, 1)


def pad_to_width(x: Column, width: int, value: float = 0.0, *, strict: bool = True) -> Column:
    """Pad a vector; a wider one is an error, or passes through when not ``strict``."""
    padded = F.concat(x, F.array_repeat(F.lit(value).cast("double"), F.lit(width) - F.size(x)))
    wide = F.raise_error(F.lit(f"vector wider than {width}")) if strict else x
    return F.when(F.size(x) > width, wide).otherwise(padded)


def width_mask(x: Column, width: int) -> Column:
    """True on the dimensions a vector really has."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: i < F.size(x))


def leading_dims(chunk: Column, n: int) -> Column:
    """First n dimensions of every row of a chunk."""
    return F.transform(chunk, lambda row: F.slice(row, 1, n))


def discretize(x: Column, bins: int = 256) -> Column:
    """Bin number over [-1, 1]; -1 below the range, the last bin at and above 1."""
    return F.transform(x, lambda v: F.least(F.greatest(F.floor((v + 1.0) * (bins / 2)), F.lit(-1)), F.lit(bins - 1)).cast("int"))


def prompt_text(task: Column, state: Column, *, lower: bool = False, bins: int = 256) -> Column:
    """``Task: ..., State: ...;\\nAction: `` with cleaned text and the discretized state.

    The lower-case variant keeps newlines and ends after the state.
    """
    bare = F.regexp_replace(F.lower(task) if lower else task, r"^\s+|\s+$", "")
    clean = F.translate(bare, "_", " ") if lower else F.translate(bare, "_\n", "  ")
    numbers = F.array_join(F.transform(discretize(state, bins), lambda v: v.cast("string")), " ")
    return F.concat(F.lit("Task: "), clean, F.lit(", State: "), numbers, F.lit(";\n" if lower else ";\nAction: "))


def normalize_pressure(x: Column, base: Column, scale: Column) -> Column:
    """clip((x - base) / max(scale, 1e-6), -1, 8)."""
    return _clip((x - base) / F.greatest(scale, F.lit(EPS)), -1.0, 8.0)


def pressure_gray(x: Column) -> Column:
    """0..255 transport value of a normalized pressure (half-even rounding; 0 maps to 28)."""
    return F.rint((_clip(x, -1.0, 8.0) + 1) * (255 / 9)).cast("int")


def to_u8_unsigned(x: Column, lo: Column, hi: Column) -> Column:
    return _clip((x - lo) / (hi - lo) * 255.0, 0.0, 255.0).cast("int")


def to_u8_signed(x: Column, mag: Column) -> Column:
    good = F.when((mag > 0) & ~F.isnan(mag) & (mag != float("inf")), mag).otherwise(F.lit(1.0))
    return _clip(F.lit(127.5) + x / good * 127.5, 0.0, 255.0).cast("int")


def letterbox_dims(w: Column, h: Column, size: int = 224, *, truncate: bool = False) -> dict[str, Column]:
    """Resized width/height and left/top padding of an aspect-preserving fit."""
    if truncate:
        ratio = F.greatest(w, h) / F.lit(float(size))
        rw, rh = F.floor(w / ratio), F.floor(h / ratio)
    else:
        ratio = F.lit(float(size)) / F.greatest(w, h)
        rw, rh = (F.greatest(F.rint(v * ratio).cast("bigint"), F.lit(1)) for v in (w, h))
    half = lambda r: F.floor((F.lit(size) - r) / 2)
    return {"new_w": rw, "new_h": rh, "pad_x": half(rw), "pad_y": half(rh)}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def masked_view_mean(views: Sequence[Column], masks: Sequence[Column]) -> tuple[Column, Column]:
    """Mean over the valid views only, and whether any view is valid."""
    flags = [F.coalesce(m, F.lit(False)) for m in masks]
    n = sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))
    picked = F.transform(
        views[0],
        lambda _, i: sum((F.when(f, v[i]).otherwise(F.lit(0.0)) for v, f in list(zip(views, flags))[1:]),
                         F.when(flags[0], views[0][i]).otherwise(F.lit(0.0))) / F.greatest(n, F.lit(1)),
    )
    return picked, n > 0


def placeholder_targets(width: int) -> tuple[Column, Column]:
    """Zero state and action for rows without robot targets."""
    zero = F.array_repeat(F.lit(0.0), width)
    return zero, zero


def grid_pool(cells: Column, h: Column, w: Column, k: int) -> Column:
    """Average-pool a row-major grid to k x k; bins overlap where a side is not a multiple of k."""
    lo = lambda i, n: F.floor(i * n / k).cast("int")
    hi = lambda i, n: F.ceil((i + 1) * n / k).cast("int")

    def cell(p: Column) -> Column:
        r, c = F.floor(p / k).cast("int"), F.pmod(p, F.lit(k))
        rows = F.sequence(lo(r, h), hi(r, h) - 1)
        width = hi(c, w) - lo(c, w)
        total = F.aggregate(
            rows, F.lit(0.0),
            lambda s, y: s + F.aggregate(F.slice(cells, y * w + lo(c, w) + 1, width), F.lit(0.0), lambda a, v: a + v),
        )
        return total / (F.size(rows) * width)

    return F.transform(F.sequence(F.lit(0), F.lit(k * k - 1)), cell)
