"""Rotations as closed-form column algebra.

A rotation is six numbers, the first two matrix columns. The functions that need matrices work on
a table and add the intermediate values as scalar columns, step by step: every shared value is
computed once and all of it stays in generated code. The result leaves through a one-element
``explode``, so a later filter on it is not pushed below the steps and inlined there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajq.functions.layout import SLOTS, WIDTH

Vec = list[Column]
EYE = [1.0 if i % 4 == 0 else 0.0 for i in range(9)]


def _add(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    return df.selectExpr("*", *[f"{e} AS {n}" for n, e in cols.items()])


def _result(df: DataFrame, keep: Sequence[str], cols: Mapping[str, str]) -> DataFrame:
    """The kept columns and the named results, behind a one-element explode."""
    fields = ", ".join(f"'{n}', {e}" for n, e in cols.items())
    names = [f"`{c}`" for c in keep if c not in cols]
    return df.selectExpr(*names, f"explode(array(named_struct({fields}))) AS _r").selectExpr(*names, *[f"_r.`{n}` AS `{n}`" for n in cols])


def _sum(terms: Sequence[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def _dot(a: Sequence[str], b: Sequence[str]) -> str:
    return _sum([f"{x} * {y}" for x, y in zip(a, b)])


def _v(name: str, part: str, n: int = 3) -> list[str]:
    return [f"_{name}_{part}{i}" for i in range(n)]


def _matrices(df: DataFrame, sources: Mapping[str, tuple[str, int]], guard: bool) -> DataFrame:
    """Add scalars ``_<name>_m0..8``: matrix columns b1, b2, b3 of (vector column, first entry)."""
    df = _add(df, {a: f"cast({col}[{lo + i}] AS double)" for n, (col, lo) in sources.items() for i, a in enumerate(_v(n, "a", 6))})
    df = _add(df, {f"_{n}_n1": f"sqrt({_dot(_v(n, 'a', 6)[:3], _v(n, 'a', 6)[:3])})" for n in sources})
    safe = (lambda c: f"CASE WHEN {c} < 1e-8D THEN 1D ELSE {c} END") if guard else (lambda c: f"nullif({c}, 0D)")
    df = _add(df, {b: f"{a} / {safe(f'_{n}_n1')}" for n in sources for a, b in zip(_v(n, "a", 6), _v(n, "b"))})
    df = _add(df, {f"_{n}_d": _dot(_v(n, "b"), _v(n, "a", 6)[3:]) for n in sources})
    df = _add(df, {p: f"{a} - _{n}_d * {b}" for n in sources for a, b, p in zip(_v(n, "a", 6)[3:], _v(n, "b"), _v(n, "p"))})
    df = _add(df, {f"_{n}_n2": f"sqrt({_dot(_v(n, 'p'), _v(n, 'p'))})" for n in sources})
    df = _add(df, {c: f"{p} / {safe(f'_{n}_n2')}" for n in sources for p, c in zip(_v(n, "p"), _v(n, "c"))})
    out = {}
    for n in sources:
        b, c = _v(n, "b"), _v(n, "c")
        third = [f"{b[(i + 1) % 3]} * {c[(i + 2) % 3]} - {b[(i + 2) % 3]} * {c[(i + 1) % 3]}" for i in range(3)]
        for i, (e, one) in enumerate(zip([*b, *c, *third], EYE)):
            out[f"_{n}_m{i}"] = f"CASE WHEN _{n}_n1 < 1e-6D OR _{n}_n2 < 1e-6D THEN {one}D ELSE {e} END" if guard else e
    return _add(df, out)


def _m(name: str, row: int, col: int) -> str:
    return f"_{name}_m{3 * col + row}"


def matrix_from_rot6d(df: DataFrame, sources: Mapping[str, tuple[str, int]], *, guard: bool = True) -> DataFrame:
    """Add per name an array of 9, the matrix columns b1, b2, b3 (Gram-Schmidt).

    ``sources``: name -> (vector column, first entry). ``guard`` gives the identity where a column
    is shorter than 1e-6; without it the entries of such a row are null.
    """
    d = _matrices(df, sources, guard)
    return _result(d, df.columns, {n: f"array({', '.join(_v(n, 'm', 9))})" for n in sources})


def _rotate(df: DataFrame, action: str, state: str, mask: str | None, arms: Sequence[str], inverse: bool, guard: bool) -> DataFrame:
    sources = {}
    for arm in arms:
        lo = SLOTS[f"{arm}_rot6d"][0]
        sources[f"{arm}a"], sources[f"{arm}s"] = (f"`{action}`", lo), (f"`{state}`", lo)
    d = _matrices(df, sources, guard)
    cells = [f"cast(`{action}`[{i}] AS double)" for i in range(WIDTH)]
    for arm in arms:
        a, s = f"{arm}a", f"{arm}s"
        xlo, rlo = SLOTS[f"{arm}_xyz"][0], SLOTS[f"{arm}_rot6d"][0]
        new = {xlo + i: f"`{action}`[{xlo + i}] {'+' if inverse else '-'} `{state}`[{xlo + i}]" for i in range(3)}
        for k in (0, 1):
            for i in range(3):  # entry (i, k) of R * S, or of A * S^T
                terms = [f"{_m(a, i, j)} * {_m(s, j, k) if inverse else _m(s, k, j)}" for j in range(3)]
                new[rlo + 3 * k + i] = _sum(terms)
        active = " AND ".join(f"coalesce(`{mask}`[{xlo + i}], false)" for i in range(3)) if mask is not None else None
        for i, e in new.items():
            cells[i] = e if active is None else f"CASE WHEN {active} THEN {e} ELSE {cells[i]} END"
    return _result(d, df.columns, {action: f"array({', '.join(cells)})"})


def rotation_delta(df: DataFrame, action: str = "action", state: str = "state", *, mask: str | None = None, arms: Sequence[str] = ("left", "right"), guard: bool = True) -> DataFrame:
    """Absolute 32-slot action relative to the state: xyz difference, R_action * R_state^T as rot6d.

    With a ``mask`` column only arms whose three xyz entries are true are changed.
    """
    return _rotate(df, action, state, mask, arms, False, guard)


def rotation_absolute(df: DataFrame, action: str = "action", state: str = "state", *, mask: str | None = None, arms: Sequence[str] = ("left", "right"), guard: bool = True) -> DataFrame:
    """Inverse of rotation_delta."""
    return _rotate(df, action, state, mask, arms, True, guard)


def geodesic_deg(df: DataFrame, a: tuple[str, int], b: tuple[str, int], *, name: str = "deg") -> DataFrame:
    """Add the angle between two rotations, each (vector column, first entry of its six numbers)."""
    d = _matrices(df, {"ga": a, "gb": b}, False)
    trace = _dot(_v("ga", "m", 9), _v("gb", "m", 9))
    return _result(d, df.columns, {name: f"degrees(acos(least(greatest(({trace} - 1) / 2, -1D), 1D)))"})


def axis_angle_to_rot6d(rotvec: Vec) -> Vec:
    """Rotation vector in degrees to the first two matrix columns (Rodrigues)."""
    x, y, z = [F.radians(v) for v in rotvec]
    t2 = x * x + y * y + z * z
    t = F.sqrt(t2)
    small = t < 1e-8
    a = F.when(small, 1.0 - t2 / 6).otherwise(F.sin(t) / F.when(small, 1.0).otherwise(t))
    half = F.sin(t / 2)
    b = F.when(small, 0.5 - t2 / 24).otherwise(2 * half * half / F.when(small, 1.0).otherwise(t2))
    return [
        1 - b * (y * y + z * z), a * z + b * x * y, -a * y + b * x * z,
        -a * z + b * x * y, 1 - b * (x * x + z * z), a * x + b * y * z,
    ]


def quat_to_axis_angle(w: Column, x: Column, y: Column, z: Column) -> tuple[Vec, Column]:
    """Quaternion to rotation vector in degrees, and whether it is a usable rotation."""
    n2 = w * w + x * x + y * y + z * z
    fin = F.coalesce((n2 < float("inf")) & ~F.isnan(n2), F.lit(False))
    ok = fin & (F.sqrt(n2) > 1e-8)
    sign = F.when(w < 0, -1.0).otherwise(1.0)
    v = F.sqrt(x * x + y * y + z * z)
    angle = 2 * F.atan2(v, F.abs(w))
    k = F.when(v > 0, F.degrees(angle) / F.when(v > 0, v).otherwise(1.0)).otherwise(F.lit(0.0)) * sign
    return [F.when(ok, c * k).otherwise(F.lit(0.0)) for c in (x, y, z)], ok


def pack_canonical(arm: dict[str, Column], hand: dict[str, Column]) -> Column:
    """32 slots from per-side arm (xyz mm + rotation vector deg) and hand (6 motor) vectors."""
    cells = [F.lit(0.0)] * WIDTH
    for side, a in arm.items():
        lo = SLOTS[f"{side}_xyz"][0]
        cells[lo:lo + 3] = [a[i].cast("double") for i in range(3)]
        lo = SLOTS[f"{side}_rot6d"][0]
        cells[lo:lo + 6] = axis_angle_to_rot6d([a[i].cast("double") for i in (3, 4, 5)])
    for side, h in hand.items():
        lo = SLOTS[f"{side}_hand"][0]
        cells[lo:lo + 6] = [h[i].cast("double") for i in range(6)]
    return F.array(*cells)


def action_mask(sides: Sequence[str] = ("left", "right")) -> Column:
    """True on the slots a packed row fills."""
    on = [False] * WIDTH
    for s in sides:
        for block in ("xyz", "rot6d", "hand"):
            lo, hi = SLOTS[f"{s}_{block}"]
            on[lo:hi] = [True] * (hi - lo)
    return F.array(*[F.lit(v) for v in on])


def decode_canonical(df: DataFrame, packed: str, sides: Sequence[str] = ("left", "right")) -> DataFrame:
    """Add ``<side>_arm`` (xyz + rotation vector deg) and ``<side>_hand`` of packed rows.

    The rotation vector goes through the quaternion, from its largest component, so it is stable
    near 0 and 180 degrees.
    """
    d = _matrices(df, {s: (f"`{packed}`", SLOTS[f"{s}_rot6d"][0]) for s in sides}, False)
    quat, vec, out = {}, {}, {}
    for s in sides:
        g = lambda i, j, s=s: _m(s, i, j)
        anti = [f"({g(2, 1)} - {g(1, 2)})", f"({g(0, 2)} - {g(2, 0)})", f"({g(1, 0)} - {g(0, 1)})"]
        both = lambda i, j, g=g: f"({g(i, j)} + {g(j, i)})"
        diag = lambda x, y, z, g=g: f"(1 {x} {g(0, 0)} {y} {g(1, 1)} {z} {g(2, 2)})"
        forms = [
            [diag("+", "+", "+"), *anti],
            [anti[0], diag("+", "-", "-"), both(1, 0), both(2, 0)],
            [anti[1], both(1, 0), diag("-", "+", "-"), both(2, 1)],
            [anti[2], both(2, 0), both(2, 1), diag("-", "-", "+")],
        ]
        trace = _sum([g(0, 0), g(1, 1), g(2, 2)])
        top = f"greatest({trace}, {g(0, 0)}, {g(1, 1)}, {g(2, 2)})"
        for i in range(4):
            quat[f"_{s}_q{i}"] = (f"CASE {top} WHEN {trace} THEN {forms[0][i]} WHEN {g(0, 0)} THEN {forms[1][i]} "
                                  f"WHEN {g(1, 1)} THEN {forms[2][i]} ELSE {forms[3][i]} END")
        w, xyz = f"_{s}_q0", [f"_{s}_q{i}" for i in (1, 2, 3)]
        vec[f"_{s}_len"] = f"sqrt({_dot(xyz, xyz)})"
        turn = f"CASE WHEN _{s}_len > 0 THEN degrees(2 * atan2(_{s}_len, abs({w}))) / nullif(_{s}_len, 0D) * CASE WHEN {w} < 0 THEN -1D ELSE 1D END ELSE 0D END"
        vec_k = f"_{s}_k"
        lo, hlo = SLOTS[f"{s}_xyz"][0], SLOTS[f"{s}_hand"][0]
        out[vec_k] = turn
        out[f"{s}_arm"] = f"array({', '.join([f'`{packed}`[{lo + i}]' for i in range(3)] + [f'{x} * {vec_k}' for x in xyz])})"
        out[f"{s}_hand"] = f"slice(`{packed}`, {hlo + 1}, 6)"
    d = _add(_add(d, quat), vec)
    d = _add(d, {k: e for k, e in out.items() if k.endswith("_k")})
    return _result(d, df.columns, {k: e for k, e in out.items() if not k.endswith("_k")})
