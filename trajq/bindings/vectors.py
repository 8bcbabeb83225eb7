"""Queries for vector, rotation, pressure and layout functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajq.bindings.data import FRAMES_SQL, TACTILE_SQL, frames, table, tactile
from trajq.functions import layout, rotations, vectors
from trajq.operators.tactile import frame_canvases, pad_tiles

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def dims(df, ids, col, name="x", digits=6):
    out = df.select(*ids, F.posexplode(col).alias("dim", "_x"))
    return out.select(*ids, F.col("dim").cast("bigint").alias("dim"), F.round("_x", digits).alias(name))


MEANS_SQL = """m AS (SELECT dim, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS q01, max(x) AS q99 FROM
  (SELECT generate_subscripts(state, 1) - 1 AS dim, unnest(state) AS x FROM frames) GROUP BY 1),
x AS (SELECT vec_id, episode_index, frame_index, generate_subscripts(state, 1) - 1 AS dim, unnest(state) AS s, unnest(action) AS a FROM frames)"""


def with_stats(spark, sf):
    """Frames with the per-dimension statistics (32 entries)."""
    f = frames(spark, sf)
    m = f.select(F.posexplode("state").alias("dim", "x")).groupBy("dim").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("q01"), F.max("x").alias("q99"))
    m = m.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std", "q01", "q99")))).scalar()
    return f.withColumns({c: m[c] for c in ("mean", "std", "q01", "q99")})


@query("zscore", f"WITH {FRAMES_SQL}, {MEANS_SQL} SELECT vec_id, dim, round((s - mean) / (std + 1e-6), 6) AS x FROM x JOIN m USING (dim)")
def _(spark, sf):
    return dims(with_stats(spark, sf).withColumn("z", vectors.zscore(F.col("state"), F.col("mean"), F.col("std"))), ["vec_id"], "z")


@query("unzscore", f"""WITH {FRAMES_SQL}, {MEANS_SQL} SELECT vec_id, dim,
  round(CASE WHEN dim < 20 THEN a * (std + 1e-6) + mean ELSE a * (1 + 1e-6) END, 6) AS x FROM x JOIN m USING (dim)""")
def _(spark, sf):
    z = vectors.unzscore(F.col("action"), F.slice("mean", 1, 20), F.slice("std", 1, 20))
    return dims(with_stats(spark, sf).withColumn("z", z), ["vec_id"], "z")


@query("quantile_norm", f"WITH {FRAMES_SQL}, {MEANS_SQL} SELECT vec_id, dim, round((s - q01) / (q99 - q01 + 1e-6) * 2.0 - 1.0, 6) AS x FROM x JOIN m USING (dim)")
def _(spark, sf):
    z = vectors.quantile_norm(F.col("state"), F.col("q01"), F.col("q99"))
    return dims(with_stats(spark, sf).withColumn("z", z), ["vec_id"], "z")


@query("unquantile_norm", f"""WITH {FRAMES_SQL}, {MEANS_SQL} SELECT vec_id, dim,
  round(CASE WHEN dim < 20 THEN (a + 1.0) / 2.0 * (q99 - q01 + 1e-6) + q01 ELSE a END, 6) AS x FROM x JOIN m USING (dim)""")
def _(spark, sf):
    z = vectors.unquantile_norm(F.col("action"), F.slice("q01", 1, 20), F.slice("q99", 1, 20))
    return dims(with_stats(spark, sf).withColumn("z", z), ["vec_id"], "z")


def _masked(spark, sf, fn):
    mask = vectors.bool_mask(9, -1)
    f = frames(spark, sf).withColumn("c", fn(F.array("action", F.reverse("action")), F.col("state"), mask))
    return f.select("vec_id", F.posexplode("c").alias("step", "r")).select(
        "vec_id", F.col("step").cast("bigint").alias("step"), F.posexplode("r").alias("dim", "x")).select(
        "vec_id", "step", F.col("dim").cast("bigint").alias("dim"), F.round("x", 6).alias("x"))


_MASKED_SQL = f"""WITH {FRAMES_SQL}, x AS (SELECT vec_id, 0 AS step, generate_subscripts(action, 1) - 1 AS dim, unnest(action) AS a, unnest(state) AS s FROM frames
  UNION ALL SELECT vec_id, 1, generate_subscripts(action, 1) - 1, unnest(list_reverse(action)), unnest(state) FROM frames)
  SELECT vec_id, step::BIGINT AS step, dim, round(a %s CASE WHEN dim < 9 THEN s ELSE 0 END, 6) AS x FROM x"""


@query("delta_mask", _MASKED_SQL % "-")
def _(spark, sf):
    return _masked(spark, sf, vectors.delta_mask)


@query("absolute_mask", _MASKED_SQL % "+")
def _(spark, sf):
    return _masked(spark, sf, vectors.absolute_mask)


@query("bool_mask", f"WITH {FRAMES_SQL} SELECT vec_id, dim, round(CASE WHEN dim % 4 < 2 THEN action[dim + 1] ELSE -action[dim + 1] END, 6) AS x FROM frames, range(0, 32) t(dim)")
def _(spark, sf):
    mask = F.array(*map(F.lit, vectors.bool_mask(*[2, -2] * 8)))
    signed = F.transform("action", lambda v, i: F.when(F.get(mask, i), v).otherwise(-v))
    return frames(spark, sf).select("vec_id", F.posexplode(signed).alias("dim", "x")).select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("x", 6).alias("x"))


@query("pad_to_width", f"""WITH {FRAMES_SQL} SELECT vec_id, dim, CASE WHEN dim < 20 THEN round(state[dim + 1], 6) ELSE 0 END AS x, dim < 20 AS real
  FROM frames, range(0, 32) t(dim)""")
def _(spark, sf):
    f = frames(spark, sf).withColumn("v", F.slice("state", 1, 20))
    f = f.withColumn("z", F.arrays_zip(vectors.pad_to_width(F.col("v"), 32).alias("x"), vectors.width_mask(F.col("v"), 32).alias("r")))
    return f.select("vec_id", F.posexplode("z").alias("dim", "z")).select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("z.x", 6).alias("x"), F.col("z.r").alias("real"))


@query("leading_dims", f"WITH {FRAMES_SQL} SELECT vec_id, dim, round(action[dim + 1], 6) AS x FROM frames, range(0, 10) t(dim)")
def _(spark, sf):
    f = frames(spark, sf).withColumn("c", vectors.leading_dims(F.array("action"), 10)[0])
    return dims(f, ["vec_id"], "c")


@query("discretize", f"""WITH {FRAMES_SQL}, x AS (SELECT vec_id, generate_subscripts(state, 1) - 1 AS dim, unnest(state) * 6 AS s FROM frames)
  SELECT vec_id, dim, least(greatest(floor((s + 1) * 128), -1), 255)::BIGINT AS bin FROM x""")
def _(spark, sf):
    f = frames(spark, sf).withColumn("b", vectors.discretize(F.transform("state", lambda v: v * 6)))
    return f.select("vec_id", F.posexplode("b").alias("dim", "b")).select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), F.col("b").cast("bigint").alias("bin"))


_BINS = "array_to_string(list_transform(state, lambda v: least(greatest(floor((v + 1) * 128), -1), 255)::INT), ' ')"


@query("prompt_text", f"""WITH {FRAMES_SQL}, t AS (SELECT conv_id, turn, text FROM conversations)
  SELECT vec_id, turn, 'Task: ' || translate(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '_' || chr(10), '  ') || ', State: ' || {_BINS} || ';' || chr(10) || 'Action: ' AS prompt,
    'Task: ' || translate(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '_', ' ') || ', State: ' || {_BINS} || ';' || chr(10) AS lower_prompt
  FROM frames JOIN t ON vec_id = conv_id""")
def _(spark, sf):
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("vec_id"), "turn", "text")
    s = F.col("state")
    return frames(spark, sf).join(t, "vec_id").select(
        "vec_id", "turn", vectors.prompt_text(F.col("text"), s).alias("prompt"), vectors.prompt_text(F.col("text"), s, lower=True).alias("lower_prompt"))


query("prompt_text_turns", SQL["prompt_text"])(QUERIES["prompt_text"])  # a name it also had


@query("normalize_pressure", """SELECT event_id, round(least(greatest((value - 5) / greatest(20.0, 1e-6), -1), 8), 9) AS x FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.round(vectors.normalize_pressure(F.col("value"), F.lit(5.0), F.lit(20.0)), 9).alias("x"))


@query("pressure_gray", """SELECT event_id, round_even((least(greatest((value - 5) / 20.0::DOUBLE, -1), 8) + 1) * (255 / 9.0::DOUBLE), 0)::BIGINT AS gray FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    x = vectors.normalize_pressure(F.col("value"), F.lit(5.0), F.lit(20.0))
    return e.select("event_id", vectors.pressure_gray(x).cast("bigint").alias("gray"))


@query("to_u8", """SELECT event_id, trunc(least(greatest((value - 5) / (100 - 5.0::DOUBLE) * 255, 0), 255))::BIGINT AS unsigned,
  trunc(least(greatest(127.5::DOUBLE + (value - 50) / 60.0::DOUBLE * 127.5::DOUBLE, 0), 255))::BIGINT AS signed FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", vectors.to_u8_unsigned(F.col("value"), F.lit(5.0), F.lit(100.0)).cast("bigint").alias("unsigned"),
                    vectors.to_u8_signed(F.col("value") - 50, F.lit(60.0)).cast("bigint").alias("signed"))


def gram_schmidt_sql(src, cols, out):
    """SQL twin of the matrix from six numbers: cols maps a name to (vector, first 1-based index)."""
    n1, b1, p2, n2, m = [], [], [], [], []
    for k, (v, i) in cols.items():
        a = [f"{v}[{i + j}]" for j in range(6)]
        n1.append(f"sqrt({a[0]}*{a[0]} + {a[1]}*{a[1]} + {a[2]}*{a[2]}) AS {k}n1")
        b1 += [f"{a[j]} / CASE WHEN {k}n1 < 1e-8 THEN 1 ELSE {k}n1 END AS {k}b{j}" for j in range(3)]
        dot = f"({k}b0*{a[3]} + {k}b1*{a[4]} + {k}b2*{a[5]})"
        p2 += [f"{a[3 + j]} - {dot} * {k}b{j} AS {k}p{j}" for j in range(3)]
        n2.append(f"sqrt({k}p0*{k}p0 + {k}p1*{k}p1 + {k}p2*{k}p2) AS {k}n2")
        c = [f"{k}p{j} / CASE WHEN {k}n2 < 1e-8 THEN 1 ELSE {k}n2 END" for j in range(3)]
        b = [f"{k}b{j}" for j in range(3)]
        full = [*b, *c] + [f"{b[(j + 1) % 3]} * ({c[(j + 2) % 3]}) - {b[(j + 2) % 3]} * ({c[(j + 1) % 3]})" for j in range(3)]
        eye = [1.0 if j % 4 == 0 else 0.0 for j in range(9)]
        m.append(f"CASE WHEN {k}n1 < 1e-6 OR {k}n2 < 1e-6 THEN {[float(e) for e in eye]}::DOUBLE[] ELSE [{', '.join(full)}] END AS {k}m")
    return (f"{out}1 AS (SELECT *, {', '.join(n1)} FROM {src}), {out}2 AS (SELECT *, {', '.join(b1)} FROM {out}1), "
            f"{out}3 AS (SELECT *, {', '.join(p2)} FROM {out}2), {out}4 AS (SELECT *, {', '.join(n2)} FROM {out}3), "
            f"{out} AS (SELECT *, {', '.join(m)} FROM {out}4)")


def _rotated_sql(inverse):
    cells = [f"action[{i + 1}]" for i in range(32)]
    op = "+" if inverse else "-"
    for k, x in (("l", 0), ("r", 10)):
        for j in range(3):
            cells[x + j] = f"action[{x + j + 1}] {op} state[{x + j + 1}]"
        for c in (0, 1):
            for i in range(3):
                if inverse:
                    terms = [f"{k}am[{3 * j + i + 1}] * {k}sm[{3 * c + j + 1}]" for j in range(3)]
                else:
                    terms = [f"{k}am[{3 * j + i + 1}] * {k}sm[{3 * j + c + 1}]" for j in range(3)]
                cells[x + 3 + 3 * c + i] = " + ".join(terms)
    gs = gram_schmidt_sql("frames", {"la": ("action", 4), "ls": ("state", 4), "ra": ("action", 14), "rs": ("state", 14)}, "g")
    return (f"WITH {FRAMES_SQL}, {gs}, o AS (SELECT vec_id, [{', '.join(cells)}] AS v FROM g) "
            "SELECT vec_id, generate_subscripts(v, 1) - 1 AS dim, round(unnest(v), 6) AS x FROM o")


@query("rotation_delta", _rotated_sql(False))
def _(spark, sf):
    return dims(rotations.rotation_delta(frames(spark, sf)), ["vec_id"], "action")


@query("rotation_absolute", _rotated_sql(True))
def _(spark, sf):
    return dims(rotations.rotation_absolute(frames(spark, sf)), ["vec_id"], "action")


@query("axis_angle_to_rot6d", f"""WITH {FRAMES_SQL}, a AS (SELECT vec_id, radians(state[1] * 300) x, radians(state[2] * 300) y, radians(state[3] * 300) z FROM frames),
  b AS (SELECT *, sqrt(x*x + y*y + z*z) AS t FROM a), c AS (SELECT *, sin(t) / t AS p, (1 - cos(t)) / (t * t) AS q FROM b)
  SELECT vec_id, round(1 - q*(y*y + z*z), 6) AS r0, round(p*z + q*x*y, 6) AS r1, round(-p*y + q*x*z, 6) AS r2,
    round(-p*z + q*x*y, 6) AS r3, round(1 - q*(x*x + z*z), 6) AS r4, round(p*x + q*y*z, 6) AS r5 FROM c""")
def _(spark, sf):
    r = rotations.axis_angle_to_rot6d([F.col("state")[i] * 300 for i in range(3)])
    return frames(spark, sf).select("vec_id", *[F.round(v, 6).alias(f"r{i}") for i, v in enumerate(r)])


@query("quat_to_axis_angle", f"""WITH {FRAMES_SQL}, q AS (SELECT vec_id, state[1] w, state[2] x, state[3] y, state[4] z FROM frames),
  a AS (SELECT *, sqrt(x*x + y*y + z*z) AS v, sqrt(w*w + x*x + y*y + z*z) > 1e-8 AS ok FROM q),
  k AS (SELECT *, degrees(2 * atan2(v, abs(w))) / v * CASE WHEN w < 0 THEN -1 ELSE 1 END AS f FROM a)
  SELECT vec_id, round(x * f, 6) AS rx, round(y * f, 6) AS ry, round(z * f, 6) AS rz, ok FROM k""")
def _(spark, sf):
    s = F.col("state")
    v, ok = rotations.quat_to_axis_angle(s[0], s[1], s[2], s[3])
    return frames(spark, sf).select("vec_id", *[F.round(c, 6).alias(n) for c, n in zip(v, ("rx", "ry", "rz"))], ok.alias("ok"))


@query("geodesic_deg", f"WITH {FRAMES_SQL}, {gram_schmidt_sql('frames', {'a': ('action', 4), 's': ('state', 4)}, 'g')} SELECT vec_id, "
       "round(degrees(acos(least(greatest((list_dot_product(am, sm) - 1) / 2, -1), 1))), 6) AS deg FROM g")
def _(spark, sf):
    d = rotations.geodesic_deg(frames(spark, sf), ("action", 3), ("state", 3))
    return d.select("vec_id", F.round("deg", 6).alias("deg"))


def _packed(spark, sf):
    f = frames(spark, sf)
    part = lambda c, i, k: F.transform(F.slice(c, i, 6), lambda v: v * k)
    return f.select("vec_id", part("state", 1, 300).alias("ra"), part("state", 7, 300).alias("la"),
                    part("action", 1, 1000).alias("rh"), part("action", 7, 1000).alias("lh"))


_ROD = """list_transform({v}[4:6], lambda q: radians(q)) AS {k}v"""


@query("pack_canonical", f"""WITH {FRAMES_SQL}, f AS (SELECT vec_id, list_transform(state[1:6], lambda q: q * 300) ra, list_transform(state[7:12], lambda q: q * 300) la,
    list_transform(action[1:6], lambda q: q * 1000) rh, list_transform(action[7:12], lambda q: q * 1000) lh FROM frames),
  s AS (SELECT vec_id, 'r' AS side, ra AS a, rh AS h FROM f UNION ALL SELECT vec_id, 'l', la, lh FROM f),
  t AS (SELECT *, radians(a[4]) x, radians(a[5]) y, radians(a[6]) z FROM s), u AS (SELECT *, sqrt(x*x+y*y+z*z) AS n FROM t),
  c AS (SELECT *, sin(n) / n AS p, (1 - cos(n)) / (n * n) AS q FROM u),
  m AS (SELECT vec_id, side, [a[1], a[2], a[3], 1 - q*(y*y + z*z), p*z + q*x*y, -p*y + q*x*z, -p*z + q*x*y, 1 - q*(x*x + z*z), p*x + q*y*z, 0.0] AS e, h FROM c),
  o AS (SELECT l.vec_id, l.e || r.e || r.h || l.h AS v FROM m l JOIN m r ON l.vec_id = r.vec_id AND l.side = 'l' AND r.side = 'r')
  SELECT vec_id, generate_subscripts(v, 1) - 1 AS dim, round(unnest(v), 6) AS x FROM o""")
def _(spark, sf):
    p = _packed(spark, sf).withColumn("v", rotations.pack_canonical(
        {"right": F.col("ra"), "left": F.col("la")}, {"right": F.col("rh"), "left": F.col("lh")}))
    return dims(p, ["vec_id"], "v")


# Round trip: decoding a packed row gives the command back (the rotation as an equal rotation).
@query("decode_canonical", f"""WITH {FRAMES_SQL}, a AS (SELECT vec_id, list_transform(state[1:6], lambda q: q * 300) ra, list_transform(action[1:6], lambda q: q * 1000) rh FROM frames),
  n AS (SELECT *, sqrt(ra[4]*ra[4] + ra[5]*ra[5] + ra[6]*ra[6]) AS t FROM a),
  w AS (SELECT *, t - 360 * round(t / 360) AS u FROM n)
  SELECT vec_id, round(ra[1], 4) AS x, round(ra[4] * u / t, 4) AS rx, round(ra[5] * u / t, 4) AS ry, round(ra[6] * u / t, 4) AS rz, round(rh[6], 4) AS h5 FROM w""")
def _(spark, sf):
    p = _packed(spark, sf).withColumn("v", rotations.pack_canonical(
        {"right": F.col("ra"), "left": F.col("la")}, {"right": F.col("rh"), "left": F.col("lh")}))
    d = rotations.decode_canonical(p, "v", ["right"])
    arm = F.col("right_arm")
    return d.select("vec_id", F.round(arm[0], 4).alias("x"), *[F.round(arm[i], 4).alias(n) for i, n in ((3, "rx"), (4, "ry"), (5, "rz"))],
                    F.round(F.col("right_hand")[5], 4).alias("h5"))


@query("letterbox_dims", """WITH s AS (SELECT p_partkey, (p_size * 13 + 40)::DOUBLE AS w, (p_partkey % 700 + 30)::DOUBLE AS h FROM part),
  d AS (SELECT *, greatest(round_even(w * (224.0::DOUBLE / greatest(w, h)), 0)::BIGINT, 1) AS new_w, greatest(round_even(h * (224.0::DOUBLE / greatest(w, h)), 0)::BIGINT, 1) AS new_h FROM s)
  SELECT p_partkey, new_w, new_h, (224 - new_w) // 2 AS pad_x, (224 - new_h) // 2 AS pad_y,
   floor(w / (greatest(w, h) / 224.0::DOUBLE))::BIGINT AS cut_w, floor(h / (greatest(w, h) / 224.0::DOUBLE))::BIGINT AS cut_h FROM d""")
def _(spark, sf):
    w, h = (F.col("p_size") * 13 + 40).cast("double"), (F.col("p_partkey") % 700 + 30).cast("double")
    a, b = vectors.letterbox_dims(w, h), vectors.letterbox_dims(w, h, truncate=True)
    return table(spark, sf, "part").select(
        "p_partkey", *[c.alias(n) for n, c in a.items()], b["new_w"].alias("cut_w"), b["new_h"].alias("cut_h"))


PARTS_SQL = """parts AS (SELECT unnest([0, 1, 2, 3, 4, 5, 7, 8, 9, 11, 12, 13, 15, 16, 18]) AS pad,
  unnest(['thumb', 'thumb', 'thumb', 'index', 'index', 'index', 'middle', 'middle', 'middle', 'ring', 'ring', 'ring', 'pinky', 'pinky', 'palm']) AS part)"""


@query("part_of_slot", f"WITH {TACTILE_SQL}, {PARTS_SQL} SELECT part, count(*) AS n, min(pad)::BIGINT AS first_pad FROM tactile JOIN parts USING (pad) GROUP BY 1")
def _(spark, sf):
    t = tactile(spark, sf).withColumn("part", layout.part_of_slot(F.col("pad")))
    return t.groupBy("part").agg(F.count("*").alias("n"), F.min("pad").cast("bigint").alias("first_pad"))


_BOX_ROWS = ", ".join(f"({s}, {b[0]}::DOUBLE, {b[1]}::DOUBLE, {b[2]}::DOUBLE, {b[3]}::DOUBLE)" for s, b in layout.BOXES.items())
BOXES_SQL = f"""boxes AS (SELECT pad, hand, CASE WHEN hand = 'left' THEN 1 - cx ELSE cx END AS cx, cy, bw, bh
  FROM (VALUES {_BOX_ROWS}) b(pad, cx, cy, bw, bh), (VALUES ('left'), ('right')) h(hand)),
bounds AS (SELECT pad, hand, greatest(0, round_even((cx - bw / 2) * 224, 0)::BIGINT) AS x0, least(224, round_even((cx + bw / 2) * 224, 0)::BIGINT) AS x1,
  greatest(0, round_even((cy - bh / 2) * 224, 0)::BIGINT) AS y0, least(224, round_even((cy + bh / 2) * 224, 0)::BIGINT) AS y1 FROM boxes)"""


@query("pad_layout", f"WITH {TACTILE_SQL}, {BOXES_SQL} SELECT recording_id, hand, pad::BIGINT AS pad, sample_idx, x0, x1, y0, y1 FROM tactile JOIN bounds USING (pad, hand)")
def _(spark, sf):
    b = layout.pad_layout(F.col("pad"), F.col("hand"))
    return tactile(spark, sf).select("recording_id", "hand", F.col("pad").cast("bigint").alias("pad"), "sample_idx",
                                     *[c.cast("bigint").alias(n) for n, c in b.items()])


@query("rasterize_lookup", f"""WITH {TACTILE_SQL}, {BOXES_SQL},
  g AS (SELECT recording_id, hand, pad, sample_idx, list_transform(force, lambda x: round_even((least(greatest(x * 4, -1), 8) + 1) * (255 / 9.0::DOUBLE), 0)::BIGINT) AS v FROM tactile),
  r AS (SELECT recording_id, hand, pad, sample_idx, CASE WHEN pad = 18 THEN [v[2], v[4], v[1], v[3]] ELSE v END AS v FROM g),
  p AS (SELECT r.*, x1 - x0 AS bw, y1 - y0 AS bh, unnest(range(0, (x1 - x0) * (y1 - y0))) AS i FROM r JOIN bounds USING (pad, hand)),
  q AS (SELECT *, v[least(floor((i // bw) * (1.0::DOUBLE / (bh / 2.0::DOUBLE))), 1)::INT * 2 + least(floor((i % bw) * (1.0::DOUBLE / (bw / 2.0::DOUBLE))), 1)::INT + 1] AS px FROM p)
  SELECT recording_id, hand, pad::BIGINT AS pad, sample_idx, count(*) AS n_px, md5(upper(string_agg(printf('%02x', px), '' ORDER BY i))) AS tile_md5 FROM q GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    t = tactile(spark, sf).withColumn("force", F.transform("force", lambda x: x * 4))
    return pad_tiles(t).select(
        "recording_id", "hand", F.col("pad").cast("bigint").alias("pad"), "sample_idx",
        F.octet_length("tile").cast("bigint").alias("n_px"), F.md5(F.hex("tile")).alias("tile_md5"))


_PLACES = ", ".join(f"({i}, {pad})" for i, pad in enumerate(layout.PADS))
_HAND_BOUNDS = "SELECT hand, pad, place, x0, x1, y0, y1, pad = 18 AS turned FROM bounds JOIN places USING (pad)"
_GRID_BOUNDS = "SELECT hand, pad, place, place % 4 * 56 AS x0, place % 4 * 56 + 56 AS x1, place // 4 * 56 AS y0, place // 4 * 56 + 56 AS y1, false AS turned FROM places, (VALUES ('left'), ('right')) h(hand)"


def canvas_sql(bounds):
    """Which cell lies under each pixel, the last pad on top; then each frame's values in that order."""
    return f"""WITH {TACTILE_SQL}, {BOXES_SQL}, places AS (SELECT * FROM (VALUES {_PLACES}) v(place, pad)), bx AS ({bounds}),
  px AS (SELECT unnest(range(0, 224 * 224)) AS i),
  cover AS (SELECT hand, i, arg_max(place * 4 + CASE WHEN turned THEN ([1, 3, 0, 2])[least(floor((i // 224 - y0) * (1.0::DOUBLE / ((y1 - y0) / 2.0::DOUBLE))), 1)::INT * 2 + least(floor((i % 224 - x0) * (1.0::DOUBLE / ((x1 - x0) / 2.0::DOUBLE))), 1)::INT + 1]
      ELSE least(floor((i // 224 - y0) * (1.0::DOUBLE / ((y1 - y0) / 2.0::DOUBLE))), 1)::INT * 2 + least(floor((i % 224 - x0) * (1.0::DOUBLE / ((x1 - x0) / 2.0::DOUBLE))), 1)::INT END + 1, place) AS j
    FROM px JOIN bx ON i // 224 >= y0 AND i // 224 < y1 AND i % 224 >= x0 AND i % 224 < x1 GROUP BY hand, i),
  map AS (SELECT hand, list(coalesce(j, 0) ORDER BY i) AS js FROM (SELECT hand, i FROM px, (VALUES ('left'), ('right')) h(hand)) LEFT JOIN cover USING (hand, i) GROUP BY hand),
  fr AS (SELECT recording_id, hand, sample_idx, list(printf('%02X', round_even((least(greatest(x * 4, -1), 8) + 1) * (255 / 9.0::DOUBLE), 0)::BIGINT) ORDER BY place, cell) AS v FROM cells JOIN places USING (pad) GROUP BY ALL)
  SELECT recording_id, hand, sample_idx, md5(array_to_string(list_transform(js, lambda j: CASE WHEN j = 0 THEN '00' ELSE v[j] END), '')) AS canvas_md5 FROM fr JOIN map USING (hand)"""


def canvas_query(name):
    def run(spark, sf):
        t = tactile(spark, sf).withColumn("force", F.transform("force", lambda x: x * 4))
        return frame_canvases(t, layout=name).select("recording_id", "hand", "sample_idx", F.md5(F.hex("canvas")).alias("canvas_md5"))
    return run


query("frame_canvas", canvas_sql(_HAND_BOUNDS))(canvas_query("hand"))
query("frame_canvas_grid", canvas_sql(_GRID_BOUNDS))(canvas_query("grid"))


@query("placeholder_targets", f"WITH {FRAMES_SQL} SELECT vec_id, round(CASE WHEN vec_id % 3 = 0 THEN 0 ELSE list_sum(state) END, 6) AS state_sum, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE len(list_filter(action, lambda v: v <> 0)) END::BIGINT AS targets FROM frames")
def _(spark, sf):
    """Every third row has no robot targets and gets placeholders; the others keep theirs."""
    blank = F.col("vec_id") % 3 == 0
    f = frames(spark, sf).withColumns({n: F.when(blank, zero).otherwise(F.col(n)) for n, zero in zip(("state", "action"), vectors.placeholder_targets(32))})
    return f.select("vec_id", F.round(F.aggregate("state", F.lit(0.0), lambda s, v: s + v), 6).alias("state_sum"), F.size(F.filter("action", lambda v: v != 0)).cast("bigint").alias("targets"))


@query("grid_pool", f"""WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
  c AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, v FROM x)
  SELECT vec_id, (a * 3 + b)::BIGINT AS dim, round(avg(v), 6) AS x FROM c, range(0, 3) p(a), range(0, 3) q(b)
  WHERE r >= floor(a * 8 / 3.0) AND r < ceil((a + 1) * 8 / 3.0) AND c >= floor(b * 8 / 3.0) AND c < ceil((b + 1) * 8 / 3.0) GROUP BY 1, 2""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return dims(e.withColumn("p", vectors.grid_pool(F.col("v"), F.lit(8), F.lit(8), 3)), ["vec_id"], "p")


@query("masked_view_mean", f"""WITH {FRAMES_SQL}, x AS (SELECT vec_id, generate_subscripts(state, 1) - 1 AS dim, unnest(state) s, unnest(action) a, vec_id % 3 <> 0 AS ms, vec_id % 4 <> 0 AS ma FROM frames)
  SELECT vec_id, dim, round((CASE WHEN ms THEN s ELSE 0 END + CASE WHEN ma THEN a ELSE 0 END) / greatest(ms::INT + ma::INT, 1), 6) AS x, ms OR ma AS valid FROM x""")
def _(spark, sf):
    mean, valid = vectors.masked_view_mean([F.col("state"), F.col("action")], [F.col("vec_id") % 3 != 0, F.col("vec_id") % 4 != 0])
    return dims(frames(spark, sf).withColumns({"m": mean, "valid": valid}), ["vec_id", "valid"], "m")


@query("mirror_box", f"WITH {TACTILE_SQL}, {BOXES_SQL} SELECT recording_id, hand, pad::BIGINT AS pad, sample_idx, round(cx, 6) AS cx, cy FROM tactile JOIN boxes USING (pad, hand)")
def _(spark, sf):
    box = layout.mirror_box(layout.box_of_slot(F.col("pad")), F.col("hand") == "left")
    return tactile(spark, sf).select("recording_id", "hand", F.col("pad").cast("bigint").alias("pad"), "sample_idx",
                                     F.round(box[0], 6).alias("cx"), box[1].alias("cy"))


_ORDER = "[0, 1, 2, 3, 4, 5, 7, 8, 9, 11, 12, 13, 15, 16, 18]"


@query("slots", f"WITH {TACTILE_SQL}, {PARTS_SQL} SELECT pad::BIGINT AS pad, part, list_position({_ORDER}, pad)::BIGINT - 1 AS place, count(*) AS n FROM tactile JOIN parts USING (pad) GROUP BY 1, 2, 3")
def _(spark, sf):
    t = tactile(spark, sf)
    return t.groupBy("pad").agg(F.count("*").alias("n")).select(
        F.col("pad").cast("bigint").alias("pad"), layout.part_of_slot(F.col("pad")).alias("part"), layout.row_order(F.col("pad")).cast("bigint").alias("place"), "n")
