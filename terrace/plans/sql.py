"""SQL fragments that state expected results for an engine other than Spark."""

from __future__ import annotations

from terrace import config as C
from terrace.config import THRESHOLDS as TH
from terrace.functions.measure import LOG_RANGE
from terrace.sources.tables import PTS_SQL, WIDE_SQL


def num(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def fd(x: str, c: str = "5e-2") -> str:
    m = f"(({x}) % {c})"
    d = f"((({x}) - {m}) / {c} - CASE WHEN {m} < 0 THEN 1e0 ELSE 0e0 END)"
    return f"(floor({d}) + CASE WHEN {d} - floor({d}) > 5e-1 THEN 1 ELSE 0 END)::BIGINT"


def d_aniso(x: str, y: str, v: str) -> str:
    return f"greatest(greatest({x}, 0e0) / least(greatest(1e0 + 1e0 * ({v} / 15e0), 1e0), 2e0), greatest(-({x}), 0e0) / 1e0, abs({y}) / (1e0 / (1e0 + 5e-1 * ({v} / 15e0))))"


def ring(x: str, y: str, v: str = "0e0") -> str:
    count = lambda d: " + ".join(f"({d} >= {r})::INT" for r in (10, 25, 50, 100))
    geo, an = count(f"greatest(abs({x}), abs({y}))"), count(d_aniso(x, y, v))
    return f"(CASE WHEN {geo} >= 4 THEN -1 ELSE least(CASE WHEN {x} < 0 AND abs({x}) < 50 AND {geo} <= 2 THEN least(greatest({an}, {geo}), 2) ELSE greatest({an}, {geo}) END, 3) END)"


K, SIZE, SIDE, OFFSET = "[1, 2, 4, 8][ring + 1]", "[5e-2, 1e-1, 2e-1, 4e-1][ring + 1]", "[400, 500, 500, 500][ring + 1]", "[0, 160000, 410000, 660000][ring + 1]"
R = "sqrt(x * x + y * y + z * z)"


def variance(r: str = "r") -> str:
    q = f"({num(TH.sensor_height_m)} / greatest({r}, 1e-3))"
    return f"(({q} * {q} * {num(TH.sigma_r_m * TH.sigma_r_m)} + greatest({r}, 1e-3) * greatest({r}, 1e-3) * {num(TH.sigma_phi_rad * TH.sigma_phi_rad)}) * 1e4)"


def weight(v: str) -> str:
    return f"least(greatest(round_even(1024e0 / greatest({v}, 1e-9), 0), 1e0), 1048576e0)::INT"


def height(z: str) -> str:
    return f"least(greatest(round_even({z} * 1e2, 0), -200e0), 600e0)::INT"


def decode(code: str) -> str:
    return f"(640000e0 * exp({code}::DOUBLE * {num(-LOG_RANGE)} / 255e0))"


def encode(v: str) -> str:
    return f"least(greatest(floor(ln(640000e0 / greatest({v}, 1e-12)) * 255e0 / {num(LOG_RANGE)}), 0), 255)::INT"


def mean(wz: str, w: str) -> str:
    return f"(sign({wz}) * ((2 * abs({wz}) + greatest({w}, 1)) // (2 * greatest({w}, 1))))::INT"


def occupancy() -> str:
    return f"(CASE WHEN flags & {C.FLAG_BLIND} <> 0 OR obs_count < 1 THEN 0 WHEN log_odds > 0 THEN 2 ELSE 1 END)"


#: b: binned and measured returns; a: aggregates of frames and cells of static returns; st: folded state.
BINNED = f"""{PTS_SQL}, b0 AS (SELECT *, {ring("x", "y")} AS ring, {R} AS r FROM pts), b AS (SELECT *, floor({fd("x")} / {K})::BIGINT AS ix, floor({fd("y")} / {K})::BIGINT AS iy,
  {height("z")} AS z_cm, {weight(variance())} AS w_q, least(greatest(round_even(intensity * 255e0, 0), 0e0), 255e0)::INT AS refl FROM b0 WHERE ring >= 0)"""
AGG = """SELECT frame, ring, ix, iy, coalesce(sum(CASE WHEN ground THEN w_q::BIGINT * z_cm END), 0)::BIGINT AS wz_sum, coalesce(sum(CASE WHEN ground THEN w_q END), 0)::BIGINT AS w_sum,
  count(*)::BIGINT AS n, coalesce(min(CASE WHEN NOT ground THEN z_cm END), 32767)::INT AS ceiling_cm, sum(refl)::BIGINT AS refl_sum, (min({'p': point_id, 'c': cls})).c::INT AS class_id"""
STATIC = f"{BINNED}, a AS ({AGG} FROM b WHERE NOT moving GROUP BY frame, ring, ix, iy)"
_G, _Z, _N = f"({decode('s.var_code')} + {num(TH.process_noise_cm2)})", f"{mean('o.wz_sum', 'o.w_sum')}::DOUBLE", "(1024e0 / greatest(o.w_sum::DOUBLE, 1e0))"
_VOTE = "(CASE WHEN s.class_byte & 7 = 0 THEN (o.class_id << 3) | 1 WHEN s.class_byte >> 3 = o.class_id THEN (s.class_byte & 248) | least((s.class_byte & 7) + 1, 7) ELSE (s.class_byte & 248) | ((s.class_byte & 7) - 1) END)"
#: State s after aggregate o of one frame.
FUSED = {
    "ground_cm": f"round_even(CASE WHEN o.w_sum <= 0 THEN s.ground_cm::DOUBLE WHEN s.obs_count = 0 THEN {_Z} ELSE s.ground_cm::DOUBLE + {_G} / ({_G} + {_N}) * ({_Z} - s.ground_cm::DOUBLE) END, 0)::INT",
    "ceiling_cm": "least(s.ceiling_cm, o.ceiling_cm)::INT",
    "var_code": encode(f"CASE WHEN o.w_sum <= 0 THEN {_G} WHEN s.obs_count = 0 THEN {_N} ELSE (1e0 - {_G} / ({_G} + {_N})) * {_G} END"),
    "log_odds": "greatest(least(s.log_odds + 4, 63), -64)::INT",
    "class_byte": f"{_VOTE}::INT",
    "reflectivity": "least(o.refl_sum // o.n, 255)::INT",
    "obs_count": "least(s.obs_count + o.n, 255)::INT",
    "last_frame": "o.frame",
}
EMPTY = {"ground_cm": 0, "ceiling_cm": 32767, "var_code": 0, "log_odds": 0, "class_byte": 0, "reflectivity": 0, "obs_count": 0, "last_frame": -1}
FOLDED = f"""RECURSIVE {STATIC}, o AS (SELECT *, row_number() OVER (PARTITION BY ring, ix, iy ORDER BY frame) AS rn FROM a),
rec AS (SELECT DISTINCT ring, ix, iy, 0::BIGINT AS rn, {", ".join(f"{v} AS {k}" for k, v in EMPTY.items())} FROM o
  UNION ALL SELECT s.ring, s.ix, s.iy, o.rn, {", ".join(FUSED.values())}
  FROM rec s JOIN o ON s.ring = o.ring AND s.ix = o.ix AND s.iy = o.iy AND o.rn = s.rn + 1),
st AS (SELECT * EXCLUDE (rn), 0 AS flags, 0 AS frames_since_seen FROM rec QUALIFY row_number() OVER (PARTITION BY ring, ix, iy ORDER BY rn DESC) = 1)"""
WIDE_BINNED = f"{WIDE_SQL}, wr AS (SELECT *, {ring('x', 'y', 'speed')} AS ring FROM wide), wb AS (SELECT *, floor({fd('xw')} / {K})::BIGINT AS ix, floor({fd('yw')} / {K})::BIGINT AS iy FROM wr WHERE ring >= 0)"
#: Patches of ring 1 with a kerb, a pothole and noise from the data.
RASTER = """ras AS (SELECT 1 AS ring, i + 64 * (patch % 7) - 224 AS ix, j + 64 * (patch // 7) - 224 AS iy, (max(price % 3) + CASE WHEN i >= 40 THEN 12 ELSE 0 END
    - CASE WHEN (i - 20) * (i - 20) + (j - 42) * (j - 42) <= 5 THEN 40 ELSE 0 END + CASE WHEN j < 8 THEN (8 - j) * 20 ELSE 0 END)::INT AS ground_cm,
  (CASE WHEN max(price % 11) = 10 AND i % 8 = 0 THEN 150 ELSE 32767 END)::INT AS ceiling_cm, least(count(*) * 3 + 150, 255)::INT AS var_code, (count(*) % 5)::INT AS log_odds,
  ((CASE WHEN (i + j) % 13 = 0 THEN 14 ELSE 8 END) * 8 + least(count(*), 7))::INT AS class_byte, 0 AS reflectivity, least(count(*), 255)::INT AS obs_count, 0 AS frames_since_seen, 0 AS flags, 6 AS last_frame
  FROM (SELECT key % 64 AS i, (key // 64) % 64 AS j, (key // 4096) % 49 AS patch, price FROM (SELECT (l_orderkey * 7 + l_partkey * 13 + l_linenumber * 31 + l_suppkey)::BIGINT AS key, round(l_extendedprice * 100)::BIGINT AS price FROM lineitem)) GROUP BY i, j, patch)"""


def neighbours(table: str, k: int, clip: tuple[int, int] | None, value: str = "ground_cm", names: str = "ewns") -> str:
    """Left joins of four neighbours at distance k, clipped to the window, aliased by name."""
    up = lambda i: f"least(t.{i} + {k}, {clip[1]})" if clip else f"t.{i} + {k}"
    down = lambda i: f"greatest(t.{i} - {k}, {clip[0]})" if clip else f"t.{i} - {k}"
    at = {"e": (up("ix"), "t.iy"), "w": (down("ix"), "t.iy"), "n": ("t.ix", up("iy")), "s": ("t.ix", down("iy"))}
    return " ".join(f"LEFT JOIN {table} {n} ON {n}.ring = t.ring AND {n}.ix = {at[n][0]} AND {n}.iy = {at[n][1]}" for n in names)


#: trav of the raster (ring 1: baseline 2 cells, window -250 to 249), and slopes.
SLOPES = f"""sl AS (SELECT t.*, (coalesce(e.ground_cm, 0) - coalesce(w.ground_cm, 0)) / ((least(t.ix + 2, 249) - greatest(t.ix - 2, -250)) * 1e-1 * 1e2) AS dzdx,
  (coalesce(n.ground_cm, 0) - coalesce(s.ground_cm, 0)) / ((least(t.iy + 2, 249) - greatest(t.iy - 2, -250)) * 1e-1 * 1e2) AS dzdy,
  greatest(abs(coalesce(e.ground_cm, 0) - t.ground_cm), abs(coalesce(w.ground_cm, 0) - t.ground_cm), abs(coalesce(n.ground_cm, 0) - t.ground_cm), abs(coalesce(s.ground_cm, 0) - t.ground_cm)) AS step_cm,
  t.obs_count >= 1 AND e.ring IS NOT NULL AND w.ring IS NOT NULL AND n.ring IS NOT NULL AND s.ring IS NOT NULL AS all_seen
  FROM ras t {neighbours("ras", 2, (-250, 249))})"""
TRAV = f"""tr AS (SELECT * EXCLUDE (dzdx, dzdy, step_cm, all_seen), ((CASE WHEN ceiling_cm - ground_cm < 180 THEN 1 ELSE 0 END) + (CASE WHEN all_seen AND sqrt(dzdx * dzdx + dzdy * dzdy) > {num(TH.tan_slope)} THEN 2 ELSE 0 END)
  + (CASE WHEN all_seen AND step_cm > 15 THEN 4 ELSE 0 END) + (CASE WHEN {decode("var_code")} > 25e0 THEN 8 ELSE 0 END) + (CASE WHEN (class_byte >> 3) IN (8, 9, 10, 11, 16) THEN 0 ELSE 16 END)
  + (CASE WHEN obs_count < 3 OR ix < -249 OR ix > 248 OR iy < -249 OR iy > 248 THEN 32 ELSE 0 END))::INT AS trav FROM sl)"""
RASTER_TRAV = f"{RASTER}, {SLOPES}, {TRAV}"
MSTAR = """ms AS (SELECT i, j, sum(um)::BIGINT / sum(c)::BIGINT / 1e4 AS height_cm, sum(c)::BIGINT AS count, coalesce((min(CASE WHEN raw <> 0 THEN {'f': frame, 'r': raw} END)).r, 0) AS class_id
  FROM (SELECT floor(x / 5e-2)::BIGINT AS i, floor(y / 5e-2)::BIGINT AS j, frame, sum(round_even(z * 1e6, 0)::BIGINT)::BIGINT AS um, count(*) AS c, (max({'p': point_id, 'r': raw_label & 255})).r AS raw
    FROM pts WHERE NOT moving AND ground GROUP BY ALL) GROUP BY i, j)"""
BLOCKS = """bl AS (SELECT ring, floor(i / k)::BIGINT AS ix, floor(j / k)::BIGINT AS iy, count(*)::BIGINT AS n_ref, avg(height_cm) AS ref_mean, var_pop(height_cm) AS ref_var
  FROM ms, (VALUES (0, 1), (1, 2), (2, 4), (3, 8)) v(ring, k) GROUP BY ALL)"""


def served(table: str) -> str:
    return f"(SELECT * FROM (SELECT *, (ix + 5e-1) * {SIZE} AS cx, (iy + 5e-1) * {SIZE} AS cy FROM {table}) WHERE {ring('cx', 'cy')} = ring)"


PIX = f"((floor((atan2(y, x) + pi()) / {num(2 * 3.141592653589793 / 512)})::BIGINT % 512 + 512) % 512)::INT"


def elevation(z: str, r: str) -> str:
    import math

    step = math.radians(TH.phi_max_deg - TH.phi_min_deg) / TH.rings
    return f"floor(({num(math.radians(TH.phi_max_deg))} - asin(least(greatest({z} / greatest({r}, 1e-9), -1e0), 1e0))) / {num(step)})::INT"


IMAGE = f"""px AS (SELECT *, {elevation("z", "r")} AS v_raw, {PIX} AS u FROM (SELECT *, {R} AS r FROM pts)),
img AS (SELECT frame, least(greatest(v_raw, 0), 63) AS v, u, min({{'r': r, 'point_id': point_id, 'x': x, 'y': y, 'z': z, 'intensity': intensity, 'moving': moving}}) AS p FROM px WHERE r > 1e-6 GROUP BY ALL),
im AS (SELECT frame, v, u, p.r AS r, p.point_id AS point_id, p.x AS x, p.y AS y, p.z AS z, p.intensity AS intensity, p.moving AS moving FROM img)"""


def clear_tolerance(r: str) -> str:
    q = f"({num(TH.sensor_height_m)} / greatest({r}, 1e-3))"
    return f"greatest(3e0 * sqrt({r} * {r} * {num(TH.sigma_phi_rad**2)} + {q} * {q} * {num(TH.sigma_r_m**2)}), {num(TH.clear_floor_m)})"


#: The drive of the live map: frame, x and z of the vehicle in seven frames.
DRIVE = tuple((k, 2.0 * k, 0.6 * k) for k in range(7))


def live(cleanup: bool = True, name: str = "s") -> str:
    """CTEs of the live map over wide returns: lb (returns within the windows), la (aggregates), im (images), and name0 to name6, the state after each frame; with cleanup q0 to q6, its tests."""
    import math

    per_frame = lambda values: f"[{', '.join(map(num, values))}][frame + 1]"
    ego, datum = per_frame(x for _, x, _ in DRIVE), per_frame(math.floor(z) for _, _, z in DRIVE)
    out = [] if name != "s" else [
        f"{WIDE_SQL}, pts AS (SELECT * FROM wide)", IMAGE,
        f"""lr AS (SELECT *, z + {per_frame(z for _, _, z in DRIVE)} AS zw, {ring('x', 'y')} AS ring, {R} AS r FROM wide WHERE greatest(abs(x), abs(y)) < 100)""",
        f"""lb AS MATERIALIZED (SELECT *, least(greatest(round_even(zw * 1e2 - {datum} * 1e2, 0), -200e0), 600e0)::INT AS z_cm, {weight(variance())} AS w_q, least(greatest(round_even(intensity * 255e0, 0), 0e0), 255e0)::INT AS refl
  FROM (SELECT *, floor({fd('xw')} / {K})::BIGINT AS ix, floor({fd('yw')} / {K})::BIGINT AS iy FROM lr)
  WHERE ix >= floor({ego} / {SIZE})::BIGINT - {SIDE} // 2 AND ix < floor({ego} / {SIZE})::BIGINT - {SIDE} // 2 + {SIDE} AND iy >= -({SIDE} // 2) AND iy < {SIDE} - {SIDE} // 2)""",
        f"la AS MATERIALIZED ({AGG} FROM lb GROUP BY frame, ring, ix, iy)",
    ]
    columns = ", ".join(EMPTY)
    for k, x, z in DRIVE:
        move = round((math.floor(DRIVE[k - 1][2]) - math.floor(z)) * 100) if k else 0
        band = lambda c: f"greatest(least({c} + {move}, 600), -200)::INT" if move else c  # noqa: B023, E731
        before = f"SELECT ring, ix, iy, {columns} FROM {name}{k - 1}" if k else f"SELECT ring, ix, iy, {', '.join(f'{v} AS {c}' for c, v in EMPTY.items())} FROM la WHERE false"
        followed = {"ground_cm": band("ground_cm"), "ceiling_cm": f"CASE WHEN ceiling_cm = 32767 THEN 32767 ELSE {band('ceiling_cm')} END"}
        low = f"floor({num(x)} / {SIZE})::BIGINT - {SIDE} // 2"
        out.append(f"""{name}k{k} AS (SELECT ring, ix, iy, {', '.join(f'{followed.get(c, c)} AS {c}' for c in EMPTY)} FROM ({before})
  WHERE ix >= {low} AND ix < {low} + {SIDE} AND iy >= -({SIDE} // 2) AND iy < {SIDE} - {SIDE} // 2)""")
        both = f"SELECT coalesce(k.ring, o.ring) AS ring, coalesce(k.ix, o.ix) AS ix, coalesce(k.iy, o.iy) AS iy, {', '.join(f'coalesce(k.{c}, {v}) AS {c}' for c, v in EMPTY.items())} FROM {name}k{k} k FULL JOIN (SELECT * FROM la WHERE frame = {k}) o ON k.ring = o.ring AND k.ix = o.ix AND k.iy = o.iy"
        fused = ", ".join(f"CASE WHEN o.ring IS NULL THEN s.{c} ELSE {FUSED[c]} END AS {c}" for c in EMPTY)
        out.append(f"{name}f{k} AS MATERIALIZED (SELECT s.ring, s.ix, s.iy, {fused} FROM ({both}) s LEFT JOIN la o ON o.frame = {k} AND s.ring = o.ring AND s.ix = o.ix AND s.iy = o.iy)")
        if not cleanup:
            out.append(f"{name}{k} AS (SELECT * FROM {name}f{k})")
            continue
        out.append(f"""q{k} AS MATERIALIZED (SELECT c.ring, c.ix, c.iy, in_view, in_view AND far AND last_frame <> {k} AS through, in_view AND far AND last_frame = {k} AS protected FROM (
  SELECT t.*, t.v >= 0 AND t.v < 64 AND cr > 1e-6 AS in_view, coalesce(im.r > cr + {clear_tolerance("cr")}, false) AS far FROM (SELECT *, {PIX} AS u, {elevation("z", "cr")} AS v FROM (SELECT *, {R} AS cr FROM (
    SELECT ring, ix, iy, last_frame, (ix + 5e-1) * {SIZE} - {num(x)} AS x, (iy + 5e-1) * {SIZE} - 0e0 AS y, (CASE WHEN ceiling_cm <> 32767 THEN ceiling_cm ELSE ground_cm END) / 1e2 + {num(math.floor(z) - z)} - {num(TH.sensor_height_m)} AS z
    FROM {name}f{k} WHERE obs_count >= 1 AND log_odds > 0))) t LEFT JOIN im ON im.frame = {k} AND im.v = t.v AND im.u = t.u) c)""")
        out.append(f"{name}{k} AS MATERIALIZED (SELECT f.* REPLACE ((CASE WHEN q.through THEN greatest(least(f.log_odds - 2, 63), -64) ELSE f.log_odds END)::INT AS log_odds) FROM {name}f{k} f LEFT JOIN q{k} q USING (ring, ix, iy))")
    return ", ".join(out)


#: Images of patches: moving pixels close enough together for components.
PATCHY = """pi AS (SELECT (l_linenumber - 1)::INT AS frame, ((l_orderkey * 7 + l_partkey) % 64)::INT AS v, ((l_partkey * 31 + l_suppkey * 7 + l_orderkey) % 512)::INT AS u, min(10 + (l_quantity::INT % 5) * 25e-2) AS r FROM lineitem GROUP BY ALL)"""
