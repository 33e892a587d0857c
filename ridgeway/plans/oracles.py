"""DuckDB SQL for the registered terrain queries, written against the tables alone."""

from __future__ import annotations

import math

R = "6378137e0"
O = f"{math.pi * 6378137.0!r}e0"
ER = "6371000e0"
RES14 = f"{2 * math.pi * 6378137.0 / 256.0 / 2.0**14!r}e0"
SPAN = f"{32768 * 2 * math.pi * 6378137.0 / 256.0 / 2.0**14!r}e0"
DEPTH = f"{math.log(40000.0)!r}e0"


def pmod(a: str, m: str) -> str:
    return f"((({a}) % {m}) + {m}) % {m}"


def tri(n: str, p: int) -> str:
    return f"abs({pmod(n, str(2 * p))} - {p})"


def code(x: str, y: str) -> str:
    return f"(7000 + 2 * {tri(f'3 * {x} + {y}', 2700)} + 3 * {tri(f'{x} - 2 * {y}', 1100)} + 4 * {tri(f'{x} + 5 * {y}', 257)})"


def mx(lon: str) -> str:
    return f"({lon} / 180e0 * {O})"


def my(lat: str) -> str:
    return f"(ln(tan({math.pi / 4!r}e0 + radians({lat}) / 2e0)) * {R})"


def px(x: str, res: str = RES14) -> str:
    return f"CAST(floor(round(({x} + {O}) / {res}, 6)) AS BIGINT)"


def py(y: str, res: str = RES14) -> str:
    return f"CAST(floor(round(({O} - {y}) / {res}, 6)) AS BIGINT)"


def ground(z: str, lat: str) -> str:
    return f"({2 * math.pi * 6378137.0 / 256.0!r}e0 / pow(2e0, {z}) * cos(radians({lat})))"


def drop(d: str) -> str:
    return f"({d} * {d} * 0.87e0 / 12742000e0)"


def gc(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"(12742000e0 * asin(sqrt(least(pow(sin(radians({lat2} - {lat1}) / 2e0), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2e0), 2), 1e0))))"


def bearing(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    a = f"degrees(atan2(sin(radians({lon2} - {lon1})) * cos(radians({lat2})), cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2} - {lon1}))))"
    return pmod(a, "360e0")


def dest(lon: str, lat: str, az: str, d: str) -> tuple[str, str]:
    s2 = f"(sin(radians({lat})) * cos({d} / {ER}) + cos(radians({lat})) * sin({d} / {ER}) * cos(radians({az})))"
    return f"({lon} + degrees(atan2(sin(radians({az})) * sin({d} / {ER}) * cos(radians({lat})), cos({d} / {ER}) - sin(radians({lat})) * {s2})))", f"degrees(asin({s2}))"


def share(d: str) -> str:
    return f"greatest(0e0, least(1e0, ln(greatest({d}, 10e0) / 10e0) / {DEPTH}))"


def bin_(d: str) -> str:
    return f"CAST(floor({share(d)} * 255e0) AS INT)"


def enc(d: str) -> str:
    return f"CASE WHEN {d} IS NULL THEN 0 ELSE 1 + CAST(round({share(d)} * 65534e0) AS INT) END"


def level(d: str, lat: str) -> str:
    whens = " ".join(f"WHEN {ground(str(z), lat)} <= {d} * 0.00087e0 THEN {z}" for z in range(8, 14))
    return f"(CASE {whens} ELSE 14 END)"


VIEWS = "views AS (SELECT s_suppkey AS view, 20e0 + (s_suppkey % 20) * 0.001e0 AS lon, 49e0 + ((s_suppkey // 20) % 20) * 0.001e0 AS lat FROM supplier)"
EYES = f"{VIEWS}, eyes AS (SELECT *, {code(px(mx('lon')), py(my('lat')))} * 0.1e0 - 500e0 + 1.7e0 AS eye FROM views)"
PEAKS = f"peaks AS (SELECT p_partkey AS osm_id, 20e0 + ({pmod('p_partkey * 7919', '6000')}) / 100000e0 AS plon, 49e0 + ({pmod('p_partkey * 104729', '4000')}) / 100000e0 AS plat FROM part)"
LON, LAT = dest("lon", "lat", "azimuth", "d")


def march(rays: int, azimuth: str, steps: str) -> str:
    """Samples of all views: (view, lon, lat, eye, ray, azimuth, d, sx, sy, h, tangent, alpha)."""
    return f"""{EYES},
rays AS (SELECT e.*, CAST(r.ray AS INT) AS ray, {azimuth} AS azimuth, {ground('14', 'lat')} AS step FROM eyes e, range({rays}) r(ray)),
steps AS (SELECT *, step + k * step AS d FROM (SELECT *, unnest(range(CAST({steps} AS BIGINT))) AS k FROM rays)),
placed AS (SELECT *, {mx(LON)} AS sx, {my(LAT)} AS sy FROM steps),
high AS (SELECT *, {code(px('sx'), py('sy'))} * 0.1e0 - 500e0 AS h FROM placed),
angled AS (SELECT *, round((h - eye - {drop('d')}) / d, 12) AS tangent FROM high),
samples AS (SELECT *, round(degrees(atan(tangent)), 9) AS alpha FROM angled)"""


MARCH = march(24, "0e0 + (ray + 0.5e0) * 15e0", "ceil(round((1200e0 - step) / step, 9))")
BEFORE = "OVER (PARTITION BY view, ray ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
KEPT = f"""{MARCH},
rowed AS (SELECT *, greatest(0e0, round((20e0 - alpha) / 1e0, 9)) AS f FROM samples),
stopped AS (SELECT *, min(CASE WHEN f < 1 THEN d END) OVER (PARTITION BY view, ray) AS stop FROM rowed),
kept AS MATERIALIZED (SELECT * FROM stopped WHERE stop IS NULL OR d <= stop)"""
FILL = f"""{KEPT},
bounds AS (SELECT *, CAST(least(40, coalesce(min(floor(f)) {BEFORE}, 40)) AS INT) AS prev FROM kept),
fillers AS (SELECT *, coalesce(lag(d) OVER (PARTITION BY view, ray ORDER BY d), step) AS lv FROM bounds WHERE floor(f) < prev),
written AS (SELECT *, CAST(unnest(range(CAST(floor(f) AS BIGINT), CAST(prev AS BIGINT))) AS INT) AS row_ FROM fillers),
cells AS MATERIALIZED (SELECT view, ray, row_ AS row, CASE WHEN row_ < f THEN d WHEN d <= lv * 1.05e0 THEN d + (lv - d) * (row_ - ceil(f)) / greatest(prev - ceil(f), 1) ELSE d END AS dist,
  CAST(CASE WHEN row_ < f THEN row_ + 1 - f ELSE 1e0 END AS FLOAT) AS cover FROM written)"""
PROFILE = f"{KEPT}, profile AS (SELECT view, ray AS col, {bin_('d')} AS bin, max(CAST(h AS FLOAT)) AS max_h FROM kept GROUP BY ALL)"
SHED = march(math.ceil(2 * math.pi * 400 / 20), f"360e0 * ray / {math.ceil(2 * math.pi * 400 / 20)}", "floor(round((400e0 - step) / step, 9)) + 1")
TURN = "abs(atan((h - h0) / (d - d0)) - atan(tangent))"
SHED_CELLS = f"""{SHED},
seen AS (SELECT *, max(tangent) {BEFORE} AS horizon, lag(d) OVER (PARTITION BY view, ray ORDER BY d) AS d0, lag(h) OVER (PARTITION BY view, ray ORDER BY d) AS h0, 20e0 / cos(radians(lat)) AS proj FROM samples),
hit AS (SELECT view, CAST(floor(round((sx - ({mx('lon')} - proj * 20e0)) / proj, 6)) AS INT) AS ix, CAST(floor(round(({my('lat')} + proj * 20e0 - sy) / proj, 6)) AS INT) AS iy,
  CASE WHEN d0 IS NULL THEN 255 ELSE CAST(round(round(greatest(0e0, least(1e0, sin(least({TURN}, {math.pi!r}e0 - {TURN})))) * 254e0, 7)) AS INT) + 1 END AS a
  FROM seen WHERE horizon IS NULL OR round((h + 2e0 - eye - {drop('d')}) / d, 12) > horizon),
shed AS (SELECT view, ix, iy, max(a) AS alpha FROM hit WHERE ix BETWEEN 0 AND 39 AND iy BETWEEN 0 AND 39 GROUP BY ALL)"""
PAIRS = f"""pairs AS (SELECT * FROM (SELECT v.*, p.*, round({gc('lon', 'lat', 'plon', 'plat')}, 6) AS distance, round({bearing('lon', 'lat', 'plon', 'plat')}, 6) AS azimuth
  FROM {{}} v JOIN peaks p ON abs(plat - lat) <= 800e0 / 111320e0 AND abs(plon - lon) <= 800e0 / 111320e0 / greatest(cos(radians(lat)), 0.05e0)) WHERE distance <= 800e0)"""
RISE = f"(ele - eye - {drop('distance')})"
SHOWN = f"""{PEAKS}, {PAIRS.format('eyes')},
raised AS (SELECT *, {code(px(mx('plon')), py(my('plat')))} * 0.1e0 - 500e0 AS ele, {pmod('azimuth - 0e0', '360e0')} AS off_ FROM pairs),
shown AS (SELECT *, round(degrees(CASE WHEN distance > 0 THEN atan({RISE} / distance) ELSE sign({RISE}) * {math.pi / 2!r}e0 END), 9) AS altitude, off_ / 15e0 AS x, CAST(floor(round(off_ / 15e0, 6)) AS INT) AS col_ FROM raised),
projected AS (SELECT *, (20e0 - altitude) / 15e0 AS y, CASE WHEN col_ BETWEEN 0 AND 23 THEN col_ END AS "column" FROM shown)"""
SLOTS = f"""slots AS (SELECT *, round(x, 6) - 0.5e0 - floor(round(x, 6) - 0.5e0) AS t, unnest([0, 1]) AS slot FROM projected WHERE "column" IS NOT NULL),
bracketed AS (SELECT *, CAST({pmod('CAST(floor(round(x, 6) - 0.5e0) AS INT) + slot', '24')} AS INT) AS pray FROM slots)"""
SEEN = f"""{PROFILE}, {SHOWN}, {SLOTS},
answers AS (SELECT b.view, b.osm_id, b.slot, any_value(b.altitude) AS altitude, any_value(b.t) AS t, max(k.alpha) AS answer FROM bracketed b LEFT JOIN kept k ON k.view = b.view AND k.ray = b.pray AND k.d + k.step < b.distance GROUP BY b.view, b.osm_id, b.slot),
sides AS (SELECT view, osm_id, max(altitude) AS altitude, max(t) AS t, max(answer) FILTER (WHERE slot = 0) AS h0, max(answer) FILTER (WHERE slot = 1) AS h1 FROM answers GROUP BY view, osm_id),
decided AS (SELECT view, osm_id, coalesce(altitude >= CASE WHEN h0 IS NOT NULL AND h1 IS NOT NULL THEN round(h0 + (h1 - h0) * t, 9) ELSE coalesce(h0, h1) END, true) AS visible FROM sides)"""
DOMINANT = f"""{SEEN},
near AS (SELECT p.*, CAST(round(greatest(1e0, least(20e0, CASE WHEN distance > 0 THEN degrees(atan(3000e0 / distance)) ELSE 90e0 END)) / 15e0) AS INT) AS win,
  {bin_('greatest(distance - 3000e0, distance * 0.5e0)')} AS lo, {bin_('least(distance + 3000e0, distance * 2e0)')} AS hi FROM projected p JOIN decided d USING (view, osm_id) WHERE d.visible),
walk AS (SELECT *, CAST("column" + dir * k AS INT) AS c FROM (SELECT *, unnest([-1, 1]) AS dir FROM (SELECT *, unnest(range(1, win + 1)) AS k FROM near))),
met AS (SELECT w.view, w.osm_id, w.ele, w.dir, w.k, CAST(max(max_h) AS DOUBLE) AS s FROM walk w JOIN profile f ON f.view = w.view AND f.col = w.c AND f.bin BETWEEN w.lo AND w.hi GROUP BY ALL),
open_ AS (SELECT *, max(CAST(s > ele AS INT)) OVER (PARTITION BY view, osm_id, dir ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over_ FROM met),
lows AS (SELECT view, osm_id, ele, dir, min(s) AS low FROM open_ WHERE coalesce(over_, 0) = 0 GROUP BY ALL),
dom AS (SELECT view, osm_id, max(ele) - max(low) AS dominance FROM lows GROUP BY view, osm_id),
ranked AS (SELECT n.view, n.osm_id, n.y, round(coalesce(dominance, 0e0), 3) AS dominance FROM near n LEFT JOIN dom USING (view, osm_id))"""


def sky(alt: str) -> list[str]:
    t = f"greatest(0e0, least(1e0, ({alt}) / 30e0))"
    return [f"({a}e0 + ({b}e0 - {a}e0) * {t})" for a, b in ((196, 110), (216, 156), (238, 214))]


FULL = f"""{FILL},
frame AS (SELECT view, CAST(ray AS INT) AS ray, CAST(row AS INT) AS row FROM views, range(24) a(ray), range(40) b(row)),
complete AS (SELECT f.view, f.ray, f.row, c.dist, CAST(coalesce(c.cover, 0) AS DOUBLE) AS cover FROM frame f LEFT JOIN cells c USING (view, ray, row)),
logs AS (SELECT *, ln(dist) AS here, ln(lag(dist) OVER w) AS above, ln(lead(dist) OVER w) AS below, lag(dist) OVER w AS back FROM complete WINDOW w AS (PARTITION BY view, ray ORDER BY row)),
edges AS MATERIALIZED (SELECT *, CASE WHEN dist IS NULL THEN 0e0 WHEN row = 0 OR above IS NULL THEN 1e0 WHEN above - here <= 0 THEN 0e0
  ELSE greatest(0e0, least(1e0, (above - here - greatest(0e0, coalesce(here - below, 0e0))) / {math.log(1.15)!r}e0)) * sqrt(greatest(0e0, least(1e0, dist * (exp(above - here) - 1e0) / 500e0))) END AS edge FROM logs)"""
INK = f"""{FULL},
strokes AS (SELECT view, ray, edge * (1 - (0.45e0 + 0.4e0 * (1 - exp(-dist / 45000e0)))) AS amount, row + (1 - cover) - 0.5e0 AS lo, row + (1 - cover) + 0.5e0 AS hi FROM edges WHERE edge > 0),
drops AS (SELECT view, ray, amount, lo, hi, unnest(range(CAST(greatest(0, floor(lo)) AS BIGINT), CAST(least(ceil(hi), 40) AS BIGINT))) AS y FROM strokes),
inks AS MATERIALIZED (SELECT view, ray, CAST(y AS INT) AS row, sum(amount * (least(hi, y + 1e0) - greatest(lo, CAST(y AS DOUBLE)))) AS ink FROM drops WHERE least(hi, y + 1e0) - greatest(lo, CAST(y AS DOUBLE)) > 0 GROUP BY ALL)"""


def _shades() -> str:
    alt, up = "20e0 - (row + 0.5e0) * 1e0", "20e0 - (row - 1 + 0.5e0) * 1e0"
    out = []
    for c, base, s, b in zip("rgb", (58, 74, 52), sky(alt), sky(up)):
        front = f"(CASE WHEN dist IS NULL THEN {s} ELSE {base}e0 + ({s} - {base}e0) * (1 - exp(-dist / 45000e0)) END)"
        back = f"(CASE WHEN row = 0 THEN {s} WHEN back IS NULL THEN {b} ELSE {base}e0 + ({b} - {base}e0) * (1 - exp(-back / 45000e0)) END)"
        mixed = f"(CASE WHEN dist IS NOT NULL AND cover < 0.999e0 THEN {back} + ({front} - {back}) * cover ELSE {front} END)"
        inked = f"({mixed} * (1 - greatest(0e0, least(1e0, coalesce(ink, 0e0)))))"
        out.append(f"CASE WHEN abs({alt}) < 0.5e0 THEN {inked} * 0.75e0 + 60e0 ELSE {inked} END AS {c}")
    return f"{INK}, shaded AS (SELECT view, ray, row, {', '.join(out)} FROM edges LEFT JOIN inks USING (view, ray, row))"


SHADED = _shades()
DEPTH_IMG = f"""{FILL},
mins AS (SELECT view, ray // 2 AS col, row // 2 AS row, min(dist) AS dist FROM cells GROUP BY ALL),
grid AS (SELECT view, CAST(a.col AS INT) AS col, CAST(b.row AS INT) AS row FROM views, range(12) a(col), range(20) b(row)),
codes AS (SELECT view, col, row, {enc('dist')} AS code FROM grid LEFT JOIN mins USING (view, col, row))"""
BOXES = "boxes AS (SELECT s_suppkey AS id, -25e0 + s_suppkey % 60 AS lon0, 30e0 + s_suppkey % 37 AS lat0, -22.5e0 + s_suppkey % 60 AS lon1, 34.25e0 + s_suppkey % 55 AS lat1 FROM supplier)"


def cover(src: str, keep: str) -> str:
    lo, hi = "greatest(lat0, -85.05112878e0)", "least(lat1, 85.05112878e0)"
    at = lambda v: f"round(({v}) / {SPAN}, 9)"
    return f"""SELECT {keep}, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty FROM (SELECT *, unnest(range(c, e)) AS ty FROM (SELECT *, unnest(range(a, b)) AS tx FROM (SELECT *,
  CAST(least(127, greatest(0, floor({at(mx('lon0') + ' + ' + O)}))) AS BIGINT) AS a, CAST(least(128, greatest(1, ceil({at(mx('lon1') + ' + ' + O)}))) AS BIGINT) AS b,
  CAST(least(127, greatest(0, floor({at(O + ' - ' + my(hi))}))) AS BIGINT) AS c, CAST(least(128, greatest(1, ceil({at(O + ' - ' + my(lo))}))) AS BIGINT) AS e FROM {src} WHERE {lo} < {hi})))"""


PLAN = f"""{BOXES}, planned AS (SELECT DISTINCT * FROM ({cover('boxes', 'id % 5 AS source_id')})),
prints AS (SELECT s_suppkey % 5 AS source_id, -24e0 + s_suppkey % 60 AS lon0, 31e0 + s_suppkey % 37 AS lat0, -23.5e0 + s_suppkey % 60 AS lon1, 31.5e0 + s_suppkey % 37 AS lat1 FROM supplier WHERE s_suppkey % 5 < 3),
hits AS (SELECT DISTINCT * FROM ({cover('prints', 'source_id')})),
built AS (SELECT *, CASE WHEN tx % 2 = 0 THEN 14 ELSE 11 END AS level FROM planned WHERE (tx + ty) % 4 = 0)"""
SOURCES = """sources AS (SELECT CASE WHEN n_nationkey = 5 THEN 'ALGERIA' ELSE n_name END AS id, n_name, n_nationkey AS k, CAST(CASE WHEN n_nationkey = 4 THEN 30 ELSE 10 * n_nationkey END AS BIGINT) AS priority,
  CASE WHEN n_nationkey = 3 THEN 20e0 ELSE 1e0 END AS native_res, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 14 ELSE 12 END AS INT) AS finest_level, 10e0 + n_nationkey AS lon0, 45e0 AS lat0, CASE WHEN n_nationkey = 2 THEN 12e0 ELSE 12e0 + n_nationkey END AS lon1, 47.5e0 AS lat1 FROM nation)"""
WX, WY = 2329600, 1439232
POINTS = f"{PEAKS}, points AS (SELECT osm_id, {mx('plon')} AS x, {my('plat')} AS y FROM peaks)"


def inside(x: str, y: str, cut: int = 0) -> str:
    n = 1536 >> cut
    return f"({x} BETWEEN {WX >> cut} AND {(WX >> cut) + n - 1} AND {y} BETWEEN {WY >> cut} AND {(WY >> cut) + n - 1})"


def dither(x: str, y: str) -> str:
    def noise(u: str, v: str) -> str:
        i = f"({u} * 0.06711056e0 + {v} * 0.00583715e0)"
        o = f"(52.9829189e0 * ({i} - floor({i})))"
        return f"({o} - floor({o}))"

    return f"({noise(x, y)} - {noise(f'({y} * 1.7e0 + 11e0)', f'({x} * 0.9e0 + 23e0)')})"


def cell(z: int, x: str, y: str, sparse: bool) -> str:
    """A cell's height in the window's pyramid."""
    cut = 14 - z
    gone = f"(({x} < {WX + 512} AND {y} >= {WY + 1024}) OR {pmod(f'{x} // 32 + 2 * ({y} // 32)', '5')} = 0)" if z == 14 else f"({pmod(f'{x} // 16 + {y} // 16', '7')} = 0)"
    at = [f"({c} * {1 << cut} + {(1 << cut) // 2})" for c in (x, y)]
    return f"CASE WHEN {inside(x, y, cut)}{f' AND NOT {gone}' if sparse else ''} THEN {code(*at)} * 0.1e0 - 500e0 END"


def sampled(src: str, out: str, x: str, y: str, levels: tuple[int, ...], sparse: bool) -> str:
    """Rows of ``src`` with h, bilinear from the first level that has it, and that level."""
    text, have = "", src
    for z in levels:
        res = f"({RES14} * {1 << (14 - z)})"
        text += f"""{out}_p{z} AS (SELECT *, round(({x} + {O}) / {res} - 0.5e0, 6) AS fx{z}, round(({O} - {y}) / {res} - 0.5e0, 6) AS fy{z} FROM {have}),
{out}_i{z} AS (SELECT *, CAST(floor(fx{z}) AS BIGINT) AS i{z}, CAST(floor(fy{z}) AS BIGINT) AS j{z}, fx{z} - floor(fx{z}) AS s{z}, fy{z} - floor(fy{z}) AS t{z} FROM {out}_p{z}),
{out}_c{z} AS (SELECT *, {', '.join(f"{cell(z, f'(i{z} + {i})', f'(j{z} + {j})', sparse)} AS v{z}{j}{i}" for j in (0, 1) for i in (0, 1))} FROM {out}_i{z}),
{out}_h{z} AS (SELECT *, coalesce((v{z}00 + (v{z}01 - v{z}00) * s{z}) + ((v{z}10 + (v{z}11 - v{z}10) * s{z}) - (v{z}00 + (v{z}01 - v{z}00) * s{z})) * t{z}, v{z}00) AS h{z} FROM {out}_c{z}),
"""
        have = f"{out}_h{z}"
    whens = " ".join(f"WHEN h{z} IS NOT NULL THEN {z}" for z in levels)
    return text + f"{out} AS (SELECT *, coalesce({', '.join(f'h{z}' for z in levels)}) AS h, CAST(CASE {whens} END AS INT) AS z FROM {have})"


RING = f"""ring AS (SELECT *, unnest(range(-1, 8)) AS k FROM views),
spots AS (SELECT view, k, {mx('lon')} + CASE WHEN k < 0 THEN 0e0 ELSE 10e0 / cos(radians(lat)) * cos(k * 0.7853981633974483e0) END AS x, {my('lat')} + CASE WHEN k < 0 THEN 0e0 ELSE 10e0 / cos(radians(lat)) * sin(k * 0.7853981633974483e0) END AS y FROM ring),
{sampled('spots', 'ground_spots', 'x', 'y', (14, 12), True)},
grounds AS (SELECT view, CASE WHEN count(h) FILTER (WHERE k < 0) > 0 THEN max(h) END AS ground FROM ground_spots GROUP BY view)"""


def over_blocks(text: str) -> str:
    """A march's SQL with eyes and heights from the window's sparse pyramid."""
    text = text.replace(EYES, f"{VIEWS}, {RING}, eyes AS (SELECT v.*, ground + 1.7e0 AS eye FROM views v JOIN grounds USING (view) WHERE ground IS NOT NULL)")
    high = text[text.index("high AS ("):text.index("angled AS (")]
    return text.replace(high, f"{sampled('placed', 'found', 'sx', 'sy', (14, 12), True)}, high AS (SELECT * FROM found WHERE h IS NOT NULL),\n")


BLOCK_MARCH = over_blocks(march(24, "0e0 + (ray + 0.5e0) * 15e0", "ceil(round((2000e0 - step) / step, 9))"))


def level_height(z: str, x: str, y: str) -> str:
    """The formula surface at a level from 12 to 14."""
    at = lambda c, n, k: f"(CAST(floor(round(({c}) / ({RES14} * {n}), 6)) AS BIGINT) * {n} + {k})"
    return "(CASE " + " ".join(f"WHEN {z} = {v} THEN {code(at(f'{x} + {O}', n, n // 2), at(f'{O} - {y}', n, n // 2))} * 0.1e0 - 500e0" for v, n in ((14, 1), (13, 2), (12, 4))) + " END)"


def far(text: str, limit: float, inclusive: bool) -> str:
    """A march's SQL with a ladder over the levels 14, 13 and 12."""
    last = lambda c: f"floor({c}) + 1" if inclusive else f"ceil({c})"
    n = lambda start, step, until, end: f"CAST(greatest(0, {last(f'round(({limit}e0 - {start}) / {step}, 9)') if end else f'ceil(round((least({until}, {limit}e0) - {start}) / {step}, 9))'}) AS BIGINT)"
    end = 12 if limit > 29000 else 13
    runs = f"""l0 AS (SELECT *, step AS g14, {ground('13', 'lat')} AS g13, {ground('12', 'lat')} AS g12 FROM rays),
l1 AS (SELECT *, {n('g14', 'g14', 'g13 / 0.00087e0', False)} AS n14 FROM l0),
l2 AS (SELECT *, g14 + n14 * g14 AS s13, {n('(g14 + n14 * g14)', 'g13', 'g12 / 0.00087e0', end == 13)} AS n13 FROM l1),
l3 AS (SELECT *, s13 + n13 * g13 AS s12, {n('(s13 + n13 * g13)', 'g12', '1e300', True) if end == 12 else '0'} AS n12 FROM l2),
l4 AS (SELECT *, unnest(range(n14 + n13 + n12)) AS k FROM l3),
steps AS (SELECT * EXCLUDE (step), CASE WHEN k < n14 THEN 14 WHEN k < n14 + n13 THEN 13 ELSE 12 END AS z, CASE WHEN k < n14 THEN g14 WHEN k < n14 + n13 THEN g13 ELSE g12 END AS step,
  CASE WHEN k < n14 THEN g14 + k * g14 WHEN k < n14 + n13 THEN s13 + (k - n14) * g13 ELSE s12 + (k - n14 - n13) * g12 END AS d, g14 AS first_step FROM l4),
"""
    old = text[text.index("steps AS ("):text.index("placed AS (")]
    high = text[text.index("high AS ("):text.index("angled AS (")]
    return text.replace(old, runs).replace(high, f"high AS (SELECT *, {level_height('z', 'sx', 'sy')} AS h FROM placed),\n")


FAR_MARCH = far(MARCH, 40000.0, False)
FAR_SHED = far(march(32, "360e0 * ray / 32", "0"), 40000.0, True)
FAR_PEAKS = DOMINANT.replace(MARCH, far(MARCH, 25000.0, False)).replace("800e0", "25000e0").replace(f"{code(px(mx('plon')), py(my('plat')))} * 0.1e0 - 500e0", level_height(level("distance", "lat"), mx("plon"), my("plat")))
FAR_PEAKS = FAR_PEAKS.replace("answers AS (", f"rises AS MATERIALIZED (SELECT * FROM (SELECT *, max(alpha) {BEFORE} AS up FROM kept) WHERE up IS NULL OR alpha > up),\nanswers AS (").replace("LEFT JOIN kept k", "LEFT JOIN rises k")
ASKED = """asked AS (SELECT event_id AS id, event_id AS k, CASE WHEN event_id % 13 = 0 THEN 'nan'::DOUBLE ELSE 49e0 END AS lat, coalesce(CASE WHEN event_id % 5 <> 0 THEN event_id % 7 / 20e0 END, 0.05e0) AS step, event_id % 500 - 20e0 AS fov,
  CASE WHEN event_id % 11 = 0 THEN 95e0 ELSE event_id % 60 * 1e0 END AS alt_max, event_id % 30 * 2000e0 - 4000e0 AS radius, event_id % 9 * 3e0 AS scale, CASE WHEN event_id % 17 = 0 THEN -1e0 ELSE 1e0 END AS ridge FROM events)"""

FILES = f"""{PLAN}, named AS (SELECT n_name AS source_id, CASE WHEN n_nationkey % 3 = 0 THEN 14 ELSE 12 END AS f, 10 * n_nationkey AS priority, b.tx, b.ty, (b.tx + 2 * b.ty) % 7 = 0 AS half FROM built b JOIN nation ON b.source_id = n_nationkey),
tiles AS (SELECT source_id, CAST(f AS INT) AS built_level, priority, tx, ty, '/dem/norm/' || source_id || '/' || f || '/' || tx || '_' || ty || '.tif' AS location FROM named WHERE NOT half)"""


RASTER = "SELECT x, y, CASE WHEN s % 10 = 0 THEN 0 ELSE 5000 + s % 3000 END AS v FROM (SELECT l_orderkey % 320 AS x, l_partkey % 240 AS y, sum(l_suppkey * 37 + l_linenumber) AS s FROM lineitem GROUP BY ALL)"

SPECKLED = f"""SELECT x, y, CASE WHEN (x * 7 + y * 3) % 11 = 0 THEN 0 ELSE {code('x', 'y')} END AS v FROM (SELECT {WX} + i % 1536 AS x, {WY} + i // 1536 AS y FROM range(2359296) t(i))
UNION ALL SELECT x, y, CASE WHEN s % 10 = 0 THEN 0 ELSE 5000 + s % 3000 END AS v FROM (SELECT l_orderkey % 1536 AS x, 7 * (l_orderkey // 1536) + l_linenumber - 1 AS y, sum(l_suppkey * 37 + l_linenumber) AS s FROM lineitem GROUP BY ALL)"""


def _overviews() -> str:
    text = f"WITH c14 AS (SELECT * FROM ({RASTER}))"
    for z in range(13, 7, -1):
        text += f", c{z} AS MATERIALIZED (SELECT x // 2 AS x, y // 2 AS y, CAST(round(sum(v) / count(*)) AS BIGINT) AS v FROM c{z + 1} WHERE v <> 0 GROUP BY ALL)"
    return text + " " + " UNION ALL ".join(f"SELECT CAST({z} AS INT) AS level, x, y, v FROM c{z}" for z in range(13, 7, -1))


OVERVIEWS = _overviews()


def _layer_tiles() -> str:
    def corner(crs: int, left: str, top: str, cell: str, res: str, i: str) -> tuple[str, str]:
        a, b = f"({left} + (x + {i}) * {cell})", f"({top} - (y + {i}) * {cell})"
        if crs == 4326:
            a, b = mx(a), my(b)
        return f"round(({a} + {O}) / {res}, 6)", f"round(({O} - {b}) / {res}, 6)"

    res13 = f"{2 * math.pi * 6378137.0 / 256.0 / 2.0**13!r}e0"
    east = [corner(3857, "2226400e0", "6274900e0", "16.3e0", RES14, i) for i in ("0", "1")]
    west = [corner(4326, "20.03e0", "49e0", "0.0002e0", res13, i) for i in ("0", "1")]
    whole = [corner(4326, "20.01e0", "49.02e0", "0.00021e0", res13, i) for i in ("-0.5e0", "0.5e0", "1.5e0")]
    ends = lambda some: ", ".join(f"{c} AS {axis}{k}" for k, both in enumerate(some) for axis, c in zip("xy", both))
    hat = lambda p, c: f"CASE WHEN {p} < {c}1 THEN ({p} - {c}0) / ({c}1 - {c}0) ELSE ({c}2 - {p}) / ({c}2 - {c}1) END"
    text = f"""WITH r AS MATERIALIZED (SELECT x, y, v * 0.5e0 AS v FROM ({RASTER}) WHERE v <> 0),
e AS (SELECT 'east' AS source_id, 14 AS level, v, {ends(east)} FROM r WHERE x < 160 UNION ALL SELECT 'west', 13, v, {ends(west)} FROM (SELECT x - 160 AS x, y, v FROM r WHERE x >= 160)),
a AS (SELECT *, unnest(range(CAST(floor(x0) AS BIGINT), CAST(ceil(x1) AS BIGINT))) AS x FROM e),
b AS (SELECT *, unnest(range(CAST(floor(y0) AS BIGINT), CAST(ceil(y1) AS BIGINT))) AS y FROM a),
h AS (SELECT *, unnest(range(CAST(ceil(x0 - 0.5e0) AS BIGINT), CAST(floor(x2 - 0.5e0) AS BIGINT) + 1)) AS x FROM (SELECT v, {ends(whole)} FROM r)),
k AS (SELECT *, unnest(range(CAST(ceil(y0 - 0.5e0) AS BIGINT), CAST(floor(y2 - 0.5e0) AS BIGINT) + 1)) AS y FROM h),
w AS (SELECT source_id, level, x, y, v, (least(x1, x + 1e0) - greatest(x0, x)) * (least(y1, y + 1e0) - greatest(y0, y)) AS w FROM b
  UNION ALL SELECT 'whole', 13, x, y, v, ({hat('(x + 0.5e0)', 'x')}) * ({hat('(y + 0.5e0)', 'y')}) FROM k),
g AS MATERIALIZED (SELECT source_id, level, x, y, sum(v * w) / sum(w) AS v FROM w WHERE w > 1e-9 GROUP BY ALL),
o AS (SELECT i, j, pow(i * i + j * j, -0.5e0) AS w FROM range(-2, 3) p(i), range(-2, 3) q(j) WHERE i * i + j * j BETWEEN 1 AND 4),
f AS (SELECT x + i AS x, y + j AS y, sum(v * w) / sum(w) AS v FROM g, o WHERE source_id = 'east' AND x // 512 = (x + i) // 512 AND y // 512 = (y + j) // 512 GROUP BY ALL),
u AS (SELECT * FROM g UNION ALL SELECT 'east', 14, x, y, v FROM f WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.source_id = 'east' AND g.x = f.x AND g.y = f.y)),
c14 AS MATERIALIZED (SELECT source_id, level, x, y, CAST(round(round((v + 500e0) * 10e0, 4)) AS BIGINT) AS v FROM u)"""
    for z in range(13, 9, -1):
        text += f", c{z} AS MATERIALIZED (SELECT source_id, {z} AS level, x // 2 AS x, y // 2 AS y, CAST(round(sum(v) / count(*)) AS BIGINT) AS v FROM {'c14' if z == 13 else f'(FROM c{z + 1} UNION ALL FROM c14)'} WHERE level = {z + 1} GROUP BY ALL)"
    return text + " " + " UNION ALL ".join(f"SELECT source_id, CAST(level AS INT) AS level, x, y, v FROM c{z}" for z in range(14, 9, -1))


LAYER_TILES = _layer_tiles()
RECT_WKT = """WITH r AS (SELECT '/vrt/' || n_name || '.vrt' AS file, n_nationkey * 1000e0 + off_ * 25e0 AS x0, n_nationkey * 1000e0 + off_ * 25e0 + (100 + n_nationkey) * 25e0 AS x1, 500000e0 AS y0, 498750e0 AS y1 FROM nation, (SELECT unnest([1, 2]) AS m) CROSS JOIN LATERAL (SELECT n_nationkey * m AS off_))
SELECT file, 'POLYGON ((' || printf('%.4f %.4f,%.4f %.4f,%.4f %.4f,%.4f %.4f,%.4f %.4f', x0, y0, x1, y0, x1, y1, x0, y1, x0, y0) || '))' AS wkt FROM r"""
EVENTS = """ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY queue_id ORDER BY t, seq) AS n FROM (SELECT user_id % 16 AS queue_id, event_id AS seq, epoch_us(ts) / 1e6 AS t, CASE event_type WHEN 'purchase' THEN 10 WHEN 'signup' THEN 5 ELSE 0 END AS priority, 5e0 + coalesce(value, 0e0) / 20 AS service, event_type = 'error' AS gone FROM events))"""
QUEUE = f"""WITH RECURSIVE {EVENTS},
sim AS (SELECT queue_id, CAST(1 AS BIGINT) AS n, -1e300 AS busy, CAST([] AS STRUCT(k DOUBLE, seq BIGINT, service DOUBLE, depth INT)[]) AS w, CAST(NULL AS STRUCT(seq BIGINT, outcome VARCHAR, start DOUBLE, finish DOUBLE, depth INT)) AS o FROM (SELECT DISTINCT queue_id FROM ev)
UNION ALL SELECT queue_id, CASE WHEN pop THEN n ELSE n + 1 END, CASE WHEN pop THEN busy + w[1].service WHEN free THEN t + service ELSE busy END,
  CASE WHEN pop THEN w[2:] WHEN free OR gone OR len(w) >= 10 THEN w ELSE list_sort(list_append(w, {{'k': -(priority - 0.2e0 * t), 'seq': seq, 'service': service, 'depth': CAST(len(w) + 1 AS INT)}})) END,
  CASE WHEN pop THEN {{'seq': w[1].seq, 'outcome': 'served', 'start': busy, 'finish': busy + w[1].service, 'depth': w[1].depth}}
    WHEN free THEN {{'seq': seq, 'outcome': 'served', 'start': t, 'finish': t + service, 'depth': 0}}
    WHEN len(w) >= 10 THEN {{'seq': seq, 'outcome': 'rejected', 'start': t, 'finish': t, 'depth': CAST(len(w) + 1 AS INT)}}
    WHEN gone THEN {{'seq': seq, 'outcome': 'abandoned', 'start': t, 'finish': t, 'depth': CAST(len(w) + 1 AS INT)}} END
  FROM (SELECT s.queue_id, s.n, busy, w, e.t, e.seq, e.priority, e.service, e.gone, len(w) > 0 AND (e.n IS NULL OR busy <= e.t) AS pop, len(w) = 0 AND e.t >= busy AS free FROM sim s LEFT JOIN ev e ON e.queue_id = s.queue_id AND e.n = s.n WHERE e.n IS NOT NULL OR len(w) > 0))
SELECT queue_id, o.seq AS seq, o.outcome AS outcome, o.start AS start, o.finish AS finish, o.depth AS depth FROM sim WHERE o IS NOT NULL"""
ADMISSION = f"""WITH RECURSIVE {EVENTS},
sim AS (SELECT queue_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, 0e0 AS level, CAST(NULL AS DOUBLE) AS before, false AS admitted FROM (SELECT DISTINCT queue_id FROM ev)
UNION ALL SELECT queue_id, n, seq, CASE WHEN now_ <= 10 THEN now_ + 1 ELSE level END, CASE WHEN now_ <= 10 THEN t ELSE before END, now_ <= 10 FROM (SELECT e.queue_id, e.n, e.seq, e.t, s.level, s.before, greatest(0e0, s.level - coalesce((e.t - s.before) * 20e0 / 60e0, 0e0)) AS now_ FROM sim s JOIN ev e ON e.queue_id = s.queue_id AND e.n = s.n + 1))
SELECT queue_id AS client, seq, admitted FROM sim WHERE n > 0"""

ORACLES: dict[str, str] = {
    "geo_project": f"WITH {VIEWS}, p AS (SELECT *, {mx('lon')} AS x, {my('lat')} AS y FROM views) SELECT view, round(x, 6) AS x, round(y, 6) AS y, round(x / {O} * 180e0, 6) AS lon, round(degrees(2 * atan(exp(y / {R})) - {math.pi / 2!r}e0), 6) AS lat FROM p",
    "geo_distance_bearing": f"WITH {PEAKS} SELECT osm_id, round({gc('20.01e0', '49.01e0', 'plon', 'plat')}, 4) AS distance, round({bearing('20.01e0', '49.01e0', 'plon', 'plat')}, 4) AS azimuth FROM peaks",
    "geo_destination": f"WITH {VIEWS}, p AS (SELECT *, CAST(view * 37 % 360 AS DOUBLE) AS azimuth, CAST(1000 + view * 10 AS DOUBLE) AS d FROM views) SELECT view, round({LON}, 6) AS lon, round({LAT}, 6) AS lat FROM p",
    "curvature_levels": f"WITH p AS (SELECT p_partkey AS k, CAST(p_partkey * 7919 % 500000 + 10 AS DOUBLE) AS d FROM part), q AS (SELECT *, {level('d', '49e0')} AS level FROM p) SELECT k, round({drop('d')}, 6) AS \"drop\", CAST(level AS INT) AS level, round({ground('level', '49e0')}, 6) AS res FROM q",
    "grid_constants": f"SELECT k, CAST(z AS INT) AS level, CAST(32768 >> CAST(14 - z AS INT) AS INT) AS px, round({2 * math.pi * 6378137.0 / 256.0!r}e0 / pow(2e0, z), 6) AS res, round({ground('z', 'lat')}, 6) AS ground, CAST(128 AS INT) AS across FROM (SELECT p_partkey AS k, 8 + p_partkey % 7 AS z, 40e0 + p_size / 4e0 AS lat FROM part)",
    "tile_extents": f"SELECT n_nationkey AS tx, n_nationkey * 3 + 20 AS ty, round(-{O} + n_nationkey * {SPAN}, 4) AS x0, round({O} - (n_nationkey * 3 + 21) * {SPAN}, 4) AS y0, round(-{O} + (n_nationkey + 1) * {SPAN}, 4) AS x1, round({O} - (n_nationkey * 3 + 20) * {SPAN}, 4) AS y1 FROM nation",
    "bbox_cover": f"WITH {BOXES} {cover('boxes', 'id')}",
    "bbox_area": f"WITH {BOXES}, t AS (SELECT *, regexp_replace(CAST(lon0 AS VARCHAR), '\\.0$', '') AS a, regexp_replace(CAST(lat0 AS VARCHAR), '\\.0$', '') AS b, regexp_replace(CAST(lon1 AS VARCHAR), '\\.0$', '') AS c, regexp_replace(CAST(lat1 AS VARCHAR), '\\.0$', '') AS d FROM boxes) SELECT id, round({6371.0**2!r}e0 * radians(lon1 - lon0) * abs(sin(radians(lat1)) - sin(radians(lat0))), 3) AS area_km2, 'POLYGON ((' || a || ' ' || b || ',' || c || ' ' || b || ',' || c || ' ' || d || ',' || a || ' ' || d || ',' || a || ' ' || b || '))' AS wkt FROM t",
    "ladder_steps": f"WITH RECURSIVE {VIEWS}, l AS (SELECT view, lat, {ground('14', 'lat')} AS d, 1 AS n FROM views UNION ALL SELECT view, lat, d + {ground(level('d', 'lat'), 'lat')}, n + 1 FROM l WHERE d + {ground(level('d', 'lat'), 'lat')} <= 60000e0) SELECT view, CAST(max(n) AS BIGINT) AS steps, round(max(d), 4) AS last FROM l GROUP BY view",
    "catalog_resolved": f"WITH {SOURCES} SELECT id, priority, finest_level, 'average' AS resampling, 'tiles' AS footprint, CASE WHEN k = 1 THEN -9999e0 END AS nodata_value, k <> 1 AS nodata_declared, lon0, lat0, lon1, lat1 FROM sources",
    "catalog_violations": f"WITH {SOURCES} SELECT id, priority, rule FROM (SELECT *, unnest(list_filter([CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate id' END, CASE WHEN count(*) OVER (PARTITION BY priority) > 1 THEN 'duplicate priority' END, CASE WHEN lon0 >= lon1 OR lat0 >= lat1 THEN 'degenerate bbox' END, CASE WHEN {ground('finest_level', '49e0')} < native_res * 0.75e0 THEN 'upsampling' END], lambda x: x IS NOT NULL)) AS rule FROM sources)",
    "index_plan": "SELECT CAST(z AS INT) AS level, n_name AS source_id, 10 * n_nationkey AS priority, CAST(f - z - 1 AS INT) AS ovr, '/dem/norm/' || n_name || '/' || f AS dir FROM (SELECT *, CASE WHEN n_nationkey % 3 = 0 THEN 14 ELSE 12 END AS f FROM nation) s, range(8, 15) t(z) WHERE z <= f",
    "elevation_sources": f"WITH {SOURCES}, n AS (SELECT *, regexp_replace(CAST(lon0 AS VARCHAR), '\\.0$', '') AS a, regexp_replace(CAST(lon1 AS VARCHAR), '\\.0$', '') AS b FROM sources) SELECT string_agg(lower(n_name) || ':/data/' || n_name || '.tif:' || a || ',45,' || b || ',47.5', ';' || chr(10) ORDER BY priority DESC, lower(n_name)) AS elevation_sources FROM n",
    "source_order": "SELECT n_name AS source_id, 10 * n_nationkey AS priority, row_number() OVER (ORDER BY n_nationkey DESC) AS rank FROM nation",
    "build_environment": f"WITH {SOURCES}, t AS ({cover('sources', 'id, n_name, k, finest_level AS z')}) SELECT id, tx, ty, " + " || ".join(f"'{name}=' || {value} || chr(10)" for name, value in {
        "SRC_ID": "id", "SRC_PATH": "'/data/' || n_name || '.tif'", "LEVEL": "z", "TX": "tx", "TY": "ty", "PX": "(32768 >> CAST(14 - z AS INT))", "BLOCK": "'512'", "OVERVIEW_COUNT": "(z - 8)",
        "TE": f"printf('\"%.6f %.6f %.6f %.6f\"', -{O} + tx * {SPAN}, {O} - (ty + 1) * {SPAN}, -{O} + (tx + 1) * {SPAN}, {O} - ty * {SPAN})", "RESAMPLING": "'average'", "SRCNODATA": "CASE WHEN k = 1 THEN '-9999' ELSE '' END", "WARP_NODATA": "'-9999'", "SCALE": "'\"-500 6053.5 0 65535\"'",
        "FILL_NODATA_MD": "CASE WHEN k = 4 THEN '5' ELSE '' END", "DST_DIR": "'/dem/norm/' || id || '/' || z", "DST": "'/dem/norm/' || id || '/' || z || '/' || tx || '_' || ty || '.tif'",
    }.items()) + " AS env FROM t",
    "tile_plan_semi_anti": f"WITH {PLAN} SELECT source_id, tx, ty FROM planned p WHERE (source_id NOT IN (SELECT source_id FROM prints) OR EXISTS (SELECT 1 FROM hits h WHERE h.source_id = p.source_id AND h.tx = p.tx AND h.ty = p.ty)) AND NOT EXISTS (SELECT 1 FROM built b WHERE b.source_id = p.source_id AND b.tx = p.tx AND b.ty = p.ty AND b.level IN (14, 12))",
    "build_progress": f"WITH {PLAN} SELECT CAST(coalesce(source_id, -1) AS BIGINT) AS source_id, count(*) AS planned, CAST(sum(CASE WHEN (tx + ty) % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS built FROM planned GROUP BY ROLLUP (source_id)",
    "elev_codec": "WITH p AS (SELECT p_partkey AS k, CAST(greatest(0, least(65535, round(((p_partkey % 7000 - 600) * 1e0 + p_size / 7e0 + 500e0) * 10e0))) AS INT) AS code FROM part) SELECT k, code, CASE WHEN code <> 0 THEN round(code * 0.1e0 - 500e0, 4) END AS metres FROM p",
    "mosaic_priority": f"WITH c AS (SELECT {WX} + i % 1536 AS x, {WY} + i // 1536 AS y FROM range(2359296) t(i)), s AS (SELECT x, y, {code('x', 'y')} + n_nationkey AS value, CAST(10 * n_nationkey AS BIGINT) AS priority FROM c, nation WHERE {pmod('x // 64 + 3 * (y // 64) + n_nationkey', '67')} < 3) SELECT x, y, CAST(arg_max(value, priority) AS BIGINT) AS value, max(priority) AS priority FROM s GROUP BY x, y",
    "overview_avg": OVERVIEWS,
    "layer_tiles": LAYER_TILES,
    "sample_blocks": f"WITH {POINTS}, q AS (SELECT osm_id, {px('x')} AS cx, {py('y')} AS cy FROM points) SELECT osm_id, CASE WHEN {inside('cx', 'cy')} THEN round({code('cx', 'cy')} * 0.1e0 - 500e0, 6) END AS h FROM q",
    "sample_bilinear": f"WITH {POINTS}, {sampled('points', 'got', 'x', 'y', (14,), False)} SELECT osm_id, round(h, 4) AS h FROM got",
    "level_fallback": f"WITH {POINTS}, {sampled('points', 'got', 'x', 'y', (14, 12), True)} SELECT osm_id, round(h, 4) AS h, coalesce(z, -1) AS z FROM got",
    "eye_elevation": f"WITH {VIEWS}, ring AS (SELECT *, unnest(range(-1, 8)) AS k FROM views), spots AS (SELECT view, {mx('lon')} + CASE WHEN k < 0 THEN 0e0 ELSE 10e0 / cos(radians(lat)) * cos(k * 0.7853981633974483e0) END AS x, {my('lat')} + CASE WHEN k < 0 THEN 0e0 ELSE 10e0 / cos(radians(lat)) * sin(k * 0.7853981633974483e0) END AS y FROM ring) SELECT view, round(max({code(px('x'), py('y'))} * 0.1e0 - 500e0), 6) AS ground FROM spots GROUP BY view",
    "speckle_fill": f"WITH c AS MATERIALIZED ({SPECKLED}), o AS (SELECT dx, dy, pow(dx * dx + dy * dy, -0.5e0) AS w FROM range(-5, 6) a(dx), range(-5, 6) b(dy) WHERE dx * dx + dy * dy BETWEEN 1 AND 25), h AS (SELECT x, y, x + dx AS nx, y + dy AS ny, w FROM c, o WHERE v = 0), f AS (SELECT h.x, h.y, sum(n.v * w) / sum(w) AS f FROM h JOIN c n ON n.x = h.nx AND n.y = h.ny WHERE n.v <> 0 GROUP BY h.x, h.y) SELECT c.x, c.y, CAST(coalesce(round(f.f), c.v) AS BIGINT) AS v FROM c LEFT JOIN f ON c.v = 0 AND f.x = c.x AND f.y = c.y",
    "viewshed_cells": f"WITH {SHED_CELLS} SELECT view, ix, iy, CAST(alpha AS INT) AS alpha FROM shed",
    "viewshed_stats": f"WITH {SHED_CELLS} SELECT view, count(*) AS pixels, CAST(sum(alpha) AS BIGINT) AS opacity FROM shed GROUP BY view",
    "eye_fallback": f"WITH {VIEWS}, {RING} SELECT view, round(ground, 4) AS ground FROM grounds",
    "ray_horizon_blocks": f"WITH {BLOCK_MARCH}, v AS (SELECT view, ray, alpha, max(alpha) {BEFORE} AS horizon FROM samples) SELECT view, ray, count(*) AS samples, count(*) FILTER (WHERE horizon IS NULL OR alpha > horizon) AS visible, round(max(alpha), 6) AS horizon FROM v GROUP BY view, ray",
    "ray_horizon_far": f"WITH {FAR_MARCH}, v AS (SELECT view, ray, alpha, max(alpha) {BEFORE} AS horizon FROM samples) SELECT view, ray, count(*) AS samples, count(*) FILTER (WHERE horizon IS NULL OR alpha > horizon) AS visible, round(max(alpha), 6) AS horizon FROM v GROUP BY view, ray",
    "viewshed_blocks": f"WITH {SHED_CELLS.replace(SHED, over_blocks(SHED))} SELECT view, ix, iy, CAST(alpha AS INT) AS alpha FROM shed",
    "viewshed_far": f"WITH {SHED_CELLS.replace(SHED, FAR_SHED).replace('20e0 / cos(radians(lat)) AS proj', '8000e0 / cos(radians(lat)) AS proj').replace('proj * 20e0', 'proj * 5e0').replace('BETWEEN 0 AND 39', 'BETWEEN 0 AND 9')} SELECT view, ix, iy, CAST(alpha AS INT) AS alpha FROM shed",
    "peak_far": f"WITH {FAR_PEAKS}, top AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY dominance DESC, osm_id) AS rank FROM ranked WHERE dominance >= -1000 AND y BETWEEN 0 AND 40) SELECT view, osm_id, dominance, rank FROM top WHERE rank <= 5",
    "rect_wkt": RECT_WKT,
    "queue_schedule": QUEUE,
    "client_admission": ADMISSION,
    "tile_scan": f"WITH {FILES} SELECT source_id, built_level, tx, ty, location FROM tiles",
    "tile_priority": f"WITH {FILES} SELECT location, source_id, priority FROM tiles",
    "level_index": f"WITH {FILES} SELECT CAST(z AS INT) AS level, source_id, priority, CAST(built_level - z - 1 AS INT) AS ovr, tx, ty, location FROM tiles, range(8, 15) t(z) WHERE z <= built_level",
    "only_sources": f"WITH {SOURCES} SELECT id, priority FROM sources WHERE id IN ('NATION_3', 'NATION_20')",
    "build_order": f"WITH {SOURCES} SELECT id, row_number() OVER (ORDER BY CASE id WHEN 'NATION_9' THEN 1 WHEN 'NATION_20' THEN 2 WHEN 'NATION_6' THEN 3 ELSE 4 END, priority DESC, id) AS turn FROM sources WHERE priority <> 30",
    "cheapest_steps": "SELECT 'tile-' || s_suppkey AS step, s_suppkey * 37 % 101 AS seconds FROM supplier ORDER BY seconds, step LIMIT 3",
    "latest_steps": "SELECT 'tile-' || s_suppkey AS step, s_suppkey * 53 % 211 AS finished FROM supplier ORDER BY finished DESC, step LIMIT 5",
    "peak_counts": f"WITH {DOMINANT}, good AS (SELECT view, least(count(*), 5) AS labelled FROM ranked WHERE dominance >= -1000 AND y BETWEEN 0 AND 40 GROUP BY view) SELECT view, count(*) AS found, count(*) FILTER (WHERE visible) AS seen, coalesce(any_value(labelled), 0) AS labelled FROM decided LEFT JOIN good USING (view) GROUP BY view",
    "footprint_fill": f"WITH b AS (SELECT '/vrt/' || n_name || '.vrt' AS file, round(2 * (100 + n_nationkey) * 25e0 * 50 * 25 / 1e6, 1) AS area, round({6371.0**2!r}e0 * radians(n_nationkey / 10e0 + 0.05e0 - n_nationkey / 10e0) * abs(sin(radians(45.05e0)) - sin(radians(45e0))), 1) AS bbox_area_km2 FROM nation) SELECT file, bbox_area_km2, round(100 * area / bbox_area_km2, 4) AS fill FROM b",
    "json_requests": "SELECT event_id AS id, event_id % 6 = 0 OR (event_id % 11 = 0 AND event_id % 7 <> 0) AS malformed, CASE WHEN event_id % 6 = 0 OR (event_id % 11 = 0 AND event_id % 7 <> 0) THEN -1e0 ELSE event_id % 40 * 1e0 END AS lon, CASE WHEN event_id % 6 = 0 OR (event_id % 11 = 0 AND event_id % 7 <> 0) THEN 0e0 WHEN event_id % 7 = 0 THEN 90e0 ELSE 360e0 END AS fov FROM events",
    "viewshed_bounds": f"WITH {VIEWS}, p AS (SELECT view, {mx('lon')} AS x, {my('lat')} AS y, 400e0 / cos(radians(lat)) AS half FROM views) SELECT view, round((x - half) / {O} * 180e0, 6) AS west, round(degrees(2 * atan(exp((y - half) / {R})) - {math.pi / 2!r}e0), 6) AS south, round((x + half) / {O} * 180e0, 6) AS east, round(degrees(2 * atan(exp((y + half) / {R})) - {math.pi / 2!r}e0), 6) AS north, CAST(40 AS INT) AS px, CAST(126 AS INT) AS rays FROM p",
    "ray_horizon": f"WITH {MARCH}, v AS (SELECT view, ray, alpha, max(alpha) {BEFORE} AS horizon FROM samples) SELECT view, ray, count(*) AS samples, count(*) FILTER (WHERE horizon IS NULL OR alpha > horizon) AS visible, round(max(alpha), 6) AS horizon FROM v GROUP BY view, ray",
    "ray_stats": f"WITH {KEPT} SELECT view, count(*) AS samples, count(DISTINCT ({px('sx')} // 512, {py('sy')} // 512)) AS blocks FROM kept GROUP BY view",
    "column_stop": f"WITH {KEPT} SELECT view, ray, count(*) AS kept, round(max(d), 4) AS last FROM kept GROUP BY view, ray",
    "column_fill": f"WITH {FILL} SELECT view, ray, row, round(dist, 4) AS dist, round(CAST(cover AS DOUBLE), 5) AS cover FROM cells",
    "sky_fraction": f"WITH {FILL} SELECT view, round(1 - count(*) / 960e0, 6) AS sky FROM cells GROUP BY view",
    "profile_bins": f"WITH {PROFILE} SELECT view, col, bin, round(CAST(max_h AS DOUBLE), 3) AS max_h FROM profile",
    "profile_band_max": f"WITH {PROFILE} SELECT view, col, round(CAST(max(max_h) AS DOUBLE), 3) AS top FROM profile WHERE bin BETWEEN {bin_('250e0')} AND {bin_('1000e0')} GROUP BY view, col",
    "peak_candidates": f"WITH {VIEWS}, {PEAKS}, {PAIRS.format('views')} SELECT view, osm_id, distance, azimuth FROM pairs",
    "peak_projection": f"WITH {EYES}, {SHOWN} SELECT view, osm_id, round(ele, 3) AS ele, round(altitude, 5) AS altitude, round(x, 7) AS x, round(y, 10) AS y, coalesce(\"column\", -1) AS \"column\" FROM projected",
    "peak_bracketing": f"WITH {EYES}, {SHOWN}, {SLOTS} SELECT view, osm_id, CAST(slot AS INT) AS slot, pray AS ray, round(t, 6) AS t FROM bracketed",
    "peak_visibility": f"WITH {SEEN} SELECT view, osm_id, visible FROM decided",
    "peak_dominance": f"WITH {DOMINANT} SELECT view, osm_id, dominance FROM ranked",
    "peak_topk": f"WITH {DOMINANT}, top AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY dominance DESC, osm_id) AS rank FROM ranked WHERE dominance >= -1000 AND y BETWEEN 0 AND 40) SELECT view, osm_id, dominance, rank FROM top WHERE rank <= 5",
    "depth_encode": f"WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 50 <> 0 THEN p_partkey * 211 % 450000 + 0.5e0 END AS d FROM part), c AS (SELECT k, {enc('d')} AS code FROM p) SELECT k, code, CASE WHEN code <> 0 THEN round(exp({math.log(10.0)!r}e0 + (code - 1) / 65534e0 * {DEPTH}), 3) END AS back FROM c",
    "depth_quantise": f"WITH p AS (SELECT p_partkey AS k, p_partkey * 7919 % 65536 AS code, p_size % 17 AS step FROM part) SELECT k, CAST(CASE WHEN code = 0 THEN 0 ELSE 1 + (code - 1) // greatest(step, 1) * greatest(step, 1) END AS BIGINT) AS q, round(step * {100 * math.log(40000.0) / 65534!r}e0, 6) AS error FROM p",
    "depth_delta": f"WITH {DEPTH_IMG}, q AS (SELECT *, CASE WHEN code = 0 THEN 0 ELSE 1 + (code - 1) // 4 * 4 END AS q FROM codes) SELECT view, col, row, CAST(q AS BIGINT) AS q, CAST(((q - lag(q, 1, 0) OVER (PARTITION BY view, row ORDER BY col) + 32768) & 65535) - 32768 AS BIGINT) AS delta FROM q",
    "depth_roundtrip": "SELECT s_suppkey AS view, CAST(240 AS BIGINT) AS pixels, CAST(240 AS BIGINT) AS equal FROM supplier",
    "edge_strength": f"WITH {FULL} SELECT view, ray, row, round(edge, 5) AS edge FROM edges WHERE edge > 0",
    "ink_spread": f"WITH {INK} SELECT view, ray, row, round(ink, 5) AS ink FROM inks",
    "shaded_column": f"WITH {SHADED} SELECT view, ray, count(*) AS rows, " + ", ".join(f"CAST(sum((row + 1) * CAST(round(round({c}, 3) * 1000) AS BIGINT)) AS BIGINT) AS {c}" for c in "rgb") + " FROM shaded GROUP BY view, ray",
    "panorama_pixels": f"WITH {SHADED}, m AS (SELECT view, CAST(ray // 2 AS INT) AS col, CAST(row // 2 AS INT) AS row, sum(r) / 4e0 AS r, sum(g) / 4e0 AS g, sum(b) / 4e0 AS b FROM shaded GROUP BY ALL) SELECT view, col, row, " + ", ".join(f"CAST(round(greatest(0e0, least(255e0, round({c}, 6) + {dither('col', 'row')} * 1e0))) AS BIGINT) AS {c}" for c in "rgb") + " FROM m",
    "panorama_depth": f"WITH {DEPTH_IMG}, q AS (SELECT *, CASE WHEN code = 0 THEN 0 ELSE 1 + (code - 1) // 4 * 4 END AS q FROM codes) SELECT view, col, row, CAST(q AS BIGINT) AS q, CAST(((q - lag(q, 1, 0) OVER (PARTITION BY view, row ORDER BY col) + 32768) & 65535) - 32768 AS BIGINT) AS delta FROM q",
    "warp_average": f"""WITH c AS (SELECT * FROM ({RASTER}) WHERE v <> 0),
a AS (SELECT x, y, v, unnest(range(CAST(floor(round((x - 0.7e0) / 2.5e0, 9)) AS BIGINT), CAST(ceil(round((x + 0.3e0) / 2.5e0, 9)) AS BIGINT))) AS i FROM c),
b AS (SELECT *, unnest(range(CAST(floor(round((y + 3.3e0) / 1.6e0, 9)) AS BIGINT), CAST(ceil(round((y + 4.3e0) / 1.6e0, 9)) AS BIGINT))) AS j FROM a),
w AS (SELECT i, j, v, (least(x + 1e0, (i + 1) * 2.5e0 + 0.7e0) - greatest(x, i * 2.5e0 + 0.7e0)) * (least(y + 1e0, (j + 1) * 1.6e0 - 3.3e0) - greatest(y, j * 1.6e0 - 3.3e0)) AS w FROM b)
SELECT i AS x, j AS y, round(sum(v * w) / sum(w), 4) AS v FROM w GROUP BY i, j""",
    "supersample_avg": f"WITH {SHADED} SELECT view, CAST(ray // 2 AS INT) AS col, CAST(row // 2 AS INT) AS row, round(sum(r) / 4e0, 3) AS r, round(sum(g) / 4e0, 3) AS g, round(sum(b) / 4e0, 3) AS b FROM shaded GROUP BY view, ray // 2, shaded.row // 2",
    "dither_levels": f"WITH p AS (SELECT p_partkey % 317 AS x, p_partkey // 317 AS y, p_size FROM part) SELECT x, y, round({dither('x', 'y')}, 6) AS noise, CAST(round(greatest(0e0, least(255e0, round(100 + p_size / 3e0, 6) + {dither('x', 'y')} * 1e0))) AS BIGINT) AS level FROM p",
    "request_validation": f"WITH {ASKED}, e AS (SELECT *, CASE WHEN isnan(lat) THEN 'lat must be a finite number' WHEN ridge < 0 THEN 'ridge_strength must not be negative' WHEN alt_max > 90 THEN 'alt_min and alt_max must lie within -90..90' END AS err FROM asked), w AS (SELECT *, CAST(round(CASE WHEN err IS NULL THEN greatest(0.1e0, least(360e0, fov)) ELSE 360e0 END / CASE WHEN err IS NULL THEN greatest(0.02e0, step) ELSE 1e0 END) AS BIGINT) AS width, CAST(round(CASE WHEN err IS NULL THEN (alt_max + 18e0) / greatest(0.02e0, step) ELSE 1e0 END) AS BIGINT) AS height FROM e), f AS (SELECT *, coalesce(err, CASE WHEN width * height > 24000000 THEN 'too many pixels' END) AS error FROM w) SELECT id, CAST(CASE WHEN error IS NULL THEN 200 ELSE 400 END AS INT) AS status, error, width, height FROM f",
    "viewshed_validation": f"WITH {ASKED}, e AS (SELECT *, CASE WHEN isnan(lat) THEN 'lat must be a finite number' WHEN radius <= 0 OR radius > 200000 THEN 'radius must lie within 0..200000' WHEN scale <= 0 THEN 'scale must be positive' END AS err FROM asked), w AS (SELECT *, CASE WHEN err IS NULL THEN greatest(1, CAST(round(2 * radius / scale) AS BIGINT)) END AS px FROM e), f AS (SELECT *, coalesce(err, CASE WHEN px * px > 24000000 THEN 'too many pixels' END) AS error FROM w) SELECT id, CAST(CASE WHEN error IS NULL THEN 200 ELSE 400 END AS INT) AS status, error, CAST(coalesce(px, 0) AS BIGINT) AS px FROM f",
    "colour_parse": "WITH h AS (SELECT p_partkey AS k, lower(lpad(printf('%x', p_partkey * 9973 % 16777216), 6, '0')) AS h FROM part), s AS (SELECT k, CASE k % 4 WHEN 0 THEN ' #' || h WHEN 1 THEN substr(h, 1, 3) WHEN 2 THEN substr(h, 1, 5) ELSE '##' || h END AS s, CASE k % 4 WHEN 1 THEN substr(h, 1, 1) || substr(h, 1, 1) || substr(h, 2, 1) || substr(h, 2, 1) || substr(h, 3, 1) || substr(h, 3, 1) WHEN 2 THEN NULL ELSE h END AS x FROM h) SELECT k, s, coalesce(CAST(CAST('0x' || substr(x, 1, 2) AS INT) AS BIGINT), -1) AS r, coalesce(CAST(CAST('0x' || substr(x, 3, 2) AS INT) AS BIGINT), -1) AS g, coalesce(CAST(CAST('0x' || substr(x, 5, 2) AS INT) AS BIGINT), -1) AS b FROM s",
    "compass_names": "SELECT p_partkey AS k, (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[CAST(round(p_partkey * 37 % 3600 / 10e0 / 45e0) AS INT) % 8 + 1] AS name FROM part",
    "crs_match": "WITH n AS (SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN '+datum=WGS84 +proj=longlat' WHEN 1 THEN '+datum=WGS84 +proj=utm +units=m +zone=34' ELSE '+a=6378137 +proj=merc' END AS norm, CASE n_nationkey % 2 WHEN 0 THEN '+datum=WGS84 +proj=longlat' ELSE '+datum=WGS84 +proj=utm +units=m +zone=34' END AS b FROM nation) SELECT k, norm, k % 5 = 0 OR norm = b AS same FROM n",
    "csv_split": "SELECT p_partkey AS k, CAST(4 AS BIGINT) AS n, replace(p_name, ' ', ', \"') AS name, CAST(p_size AS VARCHAR) AS last FROM part",
    "mime_types": "SELECT p_partkey AS k, (['image/avif', 'image/png', 'application/gzip', 'application/octet-stream', 'image/png'])[p_partkey % 5 + 1] AS mime, CASE WHEN regexp_full_match(p_name, '[A-Za-z0-9_@%+=:,./-]+') THEN p_name ELSE '''' || replace(p_name, '''', '''\\''''') || '''' END AS quoted, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 END AS BIGINT) AS priority FROM part",
    "descriptor_rebuild": """WITH d AS (SELECT n_name, CAST(n_nationkey AS DOUBLE) AS k FROM nation),
r AS (SELECT *, ' yOff="0.0" xSize="' || (100 + k) || '" ySize="50.0"/></ComplexSource>' AS tail, '</SourceFilename><SourceBand>1</SourceBand><DstRect xOff="' AS mid, '<ComplexSource><SourceFilename relativeToVRT="0">' AS head FROM d)
SELECT '/vrt/' || n_name || '.vrt' AS file, unnest(['/vrt/' || n_name || '.tif', '/abs/' || n_name || '.tif']) AS leaf, -9999e0 AS nodata,
'<VRTDataset rasterXSize="' || CAST(3 * k + 100 AS BIGINT) || '" rasterYSize="50"><SRS>EPSG:3857</SRS><GeoTransform>' || (k * 1000) || ', 25.0, 0.0, 500000.0, 0.0, -25.0</GeoTransform><VRTRasterBand band="1"><NoDataValue>-9999</NoDataValue>'
|| head || '/vrt/' || n_name || '.tif' || mid || k || '"' || tail || head || '/abs/' || n_name || '.tif' || mid || (2 * k) || '"' || tail || '</VRTRasterBand></VRTDataset>' AS xml FROM r""",
    "peak_lines": """SELECT CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey END AS osm_id, CASE WHEN p_partkey % 2 = 0 THEN p_name || ', the "old"' ELSE 'xa,b' || p_name END AS name, p_type AS type,
CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 3000 AS VARCHAR) END AS ele_osm, round(20e0 + (p_partkey * 7919 % 6000) / 100000e0, 6) AS plon, round(49e0 + (p_partkey * 104729 % 4000) / 100000e0, 6) AS plat FROM part WHERE p_partkey % 7 <> 0""",
    "vrt_leaf_files": "SELECT '/vrt/' || n_name || '.vrt' AS file, unnest(['/vrt/' || n_name || '.tif', '/abs/' || n_name || '.tif']) AS leaf FROM nation",
    "footprint_area": "SELECT '/vrt/' || n_name || '.vrt' AS file, CAST(2 AS BIGINT) AS parts, CAST(2 AS BIGINT) AS sources, round(2 * (100 + n_nationkey) * 25e0 * 50 * 25 / 1e6, 1) AS area_km2 FROM nation",
    "drift_check": "WITH n AS (SELECT n_name AS id, n_nationkey AS k FROM nation), m AS (SELECT id, k, list_filter([CASE WHEN k % 4 = 1 THEN 'resolution 10.6000' END, CASE WHEN k % 6 = 0 THEN 'crs Web' END, CASE WHEN k % 3 <> 0 AND k % 5 = 0 THEN 'nodata declared nowhere' WHEN k % 3 = 0 AND k % 5 <> 0 AND k % 2 <> 0 THEN 'nodata differs' END], lambda x: x IS NOT NULL) AS notes FROM n), r AS (SELECT id, CASE WHEN k % 7 = 6 THEN ['missing'] ELSE notes END AS notes FROM m) SELECT id, CASE WHEN len(notes) = 0 THEN 'ok' ELSE 'FAIL' END AS status, array_to_string(notes, '; ') AS notes FROM r",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
