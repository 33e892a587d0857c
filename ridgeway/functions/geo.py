"""Grid, geodesy and codec formulas as Column expressions.

Two radii are kept apart on purpose: the Web-Mercator sphere for the grid, the mean Earth sphere for distances and
bearings.  Nothing here leaves whole-stage code generation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the data model
MERCATOR_RADIUS = 6378137.0
EARTH_RADIUS = 6371000.0
REFRACTION = 0.13
CELL_PER_METRE = 0.00087
DEPTH_NEAR, DEPTH_SPAN = 10.0, math.log(40000.0)
PROFILE_BINS = 256
LIMIT_LATITUDE = 85.05112878
ORIGIN = math.pi * MERCATOR_RADIUS


@dataclass(frozen=True)
class Grid:
    """The pyramid's fixed layout."""

    tile_px: int = 32768
    block_px: int = 512
    finest: int = 14
    coarsest: int = 8

    @property
    def span(self) -> float:
        """Metres a tile covers."""
        return self.tile_px * resolution(self.finest)

    @property
    def across(self) -> int:
        return round(2 * ORIGIN / self.span)


def resolution(level: int) -> float:
    """Projected metres per pixel, on the driver."""
    return 2 * math.pi * MERCATOR_RADIUS / 256.0 / 2.0**level


def num(x: float) -> Column:
    return F.lit(float(x))


def snap(x: Column | str, digits: int) -> Column:
    """``x`` at so many decimals, halves away from 0: ``F.round`` goes through a decimal number for each row, which is many times slower."""
    x = F.col(x) if isinstance(x, str) else x
    return F.rint(x * num(10.0**digits * (1 + 2.0**-52))) / num(10.0**digits)


def level_res(level: Column) -> Column:
    return num(2 * math.pi * MERCATOR_RADIUS / 256.0) / F.pow(num(2), level)


def ground_res(level: Column, lat: Column) -> Column:
    return level_res(level) * F.cos(F.radians(lat))


def tile_px_at(grid: Grid, level: Column) -> Column:
    """Pixels along a tile's side at a level; outside the pyramid it raises."""
    inside = level.between(grid.coarsest, grid.finest)
    px = F.expr(f"cast({grid.tile_px} as int)")
    return F.when(inside, (px / F.pow(num(2), grid.finest - level)).cast("int")).otherwise(F.raise_error(F.lit("level outside the pyramid")).cast("int"))


def tile_extent(grid: Grid, tx: Column, ty: Column) -> dict[str, Column]:
    span = num(grid.span)
    return {"x0": num(-ORIGIN) + tx * span, "y0": num(ORIGIN) - (ty + 1) * span, "x1": num(-ORIGIN) + (tx + 1) * span, "y1": num(ORIGIN) - ty * span}


def merc_x(lon: Column) -> Column:
    return lon / 180.0 * num(ORIGIN)


def merc_y(lat: Column) -> Column:
    return F.log(F.tan(num(math.pi / 4) + F.radians(lat) / 2.0)) * num(MERCATOR_RADIUS)


def lon_of(x: Column) -> Column:
    return x / num(ORIGIN) * 180.0


def lat_of(y: Column) -> Column:
    return F.degrees(2.0 * F.atan(F.exp(y / num(MERCATOR_RADIUS))) - num(math.pi / 2))


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2.0), num(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2.0), num(2))
    return num(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.least(a, num(1))))


def initial_bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))), num(360))


def destination(lon: Column, lat: Column, azimuth: Column, d: Column) -> tuple[Column, Column]:
    """(lon, lat) a distance away on a bearing; the longitude isn't wrapped."""
    p1, t, r = F.radians(lat), F.radians(azimuth), d / num(EARTH_RADIUS)
    s2 = F.sin(p1) * F.cos(r) + F.cos(p1) * F.sin(r) * F.cos(t)
    dl = F.atan2(F.sin(t) * F.sin(r) * F.cos(p1), F.cos(r) - F.sin(p1) * s2)
    return lon + F.degrees(dl), F.degrees(F.asin(s2))


def curvature_drop(d: Column) -> Column:
    return d * d * num(1 - REFRACTION) / num(2 * EARTH_RADIUS)


def level_for(d: Column, lat: Column, grid: Grid) -> Column:
    """The coarsest level whose cells are fine enough at a distance, else the finest."""
    out = None
    for z in range(grid.coarsest, grid.finest):
        ok = ground_res(F.lit(z), lat) <= d * num(CELL_PER_METRE)
        out = F.when(ok, z) if out is None else out.when(ok, z)
    return (out.otherwise(grid.finest) if out is not None else F.lit(grid.finest)).cast("int")


# --- codecs --------------------------------------------------------------------------------------------------------------


def elevation(code: Column) -> Column:
    """Metres of a raster code; 0 means no data."""
    return F.when(code != 0, code * num(0.1) - 500.0)


def elevation_code(metres: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(65535), F.round((metres + 500.0) * 10.0))).cast("int")


def _log_share(d: Column) -> Column:
    return F.greatest(num(0), F.least(num(1), F.log(F.greatest(d, num(DEPTH_NEAR)) / num(DEPTH_NEAR)) / num(DEPTH_SPAN)))


def encode_depth(d: Column) -> Column:
    """Logarithmic 16-bit code from 10 m to 400 km; null, NaN and infinity are sky, 0."""
    sky = d.isNull() | F.isnan(d) | (d == float("inf"))
    return F.when(sky, 0).otherwise(1 + F.round(_log_share(d) * 65534.0).cast("int"))


def decode_depth(code: Column) -> Column:
    return F.when(code != 0, F.exp(num(math.log(DEPTH_NEAR)) + (code - 1) / num(65534) * num(DEPTH_SPAN)))


def quantise_depth(code: Column, step: Column) -> Column:
    low = F.greatest(step, F.lit(1))
    return F.when(code == 0, 0).otherwise(1 + F.floor((code - 1) / low).cast("int") * low)


def depth_error_percent(step: Column) -> Column:
    return step * num(100 * DEPTH_SPAN / 65534)


def profile_bin(d: Column) -> Column:
    return F.floor(_log_share(d) * (PROFILE_BINS - 1)).cast("int")


def delta16(q: Column, before: Column) -> Column:
    return (q - before + 32768).bitwiseAND(F.lit(65535)) - 32768


# fixed values: sky, haze and dither
# --- colours -------------------------------------------------------------------------------------------------------------

SKY_LOW, SKY_HIGH = (196.0, 216.0, 238.0), (110.0, 156.0, 214.0)
HAZE = 45000.0


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def sky_colour(alt: Column) -> list[Column]:
    t = F.greatest(num(0), F.least(num(1), alt / 30.0))
    return [lerp(num(a), num(b), t) for a, b in zip(SKY_LOW, SKY_HIGH)]


def dither(x: Column, y: Column) -> Column:
    """Triangular noise in [-1, 1]: the difference of two interleaved gradients."""
    def noise(u: Column, v: Column) -> Column:
        inner = u * 0.06711056 + v * 0.00583715
        outer = 52.9829189 * (inner - F.floor(inner))
        return outer - F.floor(outer)

    return noise(x.cast("double"), y.cast("double")) - noise(y * 1.7 + 11.0, x * 0.9 + 23.0)


def channel(v: Column, x: Column, y: Column, strength: float) -> Column:
    return F.round(F.greatest(num(0), F.least(num(255), v + dither(x, y) * strength))).cast("int")


def compass(azimuth: Column) -> Column:
    names = F.array(*map(F.lit, ("N", "NE", "E", "SE", "S", "SW", "W", "NW")))
    return F.element_at(names, (F.pmod(F.round(azimuth / 45.0), num(8)) + 1).cast("int"))


def parse_colour(text: Column) -> dict[str, Column]:
    """r, g, b of ``#rgb`` or ``#rrggbb`` (any number of leading #), null where it is neither."""
    hexa = F.regexp_replace(F.trim(text), "^#+", "")
    hexa = F.when(hexa.rlike("^[0-9a-fA-F]{3}$"), F.regexp_replace(hexa, "(.)", "$1$1")).when(hexa.rlike("^[0-9a-fA-F]{6}$"), hexa)
    return {c: F.conv(F.substring(hexa, 2 * i + 1, 2), 16, 10).cast("int") for i, c in enumerate("rgb")}


# --- areas and outlines ---------------------------------------------------------------------------------------------------


def bbox_area_km2(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    return num(6371.0**2) * F.radians(lon1 - lon0) * F.abs(F.sin(F.radians(lat1)) - F.sin(F.radians(lat0)))


def bbox_wkt(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    text = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    a, b, c, d = map(text, (lon0, lat0, lon1, lat1))
    return F.concat(F.lit("POLYGON (("), F.array_join(F.array(*(F.concat(x, F.lit(" "), y) for x, y in ((a, b), (c, b), (c, d), (a, d), (a, b)))), ","), F.lit("))"))


def rect_corners(gt: list[Column], rect: list[Column]) -> tuple[Column, Column, Column, Column]:
    """Two opposite corners (x0, y0, x1, y1) of a pixel rectangle under an affine transform."""
    at = lambda x, y: (gt[0] + x * gt[1] + y * gt[2], gt[3] + x * gt[4] + y * gt[5])
    return *at(rect[0], rect[1]), *at(rect[0] + rect[2], rect[1] + rect[3])


def rect_area(gt: list[Column], rect: list[Column]) -> Column:
    x0, y0, x1, y1 = rect_corners(gt, rect)
    return F.abs((x1 - x0) * (y1 - y0))


def rect_wkt(gt: list[Column], rect: list[Column], segment: Column) -> Column:
    """The rectangle's outline; with ``segment`` all sides are cut alike, so that no piece of the longest exceeds 5000 units."""
    x0, y0, x1, y1 = rect_corners(gt, rect)
    longest = F.greatest(F.abs(x1 - x0), F.abs(y1 - y0))
    n = F.when(segment, F.greatest(F.lit(1), F.ceil(longest / 5000.0).cast("int"))).otherwise(1)
    sides = [((x0, y0), (x1, y0)), ((x1, y0), (x1, y1)), ((x1, y1), (x0, y1)), ((x0, y1), (x0, y0))]

    def points_of(a: tuple, b: tuple) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.format_string("%.4f %.4f", a[0] + (b[0] - a[0]) * i / n, a[1] + (b[1] - a[1]) * i / n))

    points = [points_of(a, b) for a, b in sides]
    close = F.array(F.format_string("%.4f %.4f", x0, y0))
    return F.concat(F.lit("POLYGON (("), F.array_join(F.concat(*points, close), ","), F.lit("))"))


# --- text helpers ----------------------------------------------------------------------------------------------------------


def shell_quote(s: Column) -> Column:
    safe = s.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$")
    return F.when(safe, s).otherwise(F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def content_type(name: Column) -> Column:
    ext = F.substring_index(name, ".", -1)
    return F.when(ext == "avif", "image/avif").when(ext == "png", "image/png").when(ext == "gz", "application/gzip").otherwise("application/octet-stream")


def priority_of(header: Column) -> Column:
    text = F.trim(header)
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]{1,9}$"), text).cast("int"), F.lit(0))


def normalised_crs(proj4: Column) -> Column:
    """Sorted PROJ.4 terms without those that don't alter the reference system."""
    terms = F.filter(F.split(F.trim(proj4), r"\s+"), lambda t: ~t.isin("+no_defs", "+type=crs", "+wktext", ""))
    return F.array_join(F.array_sort(terms), " ")


def crs_matches(epsg_a: Column, epsg_b: Column, proj_a: Column, proj_b: Column) -> Column:
    return F.coalesce(epsg_a == epsg_b, F.lit(False)) | F.coalesce(normalised_crs(proj_a) == normalised_crs(proj_b), F.lit(False))


def nodata_text(v: Column) -> Column:
    """A value's shortest decimal form, with an exponent from a million up; null is ``none``."""
    plain = F.regexp_replace(v.cast("string"), r"\.0$", "")
    digits = F.regexp_replace(F.regexp_replace(v.cast("string"), r"\.0E", "E"), "E", "e")  # doubles turn to exponents from 1e7 up
    million = F.concat(F.regexp_replace(F.regexp_replace((v / 1e6).cast("string"), r"\.0$", ""), "E.*", ""), F.lit("e6"))
    small = lambda i: F.regexp_extract(v.cast("string"), r"^(-?)(\d)\.(\d+)E-(\d+)$", i)  # noqa: E731  exponents below a thousandth
    tiny = F.concat(small(1), F.lit("0."), F.repeat(F.lit("0"), small(4).try_cast("int") - 1), small(2), F.regexp_replace(small(3), "^0$", ""))
    return F.when(v.isNull(), "none").when((F.abs(v) < 1e-3) & (v != 0), tiny).when(F.abs(v) >= 1e7, digits).when(F.abs(v) >= 1e6, million).otherwise(plain)


# --- visibility --------------------------------------------------------------------------------------------------------------


def opacity(tangent: Column, d: Column, h: Column, d_before: Column, h_before: Column) -> Column:
    """How squarely the ground faces the eye, 1..255; without an earlier sample 255."""
    run = d - d_before
    turn = F.abs(F.atan((h - h_before) / run) - F.atan(tangent))
    share = F.greatest(num(0), F.least(num(1), F.sin(F.least(turn, num(math.pi) - turn))))
    return F.when(run > 0, F.round(snap(share * 254.0, 7)).cast("int") + 1).otherwise(255)


def bracket(position: Column, rays: Column, wraps: Column) -> Column:
    """The two rays beside a sub-column position: array of (slot, ray); rays outside the frame are null."""
    low = F.floor(position - 0.5).cast("int")
    slot = lambda k, s: F.struct(F.lit(s).alias("slot"), F.when(wraps, F.pmod(k, rays)).when(k.between(0, rays - 1), k).alias("ray"))
    return F.array(slot(low, 0), slot(low + 1, 1))


def bracket_weight(position: Column) -> Column:
    return position - 0.5 - F.floor(position - 0.5)


def dominance_window(distance: Column, step: float, radius: float = 3000.0) -> Column:
    return F.round(F.greatest(num(1), F.least(num(20), F.degrees(F.atan(F.coalesce(F.try_divide(num(radius), distance), num(1e300)))))) / step).cast("int")
