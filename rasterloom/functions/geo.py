"""Geometry as column expressions: projection, affine grids, zones and
point-in-polygon against small literal polygons."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom import config as cfg

# WGS 84 ellipsoid and the UTM convention.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM_FALSE_EASTING = 500000.0

# Polygons with more edges than this are not inlined as literals; use
# operators.polygons.rasterize_polygon, which joins instead.
MAX_LITERAL_EDGES = 2000


def _series():
    """Krueger series of the transverse Mercator projection in the third
    flattening n (published formulas)."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    ]
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96,
        n**2 / 48 + n**3 / 15,
        17 * n**3 / 480,
    ]
    delta = [
        2 * n - 2 * n**2 / 3 - 2 * n**3,
        7 * n**2 / 3 - 8 * n**3 / 5,
        56 * n**3 / 15,
    ]
    return n, radius, alpha, beta, delta


def _central_meridian(zone: int) -> float:
    return math.radians(zone * 6 - 183)


def lonlat_to_utm(lon: Column, lat: Column, zone: int = cfg.UTM_ZONE) -> tuple[Column, Column]:
    """Northern-hemisphere UTM easting and northing in metres."""
    n, radius, alpha, _, _ = _series()
    e = 2 * math.sqrt(n) / (1 + n)
    phi = F.radians(lat)
    dlam = F.radians(lon) - F.lit(_central_meridian(zone))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    xi = F.atan2(t, F.cos(dlam))
    eta = F.atanh(F.sin(dlam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, start=1):
        east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    scale = F.lit(UTM_K0 * radius)
    return F.lit(UTM_FALSE_EASTING) + scale * east, scale * north


def conformal_sql(phi: str) -> str:
    """SQL of the tangent of the conformal latitude, as lonlat_to_utm takes it."""
    n = _series()[0]
    e = 2 * math.sqrt(n) / (1 + n)
    return f"sinh(atanh(sin({phi})) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin({phi})))"


def utm_sql() -> tuple[str, str]:
    """SQL of easting and northing from columns xi and eta."""
    _, radius, alpha, _, _ = _series()
    east = "eta" + "".join(f" + {a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    north = "xi" + "".join(f" + {a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    return f"{UTM_FALSE_EASTING!r}::DOUBLE + {UTM_K0 * radius!r}::DOUBLE * ({east})", f"{UTM_K0 * radius!r}::DOUBLE * ({north})"


def utm_to_lonlat(x: Column, y: Column, zone: int = cfg.UTM_ZONE) -> tuple[Column, Column]:
    _, radius, _, beta, delta = _series()
    scale = F.lit(UTM_K0 * radius)
    xi, eta = y / scale, (x - F.lit(UTM_FALSE_EASTING)) / scale
    xi0, eta0 = xi, eta
    for j, b in enumerate(beta, start=1):
        xi0 = xi0 - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    phi = chi
    for j, d in enumerate(delta, start=1):
        phi = phi + F.lit(d) * F.sin(2 * j * chi)
    lam = F.lit(_central_meridian(zone)) + F.atan2(F.sinh(eta0), F.cos(xi0))
    return F.degrees(lam), F.degrees(phi)


def pixel_center(row: Column, col: Column, affine: Sequence[float]) -> tuple[Column, Column]:
    """Map coordinates of a pixel centre; affine = (a, b, c, d, e, f)."""
    a, b, c, d, e, f = (F.lit(float(v)) for v in affine)
    cc, rr = col + F.lit(0.5), row + F.lit(0.5)
    return c + cc * a + rr * b, f + cc * d + rr * e


def pixel_of(x: Column, y: Column, affine: Sequence[float]) -> tuple[Column, Column]:
    """Row and column of the pixel containing a point, north-up grids."""
    a, _, c, _, e, f = affine
    row = F.floor((y - F.lit(float(f))) / F.lit(float(e))).cast("int")
    col = F.floor((x - F.lit(float(c))) / F.lit(float(a))).cast("int")
    return row, col


def pixel_area_ha(affine: Sequence[float]) -> float:
    a, b, _, d, e, _ = affine
    return abs(a * e - b * d) / 10000.0


def pixel_window(bounds, affine) -> tuple[int, int, int, int]:
    """Row and column range covering map bounds, rounded to the pixel grid:
    the offset is floored and the size rounded up."""
    xmin, ymin, xmax, ymax = bounds
    a, _, c, _, e, f = affine
    col0, row0 = math.floor((xmin - c) / a), math.floor((ymax - f) / e)
    width = math.ceil(round((xmax - xmin) / a, 9))
    height = math.ceil(round((ymin - ymax) / e, 9))
    return row0, row0 + height, col0, col0 + width


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def distance_to(x: Column, y: Column, cx: float, cy: float, cap: float | None = None) -> Column:
    """Distance to a fixed point; beyond the cap it is masked."""
    d = hypot(x - F.lit(float(cx)), y - F.lit(float(cy)))
    return d if cap is None else F.when(d <= F.lit(float(cap)), d)


def band_label(value: Column, edges: Sequence[float], open_end: bool = False) -> Column:
    """Half-open interval label 'lo-hi' for a value, NULL outside all bands."""
    bands = [(lo, hi) for lo, hi in zip(edges, edges[1:])]
    expr = None
    for lo, hi in bands:
        hit = (value >= F.lit(float(lo))) & (value < F.lit(float(hi)))
        label = F.lit(f"{lo}-{hi}")
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    if open_end:
        expr = expr.when(value >= F.lit(float(edges[-1])), F.lit(f"{edges[-1]}-inf"))
    return expr


def band_labels(edges: Sequence[float], open_end: bool = False) -> list[str]:
    labels = [f"{lo}-{hi}" for lo, hi in zip(edges, edges[1:])]
    return labels + ([f"{edges[-1]}-inf"] if open_end else [])


def compass_sector(dx: Column, dy: Column) -> Column:
    """0 = N, clockwise, eight 45-degree sectors centred on the directions."""
    turned = F.pmod(F.degrees(F.atan2(dx, dy)) + F.lit(22.5), F.lit(360.0))
    return F.floor(turned / F.lit(45.0)).cast("int")


def bearing_rows(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Bearing 0-180 from north for image coordinates (y grows southwards)."""
    return F.pmod(F.degrees(F.atan2(x2 - x1, -(y2 - y1))), F.lit(180.0))


def angular_difference(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, F.lit(180.0) - d)


def polygon_edges(rings: Sequence[Sequence[tuple[float, float]]]) -> list[tuple]:
    """Edges of all rings (outer and holes); rings are closed if needed."""
    edges = []
    for ring in rings:
        pts = [tuple(map(float, p)) for p in ring]
        if pts[0] != pts[-1]:
            pts.append(pts[0])
        edges += [(*p, *q) for p, q in zip(pts, pts[1:])]
    return edges


def literal_edges(rings) -> Column:
    edges = polygon_edges(rings)
    if len(edges) > MAX_LITERAL_EDGES:
        raise ValueError(
            f"{len(edges)} edges exceed the literal limit of {MAX_LITERAL_EDGES}; "
            "use rasterize_polygon"
        )
    names = ("x1", "y1", "x2", "y2")
    return F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, edge)]) for edge in edges
    ])


def is_inside(x: Column, y: Column, rings) -> Column:
    """Even-odd ray cast towards +x over literal edges. Axis-parallel edges
    and a handful of edges compile to plain arithmetic; larger polygons fold
    an array literal."""
    edges = polygon_edges(rings)
    if len(edges) <= 64:
        crossings = F.lit(0)
        for x1, y1, x2, y2 in edges:
            if y1 == y2:
                continue
            spans = (F.lit(y1) > y) != (F.lit(y2) > y)
            at = F.lit(x1) + (y - F.lit(y1)) * F.lit((x2 - x1) / (y2 - y1))
            crossings = crossings + F.when(spans & (x < at), 1).otherwise(0)
        return crossings % 2 == 1
    def crosses(e):
        spans = (e["y1"] > y) != (e["y2"] > y)
        slope = (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
        return F.when(spans & (x < e["x1"] + (y - e["y1"]) * slope), 1).otherwise(0)
    total = F.aggregate(literal_edges(rings), F.lit(0), lambda acc, e: acc + crosses(e))
    return total % 2 == 1


def segment_distance(px: Column, py: Column, x1, y1, x2, y2) -> Column:
    """Distance from a point to a line segment."""
    dx, dy = x2 - x1, y2 - y1
    norm = F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.coalesce(((px - x1) * dx + (py - y1) * dy) / norm, F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def in_box(x: Column, y: Column, cx: float, cy: float, half: float) -> Column:
    """Inside the bounding box of a point buffered by `half`."""
    return x.between(cx - half, cx + half) & y.between(cy - half, cy + half)
