"""Rasters as long cell tables, buffers, hulls, boxes and coordinate checks."""

from __future__ import annotations

from collections.abc import Iterator
from math import asin, atan2, cos, degrees, pi, radians, sin
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.operators.nearby import EARTH_M, haversine_m, polygon_edges

if TYPE_CHECKING:
    import pandas as pd


def cell_of(lon: Column, lat: Column, grid: dict[str, float]) -> tuple[Column, Column]:
    """(row, col) of a point, counted from the grid's top left edge; null outside the grid or without coordinates.

    ``grid`` has xmin, ymax, dx, dy, nrow and ncol. A point on an edge belongs to the cell right of or below it.
    """
    col = F.floor((lon - grid["xmin"]) / grid["dx"])
    row = F.floor((grid["ymax"] - lat) / grid["dy"])
    ok = row.between(0, grid["nrow"] - 1) & col.between(0, grid["ncol"] - 1)
    return F.when(ok, row.cast("int")), F.when(ok, col.cast("int"))


def raster_values(points: DataFrame, lon: str, lat: str, layer: Column, raster: DataFrame, grid: dict[str, float], name: str) -> DataFrame:
    """``points`` with the value of their cell in their layer: an equi-join on (layer_key, row, col).

    ``raster`` is long: layer_key, row, col, value. Points outside or in a layer that is absent get null.
    Distinct cells are looked up once.
    """
    row, col = cell_of(F.col(lon), F.col(lat), grid)
    p = points.withColumns({"__row": row, "__col": col, "__layer": layer})
    cells = p.select("__layer", "__row", "__col").where(F.col("__row").isNotNull() & F.col("__col").isNotNull()).distinct()
    r = raster.select(F.col("layer_key").alias("__layer"), F.col("row").alias("__row"), F.col("col").alias("__col"), F.col("value").alias(name))
    found = cells.join(r, ["__layer", "__row", "__col"])
    return p.join(found, ["__layer", "__row", "__col"], "left").drop("__layer", "__row", "__col")


def resample(raster: DataFrame, factor: int) -> DataFrame:
    """A coarser grid: mean of the non-null cells of each block of factor by factor."""
    r = raster.withColumns({"row": F.floor(F.col("row") / factor).cast("int"), "col": F.floor(F.col("col") / factor).cast("int")})
    return r.groupBy("layer_key", "row", "col").agg(F.avg("value").alias("value"))


def buffered_mean(points: DataFrame, id_col: str, lon: str, lat: str, raster: DataFrame, grid: dict[str, float], cells: int) -> DataFrame:
    """(id, layer_key, value): mean of the cells at most so many rows and columns away."""
    row, col = cell_of(F.col(lon), F.col(lat), grid)
    steps = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in range(-cells, cells + 1) for j in range(-cells, cells + 1)])
    p = points.select(id_col, row.alias("r"), col.alias("c")).where("r IS NOT NULL AND c IS NOT NULL").select(id_col, "r", "c", F.inline(steps))
    p = p.select(id_col, (F.col("r") + F.col("di")).alias("row"), (F.col("c") + F.col("dj")).alias("col"))
    return p.join(raster, ["row", "col"]).groupBy(id_col, "layer_key").agg(F.avg("value").alias("value"))


def bounding_box(df: DataFrame, keys: list[str], lon: str, lat: str, margin: float, fallback: tuple[float, float, float, float]) -> DataFrame:
    """(keys, xmin, xmax, ymin, ymax) with a margin in degrees; the fallback box where a group has no coordinates."""
    g = df.groupBy(*keys).agg(F.min(lon).alias("a"), F.max(lon).alias("b"), F.min(lat).alias("c"), F.max(lat).alias("d"))
    ends = (("a", -margin, "xmin", 0), ("b", margin, "xmax", 1), ("c", -margin, "ymin", 2), ("d", margin, "ymax", 3))
    return g.select(*keys, *[F.coalesce(F.col(x) + m, F.lit(fallback[i])).alias(n) for x, m, n, i in ends])


def ring_around(lon: float, lat: float, metres: float, sides: int = 64) -> tuple[list[float], list[float]]:
    """Closed ring of points at a distance from a centre on the sphere."""
    d, y, x = metres / EARTH_M, radians(lat), radians(lon)
    xs, ys = [], []
    for i in range(sides):
        b = 2 * pi * i / sides
        y2 = asin(sin(y) * cos(d) + cos(y) * sin(d) * cos(b))
        xs.append(degrees(x + atan2(sin(b) * sin(d) * cos(y), cos(d) - sin(y) * sin(y2))))
        ys.append(degrees(y2))
    return [*xs, xs[0]], [*ys, ys[0]]


def buffers(points: DataFrame, id_col: str, lon: str, lat: str, metres: float, sides: int = 64) -> DataFrame:
    """(id, lons, lats): a ring around each point, null coordinates left out; batches in Arrow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for b in batches:
            rings = [ring_around(x, y, metres, sides) for x, y in zip(b[lon], b[lat])]
            yield pd.DataFrame({id_col: b[id_col], "lons": [r[0] for r in rings], "lats": [r[1] for r in rings]})

    p = points.select(id_col, lon, lat).where(F.col(lon).isNotNull() & F.col(lat).isNotNull() & ~F.isnan(lon) & ~F.isnan(lat))
    return p.mapInPandas(run, f"`{id_col}` {dict(points.dtypes)[id_col]}, lons array<double>, lats array<double>")


BRANCHES = 16


def _hull(pts: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull by monotone chains, counter-clockwise, not closed."""
    pts = sorted(set(pts))
    if len(pts) < 3:
        return pts

    def half(seq: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def convex_hulls(points: DataFrame, key: str, lon: str, lat: str) -> DataFrame:
    """(key, lons, lats, n_corners): closed convex hull of each group.

    Only extreme points can be corners: each partition first reduces its groups to partial hulls, partial hulls are folded
    in BRANCHES tasks for each group, and only those meet for a group. Groups of one or two places give those places.
    """
    schema = f"`{key}` {dict(points.dtypes)[key]}, xs array<double>, ys array<double>"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        held: dict = {}
        for b in batches:
            for k, g in b.groupby(key, dropna=False):
                held[k] = _hull(held.get(k, []) + list(zip(g[lon], g[lat])))
        yield pd.DataFrame({key: list(held), "xs": [[p[0] for p in h] for h in held.values()], "ys": [[p[1] for p in h] for h in held.values()]})

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        h = _hull([p for xs, ys in zip(pdf["xs"], pdf["ys"]) for p in zip(xs, ys)])
        return pd.DataFrame({key: [pdf[key].iloc[0]], "xs": [[p[0] for p in h]], "ys": [[p[1] for p in h]]})

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        h = _hull([p for xs, ys in zip(pdf["xs"], pdf["ys"]) for p in zip(xs, ys)])
        ring = [*h, h[0]]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "lons": [[p[0] for p in ring]], "lats": [[p[1] for p in ring]], "n_corners": [len(h)]})

    ok = points.select(key, lon, lat).where(F.col(key).isNotNull() & F.col(lon).isNotNull() & F.col(lat).isNotNull() & ~F.isnan(lon) & ~F.isnan(lat))
    parts = ok.mapInPandas(partial, schema).groupBy(key, F.pmod(F.xxhash64("xs", "ys"), F.lit(BRANCHES))).applyInPandas(fold, schema)
    return parts.groupBy(key).applyInPandas(final, f"`{key}` {dict(points.dtypes)[key]}, lons array<double>, lats array<double>, n_corners int")


def looks_swapped(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Outside the box as they stand, inside if exchanged; never null."""
    w, e, s, n = box
    inside = lambda x, y: F.coalesce(x.between(w, e) & y.between(s, n), F.lit(False))
    return ~inside(lon, lat) & inside(lat, lon)


def _clip(ring: list[tuple[float, float]], convex: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Part of a ring inside a convex ring, both not closed; the convex one runs counter-clockwise."""
    out = ring
    for i, (ax, ay) in enumerate(convex):
        bx, by = convex[(i + 1) % len(convex)]
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: E731, B023
        kept = []
        for j, p in enumerate(out):
            q = out[(j + 1) % len(out)]
            s, t = side(p), side(q)
            if s >= 0:
                kept.append(p)
            if (s > 0 > t) or (s < 0 < t):
                f = s / (s - t)
                kept.append((p[0] + f * (q[0] - p[0]), p[1] + f * (q[1] - p[1])))
        out = kept
        if not out:
            break
    return out


def clip_rings(rings: DataFrame, lons: str, lats: str, convex: list[tuple[float, float]]) -> DataFrame:
    """``rings`` cut to a convex region (counter-clockwise corners); rings wholly outside are left out.

    Holes are cut like the pieces they belong to, so even-odd counting holds on the result.
    """
    columns = rings.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cut = [_clip(list(zip(x, y))[:-1], convex) for x, y in zip(b[lons], b[lats])]
            b = b.assign(**{lons: [[p[0] for p in [*c, *c[:1]]] for c in cut], lats: [[p[1] for p in [*c, *c[:1]]] for c in cut]})
            yield b[[len(c) >= 3 for c in cut]][columns]

    return rings.mapInPandas(run, rings.schema)


def ring_area(lons: str, lats: str) -> Column:
    """Area in square degrees of a closed ring."""
    x, y = (lambda i: F.get(F.col(lons), i)), (lambda i: F.get(F.col(lats), i))
    parts = F.transform(F.sequence(F.lit(0), F.size(lons) - 2), lambda i: x(i) * y(i + 1) - x(i + 1) * y(i))
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)) / 2


def buffer_cover(points: DataFrame, key: str, lon: str, lat: str, metres: float, cell: float) -> DataFrame:
    """(key, row, col): the union of the circles around a group's points, as the grid cells whose centre they cover.

    Cells are counted from 0 degrees. Points of the same cell look at the same candidates, and cells are made distinct with
    partial sums before the shuffle, so a group with many points costs no more than the area that it covers.
    """
    p = points.select(key, lon, lat).where(F.col(lon).isNotNull() & F.col(lat).isNotNull() & ~F.isnan(lon) & ~F.isnan(lat)).distinct()
    dy = metres / (EARTH_M * radians(1))
    r = lambda c, d: F.sequence(F.floor((c - d) / cell), F.floor((c + d) / cell))
    p = p.select("*", F.explode(r(F.col(lat), F.lit(dy))).alias("row"))
    p = p.select("*", F.explode(r(F.col(lon), F.lit(dy) / F.cos(F.radians(F.abs(F.col(lat)) + dy)))).alias("col"))
    near = haversine_m(F.col(lon), F.col(lat), (F.col("col") + 0.5) * cell, (F.col("row") + 0.5) * cell) <= metres
    return p.where(near).select(key, "row", "col").distinct()


# The conic equal-area projection of the continent (standard parallels, origin, and the ellipsoid's axis and squared eccentricity).
ALBERS = {"lat1": -18.0, "lat2": -36.0, "lat0": 0.0, "lon0": 132.0, "a": 6_378_137.0, "e2": 0.00669438002290}


def _conic(p: dict[str, float]) -> tuple:
    from math import log

    e = p["e2"] ** 0.5
    q = lambda f: (1 - p["e2"]) * (sin(f) / (1 - p["e2"] * sin(f) ** 2) - 1 / (2 * e) * log((1 - e * sin(f)) / (1 + e * sin(f))))
    m = lambda f: cos(f) / (1 - p["e2"] * sin(f) ** 2) ** 0.5
    f1, f2 = radians(p["lat1"]), radians(p["lat2"])
    n = (m(f1) ** 2 - m(f2) ** 2) / (q(f2) - q(f1))
    c = m(f1) ** 2 + n * q(f1)
    return q, n, c, p["a"] * (c - n * q(radians(p["lat0"]))) ** 0.5 / n


def to_albers(lon: float, lat: float, p: dict[str, float] = ALBERS) -> tuple[float, float]:
    """Metres east and north of the origin in an equal-area conic projection of the ellipsoid."""
    q, n, c, rho0 = _conic(p)
    rho, t = p["a"] * (c - n * q(radians(lat))) ** 0.5 / n, n * radians(lon - p["lon0"])
    return rho * sin(t), rho0 - rho * cos(t)


def from_albers(x: float, y: float, p: dict[str, float] = ALBERS) -> tuple[float, float]:
    """Degrees of a place in metres; the latitude by Newton's method."""
    from math import hypot

    q, n, c, rho0 = _conic(p)
    sign = 1 if n > 0 else -1
    rho, t = hypot(x, rho0 - y) * sign, atan2(sign * x, sign * (rho0 - y))
    want = (c - (rho * n / p["a"]) ** 2) / n
    f = asin(max(-1.0, min(1.0, want / 2)))
    for _ in range(12):
        s = p["e2"] * sin(f) ** 2
        f += (1 - s) ** 2 / (2 * cos(f)) * (want - q(f)) / (1 - p["e2"])
    return p["lon0"] + degrees(t / n), degrees(f)


def _widened(hull: list[tuple[float, float]], metres: float, sides: int) -> list[tuple[float, float]]:
    """Corners of the places at most so far from a convex polygon (counter-clockwise): its edges moved outwards, with arcs of ``sides`` a circle at the corners."""
    if len(hull) == 1:
        return [(hull[0][0] + metres * cos(2 * pi * i / sides), hull[0][1] + metres * sin(2 * pi * i / sides)) for i in range(sides)]
    out = []
    for i, (x, y) in enumerate(hull):
        (x0, y0), (x1, y1) = hull[i - 1], hull[(i + 1) % len(hull)]
        a, b = atan2(-(x - x0), y - y0), atan2(-(x1 - x), y1 - y)  # outwards is to the right of the way
        turn = (b - a) % (2 * pi)
        k = max(1, int(turn / (2 * pi) * sides))
        out += [(x + metres * cos(a + turn * j / k), y + metres * sin(a + turn * j / k)) for j in range(k + 1)]
    return out


def hull_buffers(points: DataFrame, key: str, lon: str, lat: str, metres: float, *, sides: int = 64, projection: dict[str, float] = ALBERS) -> DataFrame:
    """(key, lons, lats, area_km2, centre_lon, centre_lat): the convex hull of each group widened by a distance, in an equal-area projection.

    The centre is that of the area. Built from the corners of the hull alone, see convex_hulls.
    """
    kind = dict(points.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for b in batches:
            rows = []
            for k, xs, ys in zip(b[key], b["lons"], b["lats"]):
                ring = _widened(_hull([to_albers(x, y, projection) for x, y in zip(xs, ys)]), metres, sides)
                ox, oy = ring[0]  # areas from a corner, not from the far origin
                cross = [((a[0] - ox) * (c[1] - oy) - (c[0] - ox) * (a[1] - oy), a, c) for a, c in zip(ring, ring[1:] + ring[:1])]
                twice = sum(x[0] for x in cross)
                centre = from_albers(ox + sum(w * (a[0] + c[0] - 2 * ox) for w, a, c in cross) / (3 * twice), oy + sum(w * (a[1] + c[1] - 2 * oy) for w, a, c in cross) / (3 * twice), projection)
                back = [from_albers(x, y, projection) for x, y in [*ring, ring[0]]]
                rows.append((k, [p[0] for p in back], [p[1] for p in back], twice / 2e6, *centre))
            yield pd.DataFrame(rows, columns=[key, "lons", "lats", "area_km2", "centre_lon", "centre_lat"])

    return convex_hulls(points, key, lon, lat).mapInPandas(run, f"`{key}` {kind}, lons array<double>, lats array<double>, area_km2 double, centre_lon double, centre_lat double")


def polygon_cells(rings: DataFrame, region: str, piece: str, cell: float, lons: str = "lons", lats: str = "lats") -> DataFrame:
    """(region, row, col): the grid cells, counted from 0 degrees, whose centre a region's polygons hold; holes are left out.

    Row by row: the crossings of a piece's edges with the middle of a row, in order, bound the runs of cells between them. What meets
    for a row is its crossings; a region's cells are as many as its area has.
    """
    e = polygon_edges(rings, region, piece, lons, lats)
    lo, hi = F.ceil(F.least("y1", "y2") / cell - 0.5), F.ceil(F.greatest("y1", "y2") / cell - 0.5) - 1
    e = e.where(lo <= hi).select("*", F.explode(F.sequence(lo, hi)).alias("row"))
    at = F.col("x1") + ((F.col("row") + 0.5) * cell - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    runs = e.select("region", "piece", "row", at.alias("x")).groupBy("region", "piece", "row").agg(F.array_sort(F.collect_list("x")).alias("_x"))
    pair = F.explode(F.sequence(F.lit(0), F.size("_x") - 2, F.lit(2))).alias("_i")
    runs = runs.where(F.size("_x") > 1).select("region", "row", pair, "_x").select("region", "row", F.ceil(F.get("_x", F.col("_i")) / cell - 0.5).alias("a"), (F.ceil(F.get("_x", F.col("_i") + 1) / cell - 0.5) - 1).alias("b"))
    return runs.where("a <= b").select(F.col("region").alias(region), "row", F.explode(F.sequence("a", "b")).alias("col")).distinct()


def overlay(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Cells (row, col) of two layers: 'intersection' with the other columns of both, 'union' of the bare cells, or 'difference', those of ``a`` that ``b`` lacks."""
    if how == "intersection":
        return a.join(b, ["row", "col"])
    if how == "union":
        return a.select("row", "col").unionByName(b.select("row", "col")).distinct()
    if how == "difference":
        return a.join(b.select("row", "col").distinct(), ["row", "col"], "left_anti")
    raise ValueError(f"unknown overlay {how}")
