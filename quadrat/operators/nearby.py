"""Points near other points, and the region around a point, by binned equi-joins."""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in metres on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """True where both coordinates are numbers within (west, east, south, north); never null."""
    w, e, s, n = box
    return F.coalesce(lon.between(w, e) & lat.between(s, n) & ~F.isnan(lon) & ~F.isnan(lat), F.lit(False))


def _placed(points: DataFrame, id_col: str, lon: str, lat: str, box: tuple[float, float, float, float]) -> DataFrame:
    return points.where(in_box(F.col(lon), F.col(lat), box)).select(F.col(id_col).alias("id"), F.col(lon).alias("x"), F.col(lat).alias("y")).distinct()


def _met(places: DataFrame, metres: float, box: tuple[float, float, float, float]) -> DataFrame:
    """(x1, y1, x2, y2, distance_m): pairs of different places at most so far apart.

    Places meet in a grid whose cells are as wide as the
    distance at the box's worst latitude: a place looks into its own cell and four of its eight
    neighbours, so each pair of cells is met once.
    """
    dlat = metres / (EARTH_M * radians(1)) * 1.000001
    dlon = dlat / cos(radians(max(abs(box[2]), abs(box[3]))))
    cells = places.select("x", "y", F.floor(F.col("x") / dlon).alias("cx"), F.floor(F.col("y") / dlat).alias("cy"))
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])
    look = cells.select(F.col("x").alias("x1"), F.col("y").alias("y1"), "cx", "cy", F.inline(offsets)).select("x1", "y1", "i", "j", (F.col("cx") + F.col("i")).alias("cx"), (F.col("cy") + F.col("j")).alias("cy"))
    b = cells.select(F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy")
    d = haversine_m(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    own = (F.col("i") == 0) & (F.col("j") == 0)
    return look.join(b, ["cx", "cy"]).where(~own | (F.struct("x1", "y1") < F.struct("x2", "y2"))).where(d <= metres).select("x1", "y1", "x2", "y2", d.alias("distance_m"))


def near_places(points: DataFrame, id_col: str, lon: str, lat: str, metres: float, box: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (first_place, second_place, distance_m) of different places at most ``metres`` apart, and the place of each id (id, place_id).

    A place is a coordinate, named by the smallest id that is at it. However many ids share one, a place is one row
    of the pairs: nothing is expanded. Points outside ``box`` or without coordinates are in neither.
    """
    p = _placed(points, id_col, lon, lat, box)
    places = p.groupBy("x", "y").agg(F.min("id").alias("place_id"))
    members = p.join(places, ["x", "y"]).select(F.col("id").alias(id_col), "place_id")
    name = lambda n: places.select(F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"), F.col("place_id").alias(f"p{n}"))
    met = _met(places, metres, box).join(name(1), ["x1", "y1"]).join(name(2), ["x2", "y2"])
    return met.select(F.least("p1", "p2").alias("first_place"), F.greatest("p1", "p2").alias("second_place"), "distance_m"), members


def near_pairs(points: DataFrame, id_col: str, lon: str, lat: str, metres: float, box: tuple[float, float, float, float]) -> DataFrame:
    """Pairs (first_id < second_id, distance_m) of points at most ``metres`` apart.

    Points outside ``box`` or without coordinates have no partner. Equal coordinates are first
    gathered into one place (copies join as one) and places meet in a grid; then ids stand in for places. Where many ids share a coordinate
    the pairs are as many as asked for; near_places() gives the same without expanding them. Repeated ids count once per coordinate.
    """
    p = _placed(points, id_col, lon, lat, box)
    places = p.select("x", "y").distinct()
    here = places.select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.lit(0.0).alias("distance_m"))
    q = p.select(F.col("id").alias("a"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    r = p.select(F.col("id").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = _met(places, metres, box).unionByName(here).join(q, ["x1", "y1"]).join(r, ["x2", "y2"])
    same = (F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2"))
    pairs = pairs.where(F.when(same, F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
    return pairs.groupBy(F.least("a", "b").alias("first_id"), F.greatest("a", "b").alias("second_id")).agg(F.min("distance_m").alias("distance_m"))


def polygon_edges(rings: DataFrame, region: str, piece: str, lons: str = "lons", lats: str = "lats") -> DataFrame:
    """(region, piece, x1, y1, x2, y2): the straight edges of closed rings, holes included."""
    n = F.size(lons) - 1
    e = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(F.col(lons), i).alias("x1"), F.get(F.col(lats), i).alias("y1"), F.get(F.col(lons), i + 1).alias("x2"), F.get(F.col(lats), i + 1).alias("y2")))
    return rings.where(F.size(lons) >= 4).select(F.col(region).alias("region"), F.col(piece).alias("piece"), F.inline(e))


def containing_region(points: DataFrame, id_col: str, lon: str, lat: str, rings: DataFrame, region: str, piece: str, *, strip: float = 0.1, none: str | None = None) -> DataFrame:
    """(id, region) of each point with numeric coordinates; ``none`` where no region holds it.

    Crossing parity: every edge is cut into latitude strips, points join the edges of their strip, and
    the crossings of an eastward ray are counted by point, region and piece; an odd count is inside.
    As a hole belongs to its piece, even-odd counting leaves it out. A half-open rule counts a vertex
    once. A point that lies on an edge belongs to that region; of several regions that hold a point, the
    first by name counts. Equal coordinates are looked up once. Points are never dropped.
    """
    p = points.select(F.col(id_col).alias("id"), F.col(lon).alias("x"), F.col(lat).alias("y"))
    ok = p.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    places = ok.select("x", "y").distinct().withColumn("strip", F.floor(F.col("y") / strip))
    edges = polygon_edges(rings, region, piece)
    lo, hi = F.floor(F.least("y1", "y2") / strip), F.floor(F.greatest("y1", "y2") / strip)
    cut = edges.select("*", F.explode(F.sequence(lo, hi)).alias("strip"))
    x, y, x1, y1, x2, y2 = (F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2"))
    at = (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1
    crosses = ((y1 > y) != (y2 > y)) & (x < at)
    cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    on = (cross == 0) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))
    met = places.join(cut, "strip").where(crosses | on)
    by_piece = met.groupBy("x", "y", "region", "piece").agg(F.count_if(crosses).alias("n"), F.max(on).alias("edge"))
    held = by_piece.where(F.col("edge") | (F.col("n") % 2 == 1)).groupBy("x", "y").agg(F.min("region").alias("region"))
    out = ok.join(held, ["x", "y"], "left").select(F.col("id").alias(id_col), F.coalesce("region", F.lit(none)).alias("region"))
    return out
