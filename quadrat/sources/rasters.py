"""Rasters as ASCII grids and polygons as GeoJSON: scans to long tables, and the raster sink."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pandas as pd

CELLS = "layer_key string, row int, col int, lon double, lat double, value double"


def _parse(text: str) -> tuple[dict[str, float], list[list[float]]]:
    """Header and rows of an ASCII grid: lines of a name and a number, then one line for each row, the northernmost first."""
    head: dict[str, float] = {}
    lines = iter(text.splitlines())
    rows = []
    for line in lines:
        parts = line.split()
        if len(parts) == 2 and parts[0][0].isalpha():
            head[parts[0].lower()] = float(parts[1])
        elif parts:
            rows.append([float(x) for x in parts])
    return head, rows


def read_ascii_grids(spark: SparkSession, folder: str, pattern: str = "*.asc") -> DataFrame:
    """(layer_key, row, col, lon, lat, value) of all cells with a value, a layer for each file, named by it; one task reads one file at a time.

    Coordinates are those of a cell's centre. Cells with the file's NODATA_value are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                head, rows = _parse(content.decode("utf-8"))
                size, none = head["cellsize"], head.get("nodata_value")
                x0 = head["xllcenter"] if "xllcenter" in head else head["xllcorner"] + size / 2
                y0 = head["yllcenter"] if "yllcenter" in head else head["yllcorner"] + size / 2
                name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                for i, r in enumerate(rows):
                    cells = [(name, i, j, x0 + j * size, y0 + (len(rows) - 1 - i) * size, v) for j, v in enumerate(r) if v != none]
                    yield pd.DataFrame(cells, columns=["layer_key", "row", "col", "lon", "lat", "value"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "content")
    return files.mapInPandas(run, CELLS)


def write_ascii_grids(cells: DataFrame, folder: str, grid: dict[str, float], none: float = -9999.0) -> None:
    """One ASCII grid for each layer_key, as text under ``layer_key=...``; rows are put together where they are and only lines meet in a task.

    ``grid`` has xmin, ymax, dx (the cell size), nrow and ncol. Cells without a value get ``none``.
    """
    ncol, nrow = int(grid["ncol"]), int(grid["nrow"])
    lines = cells.groupBy("layer_key", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("value", F.lit(none)).alias("v")))).alias("m"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(ncol - 1)), lambda c: F.coalesce(F.try_element_at(F.col("m"), c), F.lit(none)).cast("string")), " ")
    every = cells.select("layer_key").distinct().select("layer_key", F.explode(F.sequence(F.lit(0), F.lit(nrow - 1))).alias("row"))
    blank = " ".join([str(none)] * ncol)
    lines = every.join(lines.select("layer_key", "row", text.alias("line")), ["layer_key", "row"], "left").withColumn("line", F.coalesce("line", F.lit(blank)))
    head = f"ncols {ncol}\nnrows {nrow}\nxllcorner {grid['xmin']}\nyllcorner {grid['ymax'] - nrow * grid['dx']}\ncellsize {grid['dx']}\nNODATA_value {none}"
    lines = lines.withColumn("line", F.when(F.col("row") == 0, F.concat(F.lit(head + "\n"), "line")).otherwise(F.col("line")))
    lines.repartition("layer_key").sortWithinPartitions("layer_key", "row").select("layer_key", "line").write.mode("overwrite").partitionBy("layer_key").text(folder)


def stack(layers: dict[str, DataFrame]) -> DataFrame:
    """Rasters (row, col, value) as one, each under its name."""
    out = None
    for name, r in layers.items():
        one = r.select(F.lit(name).alias("layer_key"), "row", "col", "value")
        out = one if out is None else out.unionByName(one)
    return out


def clamped(c: Column, low: float, high: float, *, drop: bool = False) -> Column:
    """Cell values held within [low, high], or null outside it with ``drop``."""
    return F.when(c.between(low, high), c) if drop else F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def if_cells(condition: Column, yes: Column, no: Column) -> Column:
    """``yes`` where the condition holds, ``no`` where it does not, null where it is not known."""
    return F.when(condition, yes).when(~condition, no)


def read_geojson(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(name, piece_no, is_hole, lons, lats): the rings of the polygons of GeoJSON feature collections, ``name`` being a property.

    Pieces are counted within a feature; the first ring of a piece is its outline, the others are holes.
    """
    schema = f"features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"  # noqa: F541
    f = spark.read.option("multiLine", True).schema(schema).json(path).select(F.inline("features"))
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    ring = "array<array<array<double>>>"
    pieces = F.when(kind == "Polygon", F.array(F.from_json(text, ring))).when(kind == "MultiPolygon", F.from_json(text, f"array<{ring}>"))
    p = f.select(F.try_element_at(F.col("properties"), F.lit(name)).alias(name), F.posexplode(pieces).alias("piece_no", "rings"))
    p = p.select(name, (F.col("piece_no") + 1).alias("piece_no"), F.posexplode("rings").alias("no", "ring"))
    part = lambda i: F.transform("ring", lambda xy: F.get(xy, F.lit(i)))
    return p.select(name, "piece_no", (F.col("no") > 0).alias("is_hole"), part(0).alias("lons"), part(1).alias("lats"))
