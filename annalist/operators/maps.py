"""Facts read off maps: levels by colour, zones by the polygon around a label, and maps put together with tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import kernels
from annalist.operators.shared import settled


def level_of_colour(red: Column, green: Column, blue: Column, levels: dict[str, tuple[int, int, int]], tolerance: int = 4) -> Column:
    """The level whose colour is within tolerance in each channel, if it is the only one."""
    near = lambda channel, value: F.abs(channel - F.lit(value)) <= tolerance
    hits = F.array_compact(F.array(*[F.when(near(red, r) & near(green, g) & near(blue, b), F.lit(name)) for name, (r, g, b) in levels.items()]))
    return F.when(F.size(hits) == 1, F.get(hits, 0))


#: Cells of a map's grid in each direction.
CELLS = 64
COVER = "array<struct<cx:int,cy:int,inside:boolean>>"


def _cover(points: np.ndarray, left: float, low: float, wide: float, high: float, reach: float) -> list[dict]:
    """Cells of a grid that a polygon has to do with: those in which its outline or what is within reach of it may lie, and those wholly inside.

    The outline is followed in steps of half a cell, and the cells around each step are taken, so none is missed.
    """
    size, behind = np.array([wide, high]), np.roll(points, -1, axis=0)
    steps = np.maximum(np.ceil((np.abs(behind - points) / size).max(axis=1) * 2).astype(int), 1)
    of = np.repeat(np.arange(len(points)), steps)
    share = (np.arange(len(of)) - np.repeat(np.cumsum(steps) - steps, steps)) / steps[of]
    at = np.floor((points[of] + (behind - points)[of] * share[:, None] - [left, low]) / size).astype(int)
    margin = np.ceil(reach / size).astype(int) + 1
    around = np.stack(np.meshgrid(np.arange(-margin[0], margin[0] + 1), np.arange(-margin[1], margin[1] + 1)), axis=-1).reshape(-1, 2)
    edge = np.unique((np.unique(at, axis=0)[:, None] + around).reshape(-1, 2), axis=0)
    first, last = at.min(axis=0), at.max(axis=0)
    grid = np.stack(np.meshgrid(np.arange(first[0], last[0] + 1), np.arange(first[1], last[1] + 1)), axis=-1).reshape(-1, 2)
    rest = grid[~np.isin(grid[:, 0] * (1 << 20) + grid[:, 1], edge[:, 0] * (1 << 20) + edge[:, 1])]
    middle = (rest + 0.5) * size + [left, low]
    full = rest[kernels.contains(points, middle[:, 0], middle[:, 1])] if len(rest) else rest
    return [{"cx": int(x), "cy": int(y), "inside": False} for x, y in edge] + [{"cx": int(x), "cy": int(y), "inside": True} for x, y in full]


def _array(points) -> np.ndarray:
    return np.array([[p["x"], p["y"]] for p in points], dtype=np.float64).reshape(-1, 2)


def labelled_zones(labels: DataFrame, polygons: DataFrame, reach: float = 0.0) -> DataFrame:
    """map_id, label and the index of the polygon it names: the only one with the label's point inside, or, if there is none, the only one whose outline is within reach; else null.

    `labels` has map_id, label, x, y; `polygons` has map_id, polygon (an index) and points, an array of (x, y) of three at least. Polygons cover cells of a grid of their map, and a
    label meets those of its cell only: in a cell wholly inside nothing is left to test, in others the point is tested exactly. So a map may have any number of labels, and they are dealt by cells.
    Labels without a place, and maps without polygons, name none.
    """
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    boxes = polygons.groupBy("map_id").agg(F.min(F.array_min(xs)).alias("left"), F.min(F.array_min(ys)).alias("low"), F.max(F.array_max(xs)).alias("right"), F.max(F.array_max(ys)).alias("top"))
    side = lambda a, b: F.when(F.col(b) > F.col(a), (F.col(b) - F.col(a)) / CELLS).otherwise(1.0)
    grids = settled(boxes.select("map_id", "left", "low", side("left", "right").alias("wide"), side("low", "top").alias("high")))

    @F.pandas_udf(COVER)
    def cells(points: pd.Series, left: pd.Series, low: pd.Series, wide: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([_cover(_array(p), a, b, c, d, reach) for p, a, b, c, d in zip(points, left, low, wide, high, strict=True)], dtype=object)

    @F.pandas_udf("struct<inside:boolean,near:boolean>")
    def tested(points: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        shapes = [_array(p) for p in points]
        inside = [bool(kernels.contains(s, np.array([a]), np.array([b]))[0]) for s, a, b in zip(shapes, x, y, strict=True)]
        near = [bool(reach) and kernels.distance(s, a, b) <= reach for s, a, b in zip(shapes, x, y, strict=True)]
        return pd.DataFrame({"inside": inside, "near": near})

    cover = polygons.join(grids, "map_id").select("map_id", "polygon", F.explode(cells("points", "left", "low", "wide", "high")).alias("c")).select("map_id", "polygon", "c.*")
    asked = settled(labels.select("map_id", "label", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumn("_id", F.monotonically_increasing_id()))
    there = asked.join(grids, "map_id").where(~F.isnan("x") & ~F.isnan("y"))
    place = lambda value, origin, size: F.floor((F.col(value) - F.col(origin)) / F.col(size)).try_cast("int")
    within = (F.col("x") >= F.col("left") - F.col("wide") - reach) & (F.col("x") <= F.col("left") + (CELLS + 1) * F.col("wide") + reach) & (F.col("y") >= F.col("low") - F.col("high") - reach) & (F.col("y") <= F.col("low") + (CELLS + 1) * F.col("high") + reach)
    there = there.where(within).select("map_id", "_id", "x", "y", place("x", "left", "wide").alias("cx"), place("y", "low", "high").alias("cy"))
    met = there.join(cover, ["map_id", "cx", "cy"])
    sure = met.where("inside").select("_id", "polygon", F.lit(True).alias("inside"), F.lit(False).alias("near"))
    open_ = met.where("NOT inside").join(polygons.select("map_id", "polygon", "points"), ["map_id", "polygon"])
    open_ = open_.select("_id", "polygon", tested("points", "x", "y").alias("t")).select("_id", "polygon", "t.inside", "t.near")
    n_in, n_near = F.count_if("inside"), F.count_if("near")
    named = F.when(n_in == 1, F.max(F.when(F.col("inside"), F.col("polygon")))).when((n_in == 0) & (n_near == 1), F.max(F.when(F.col("near"), F.col("polygon"))))
    found = sure.union(open_).groupBy("_id").agg(named.cast("long").alias("polygon"))
    return asked.join(found, "_id", "left").select("map_id", "label", "polygon")


def merged_levels(table: DataFrame, drawn: DataFrame, keys: list[str]) -> DataFrame:
    """Levels from a table and from a map of the same keys: both agree, one is alone, or they conflict and none is taken.

    A side that contradicts itself conflicts as well.
    """
    rows = table.select(*keys, "level", F.lit(True).alias("_table")).unionByName(drawn.select(*keys, "level", F.lit(False).alias("_table")))
    rows = rows.groupBy(*keys).agg(F.min("level").alias("_low"), F.max("level").alias("_high"), F.bool_or("_table").alias("_t"), F.bool_or(~F.col("_table")).alias("_m"))
    state = F.when(F.col("_low") != F.col("_high"), "conflict").when(F.col("_t") & F.col("_m"), "confirmed").when(F.col("_t"), "table_only").otherwise("map_only")
    return rows.select(*keys, state.alias("state"), F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("level"))
