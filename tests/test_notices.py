"""Notices, receipts and maps on small tables with known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.functions import kernels
from annalist.operators import maps, notices


def test_containers_are_no_notices(spark):
    targets = spark.createDataFrame([(1, "https://a.it/albo/?page=2"), (2, "https://a.it/albo/5"), (3, "https://a.it/news#top"), (4, None)], "id int, url string")
    sources = spark.createDataFrame([('[{"url": "https://a.it/albo"}, {"url": "https://a.it/news/"}]',), ("broken",), (None,)], "sections string")
    assert sorted(r.id for r in notices.without_containers(targets, sources, "sections").collect()) == [2, 4]


def test_registers(spark):
    pages = spark.createDataFrame([("a", 1, [(1, "x"), (2, "y")]), ("a", 2, [(2, "z"), (3, "w")])], "listing string, page int, notices array<struct<id:int,title:string>>")
    assert sorted((r.id, r.title) for r in notices.listed(pages, "id", 2).collect()) == [(1, "x"), (2, "z"), (3, "w")]
    with pytest.raises(notices.Overflow):
        notices.listed(pages, "id", 1)


def test_receipts(spark):
    receipts = spark.createDataFrame([(1, "c", 1), (2, "c", 1), (3, "c", 9), (4, "c", 1), (5, "d", 1)], "receipt_id int, candidate_id string, recorded_at int")
    evidence = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 9), (4, 1), (5, 1)], "receipt_id int, acquired_at int")
    found = sorted((r.receipt_id, r.more) for r in notices.visible_receipts(receipts, evidence, F.lit(5), 1).collect())
    assert found == [(1, True), (5, False)]


def test_maps(spark):
    levels = {"yellow": (255, 255, 0), "orange": (255, 165, 0)}
    colours = spark.createDataFrame([(255, 251, 4), (255, 250, 0), (254, 165, 0), (0, 0, 0)], "r int, g int, b int")
    level = maps.level_of_colour(F.col("r"), F.col("g"), F.col("b"), levels)
    assert [r[0] for r in colours.select(level).collect()] == ["yellow", None, "orange", None]
    square = lambda a: [(a, 0.0), (a + 2, 0.0), (a + 2, 2.0), (a, 2.0)]
    drawn = spark.createDataFrame([(1, 7, square(0.0)), (1, 8, square(3.0)), (2, 9, square(0.0))], "map_id long, polygon long, points array<struct<x:double,y:double>>")
    labels = spark.createDataFrame([(1, "A", 1.0, 1.0), (1, "B", 4.0, 1.0), (1, "C", 9.0, 9.0), (1, "D", 2.2, 1.0), (2, "A", 1.0, 1.0), (3, "A", 1.0, 1.0)], "map_id long, label string, x double, y double")
    found = {(r.map_id, r.label): r.polygon for r in maps.labelled_zones(labels, drawn, reach=0.3).collect()}
    assert found == {(1, "A"): 7, (1, "B"): 8, (1, "C"): None, (1, "D"): 7, (2, "A"): 9, (3, "A"): None}


def test_merged_levels(spark):
    side = lambda *rows: spark.createDataFrame(list(rows), "zone string, level string")
    found = maps.merged_levels(side(("a", "red"), ("b", "red"), ("c", "red"), ("e", "red"), ("e", "green")), side(("a", "red"), ("b", "green"), ("d", "green")), ["zone"])
    assert sorted((r.zone, r.state, r.level) for r in found.collect()) == [
        ("a", "confirmed", "red"), ("b", "conflict", None), ("c", "table_only", "red"), ("d", "map_only", "green"), ("e", "conflict", None),
    ]


def test_labels_meet_polygons_by_cells(spark):
    """Slanted, thin, nested, touching and far polygons, with and without reach, against each label tried on each polygon of its map; also one crowded map."""
    rng = random.Random(7)
    drawn, labels = [], []
    for map_id in range(4):
        for k in range(6):
            cx, cy, r = rng.uniform(0, 100), rng.uniform(0, 100), rng.choice([0.2, 3, 20, 60])
            corners = sorted(rng.uniform(0, 6.28) for _ in range(rng.randint(3, 9)))
            drawn.append((map_id, k * 10, [(cx + r * math.cos(t), cy + r * math.sin(t) * rng.choice([1, 1, 0.05])) for t in corners]))
        labels += [(map_id, f"{map_id}-{i}", rng.uniform(-20, 120), rng.uniform(-20, 120)) for i in range(400)]
    drawn += [(9, 1, [(0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]), (9, 2, [(5.0, 0.0), (6.0, 0.0), (6.0, 1.0), (5.0, 1.0)])]
    labels += [(9, "a", 5.0, 0.0), (9, "b", 6.0, 0.5), (9, "c", 5.5, 0.5), (9, "d", None, 1.0), (9, "e", float("nan"), 1.0), (9, "f", 1e300, -1e300), (77, "g", 0.0, 0.0), (9, "c", 5.5, 0.5)]
    rows = spark.createDataFrame(labels, "map_id long, label string, x double, y double").repartition(3)
    shapes = spark.createDataFrame(drawn, "map_id long, polygon long, points array<struct<x:double,y:double>>")
    for reach in (0.0, 0.4, 5.0):
        want = []
        for map_id, label, x, y in labels:
            own = [(k, np.array(p)) for m, k, p in drawn if m == map_id]
            at = None if x is None or x != x else kernels.labelled([p for _, p in own], x, y, reach)
            want.append((map_id, label, None if at is None else own[at][0]))
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in maps.labelled_zones(rows, shapes, reach).collect())
