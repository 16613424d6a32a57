"""Layouts per image source, and points in rectangles of any kind."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from slipspark import dims
from slipspark.operators import layouts as ly
from slipspark.operators import ocr_table as tb


@pytest.mark.parametrize("size", [1, 7, 96, 10_000])
def test_points_in_rectangles(spark, size):
    """Against testing every rectangle: overlapping, nested, turned inside out, huge and far away ones."""
    rng = random.Random(size)
    rects = []
    for number in range(60):
        x, y = rng.uniform(-300, 300), rng.uniform(-300, 300)
        w, h = rng.choice([(5, 5), (40, 3), (200, 200), (-4, 10), (0, 0), (-30, 5)]) if size > 1 else (rng.uniform(0, 9), rng.uniform(0, 9))
        rects.append((rng.choice(["a", "b", None]), number, x, y, x + w, y + h))
    points = [(rng.choice(["a", "b", "c", None]), i, rng.uniform(-320, 320), rng.uniform(-320, 320)) for i in range(500)]
    points += [("a", 1000 + i, r[2] - 6, r[5] + 6) for i, r in enumerate(rects)] + [("a", 2000, None, 1.0), ("a", 2001, float(int(rects[0][2])), None)]
    held = spark.createDataFrame(rects, "f string, number int, x1 double, y1 double, x2 double, y2 double")
    asked = spark.createDataFrame(points, "f string, id int, x double, y double").repartition(3)
    got = {r.id: r.number for r in ly.located(asked, held, ["f"], size=size).collect()}

    def brute(f, x, y):
        if x is None or y is None:
            return None
        inside = lambda r: r[0] == f and r[2] - 6 <= x <= r[4] + 6 and r[3] - 6 <= y <= r[5] + 6
        return min((r[1] for r in rects if inside(r)), default=None)

    assert got == {i: brute(f, x, y) for f, i, x, y in points}
    assert sum(v is not None for v in got.values()) > 20


def test_the_default_layout_is_that_of_the_cell_join(spark):
    sizes = spark.createDataFrame([("s", 800, 900), ("s", 801, 1033), (None, 800, 900)], "source string, width int, height int")
    none = spark.createDataFrame([], "source string, key string, value double")
    got = ly.cells(sizes, ly.layouts(sizes, none)).collect()
    want = {(r.width, r.height, r.number): (r.x1, r.y1, r.x2, r.y2) for r in tb.cell_rects(sizes).collect()}
    assert len(got) == 3 * dims.MAX_NUMBER
    assert all((r.x1, r.y1, r.x2, r.y2) == want[r.width, r.height, r.number] for r in got)


def test_overrides(spark, tmp_path):
    """Known keys overlay the default, unknown ones and no numbers count for nothing; sources don't touch each other."""
    (tmp_path / "web.json").write_text(json.dumps({"tableX": 0.1, "rowHeight": "0.05", "colour": 3, "paddingX": "wide"}))
    (tmp_path / "old.json").write_text(json.dumps({"tableX": 0.3}))
    (tmp_path / "broken.json").write_text("{")
    overrides = ly.read_overrides(spark, os.path.join(tmp_path, "*.json"))
    sources = spark.createDataFrame([("web",), ("old",), ("broken",), ("plain",), ("web",), (None,)], "source string")
    got = {r.source: {k: r[k] for k in dims.LAYOUT} for r in ly.layouts(sources, overrides).collect()}
    assert got["web"] == {**dims.LAYOUT, "tableX": 0.1, "rowHeight": 0.05}
    assert got["old"] == {**dims.LAYOUT, "tableX": 0.3}
    assert got["broken"] == got["plain"] == got[None] == dims.LAYOUT and len(got) == 5


def test_points_are_not_multiplied(spark):
    """Rows out of the join are the points, however many rectangles overlap; no cartesian product."""
    rects = spark.range(200).select((F.col("id") % 2).cast("string").alias("f"), F.col("id").cast("int").alias("number"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(50.0).alias("x2"), F.lit(50.0).alias("y2"))
    points = spark.range(1000).select((F.col("id") % 2).cast("string").alias("f"), "id", (F.col("id") % 40).cast("double").alias("x"), (F.col("id") % 30).cast("double").alias("y"))
    found = ly.located(points, rects, ["f"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert found.count() == 1000 and found.agg(F.max("number")).first()[0] == 1
