"""Cells of layouts that differ by image source, and which rectangle a point lies in.

Overrides are rows (source, key, value) over the default layout. Points meet rectangles in an interval join: both are keyed by the
bins of a grid, rectangles by all that they touch, and the exact test follows within a bin. Rectangles of a bin are gathered in
one row first, lowest number first, so a point is joined once, never multiplied, and nothing has to be grouped after it; that side
holds a row per bin and grows with the rectangles, not with the points. Rectangles may overlap, lie anywhere, and have any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipspark import dims
from slipspark.operators.ocr_table import GROUPS, LAST_GROUP_FIRST, _edges, _span

#: Width and height of a bin in pixels: about that of a cell, so that a rectangle touches few.
BIN = 96


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(source, key, value) from JSON files of one object each; a file is named after its source."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("source"), "value")
    pairs = files.select("source", F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    return pairs.select("source", "key", F.col("value").try_cast("double").alias("value"))


def layouts(sources: DataFrame, overrides: DataFrame) -> DataFrame:
    """A row per source (a column ``source``) with its layout: the default overlaid by the known keys.

    Unknown keys and values that are null count for nothing; of several values of a key the greatest one counts.
    """
    known = [F.max(F.when(F.col("key") == key, F.col("value"))).alias(key) for key in dims.LAYOUT]
    given = overrides.groupBy(F.col("source").alias("of")).agg(*known)
    joined = sources.select("source").distinct().join(given, F.col("source").eqNullSafe(F.col("of")), "left")
    return joined.select("source", *[F.coalesce(F.col(key), F.lit(value)).alias(key) for key, value in dims.LAYOUT.items()])


def cells(sizes: DataFrame, layout: DataFrame) -> DataFrame:
    """source, width, height, number, x1, y1, x2, y2 (whole pixels, within the image) of every cell of every size in use."""
    frames = sizes.select(F.col("source").alias("of"), "width", "height").distinct()
    frames = frames.join(layout, F.col("of").eqNullSafe(F.col("source"))).drop("of")
    left, top, cell_width, cell_height = _edges(F.col("width"), F.col("height"), {key: F.col(key) for key in dims.LAYOUT})
    group = F.least(F.lit(GROUPS - 1), F.call_function("div", F.col("number") - 1, F.lit(12)).cast("int"))
    row = F.when(F.col("group") == GROUPS - 1, F.col("number") - LAST_GROUP_FIRST).otherwise((F.col("number") - 1) % 12)
    numbered = frames.withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(dims.MAX_NUMBER)))).withColumn("group", group).withColumn("row", row)
    across, down = _span(left(F.col("group")), cell_width, F.col("width")), _span(top(F.col("row")), cell_height, F.col("height"))
    return numbered.select("source", "width", "height", "number", across["from"].alias("x1"), down["from"].alias("y1"), across["to"].alias("x2"), down["to"].alias("y2"))


def _bin(value: Column, size: int) -> Column:
    return F.floor(value / size)


def binned(rects: DataFrame, frame: list[str], margin: float = dims.CELL_MARGIN, size: int = BIN) -> DataFrame:
    """frame, bx, by, rects: the widened rectangles that touch each bin, by number. Rectangles of negative extent hold nothing."""
    wide = {"x1": F.col("x1") - margin, "y1": F.col("y1") - margin, "x2": F.col("x2") + margin, "y2": F.col("y2") + margin}
    rows = rects.withColumns(wide).where("x1 <= x2 AND y1 <= y2")
    touched = lambda a, b: F.sequence(_bin(F.col(a), size), _bin(F.col(b), size))
    rows = rows.withColumn("bx", F.explode(touched("x1", "x2"))).withColumn("by", F.explode(touched("y1", "y2")))
    return rows.groupBy(*frame, "bx", "by").agg(F.array_sort(F.collect_list(F.struct("number", "x1", "y1", "x2", "y2"))).alias("rects"))


def located(points: DataFrame, rects: DataFrame, frame: list[str], margin: float = dims.CELL_MARGIN, size: int = BIN) -> DataFrame:
    """``points`` (frame, x, y, ...) plus ``number`` of the lowest rectangle that holds them, borders included; null outside all.

    Points without a place are outside. A null in the frame meets rectangles with the same null.
    """
    named = binned(rects, frame, margin, size)
    named = named.select(*[F.col(c).alias(f"_{c}") for c in (*frame, "bx", "by")], "rects")
    same = (_bin(F.col("x"), size) == F.col("_bx")) & (_bin(F.col("y"), size) == F.col("_by"))
    for c in frame:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    holds = lambda r: (r["x1"] <= F.col("x")) & (F.col("x") <= r["x2"]) & (r["y1"] <= F.col("y")) & (F.col("y") <= r["y2"])
    number = F.get(F.filter("rects", holds), F.lit(0))["number"]
    return points.join(named, same, "left").select(*[F.col(c) for c in points.columns], number.alias("number"))

