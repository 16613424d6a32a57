"""Recognition batches: the texts of a batch's images joined in order, what was found, and the bets they make.

The order of a batch's images matters, as a text is read line by line with what came before. So texts are joined with an ordered
aggregation in levels: places are cut into ranges of ``WIDTH``, the texts of a range are joined in their order, and the ranges are joined
in turn, until one text is left. Each level gathers ``WIDTH`` texts at most in one group, so a batch that holds a third of all images is
spread over as many groups as it has ranges; only its finished text comes together in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipspark import dims
from slipspark.functions.text import js_trim
from slipspark.operators import classify as cl

WIDTH = 256


def _joined(level: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Neighbouring places become one, with their texts in order."""
    texts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("place", "tie", "text"))))
    to = F.floor(F.col("place") / WIDTH).alias("next")
    rows = level.groupBy(*keys, to).agg(
        F.array_join(F.transform(texts, lambda t: t["text"]), "\n").alias("text"), *[F.sum(c).alias(c) for c in sums]
    )
    return rows.withColumnRenamed("next", "place").withColumn("tie", F.lit(0).cast("bigint"))


def ordered_texts(rows: DataFrame, keys: list[str], place: str, tie: str, sums: list[str] | None = None) -> DataFrame:
    """One row per key: ``text``, the trimmed non-blank texts by ``place`` then ``tie``, one to a line, and the sums of the columns ``sums``.

    ``place`` counts from 0 (less is 0); rows without one come last. Any number of rows may share a key; those of one place are one group.
    """
    sums = sums or []
    last = rows.agg(F.max(place).alias("last")).first()["last"]
    last = 0 if last is None else int(last) + 1  # where rows without a place go
    level = rows.select(
        *keys,
        F.greatest(F.coalesce(F.col(place).cast("bigint"), F.lit(last)), F.lit(0)).alias("place"),
        F.col(tie).alias("tie"),
        js_trim(F.coalesce("text", F.lit(""))).alias("text"),
        *[F.col(c).cast("bigint").alias(c) for c in sums],
    )
    while True:
        level = _joined(level, keys, sums)
        if last < WIDTH:
            return level.drop("place", "tie")
        last //= WIDTH


def batch_texts(images: DataFrame, numbers: Column | None = None) -> DataFrame:
    """batch_id, text, images, images_with_text, numbers_found from rows (batch_id, seq, image_id, text).

    ``numbers`` is how many numbers an image gave; those of images without a text don't count.
    """
    has_text = js_trim(F.coalesce("text", F.lit(""))) != ""
    found = F.lit(0) if numbers is None else F.when(has_text, F.coalesce(numbers, F.lit(0))).otherwise(0)
    counted = images.withColumns({"images": F.lit(1), "images_with_text": has_text.cast("int"), "numbers_found": found})
    return ordered_texts(counted, ["batch_id"], "seq", "image_id", ["images", "images_with_text", "numbers_found"])


def with_line_counts(wide: DataFrame) -> DataFrame:
    """Wide slips plus ``lines_<mode>``: lines of each text that hold something."""
    return wide.withColumns({f"lines_{mode}": cl.line_count(F.coalesce(mode, F.lit(""))).cast("bigint") for mode in dims.MODES})


def chat_slips(batches: DataFrame) -> DataFrame:
    """Batches of chat images as wide slips: the whole text is classified, as a bet may go on over images."""
    return with_line_counts(cl.classify(batches, "text"))


def table_slips(batches: DataFrame) -> DataFrame:
    """Batches of table images as wide slips: what tables hold are straight bets."""
    none = F.lit("").cast("string")
    return with_line_counts(batches.withColumns({"pingma": F.col("text"), "lianma": none, "fushi": none}))


def appended(slips: DataFrame, addition: DataFrame, key: str = "slip_id") -> DataFrame:
    """Wide slips with the texts of ``addition`` (key and a text per mode) behind their own; slips without an addition stay, and
    additions without a slip are slips."""
    more = addition.select(F.col(key), *[F.col(m).alias(f"more_{m}") for m in dims.MODES])
    joined = slips.join(more, key, "full_outer")
    return joined.withColumns({m: cl.join_texts(F.col(m), F.col(f"more_{m}")) for m in dims.MODES}).drop(*[f"more_{m}" for m in dims.MODES])


def recognised_text(images: Column, numbers: Column) -> Column:
    """What the form says after a table batch. Fixed wording."""
    return F.concat(F.lit("OCR 已识别 "), images.cast("string"), F.lit(" 张图片、"), numbers.cast("string"), F.lit(" 个号码金额，已追加到输入区"))


def classified_text(images: Column, lines: dict[str, Column]) -> Column:
    """What the form says after a chat batch. Fixed wording."""
    part = lambda mode: F.when(lines[mode] > 0, F.concat(F.lit(dims.MODE_LABELS[mode]), lines[mode].cast("string"), F.lit("行")))
    parts = F.array_compact(F.array(*[part(mode) for mode in dims.MODES]))
    said = F.when(F.size(parts) > 0, F.array_join(parts, "，")).otherwise(F.lit("未分类到有效内容"))
    return F.concat(F.lit("OCR 已分类 "), images.cast("string"), F.lit(" 张图片："), said)
