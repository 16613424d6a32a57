"""Recognition batches: ordered texts over rows, counts, and a chat batch from boxes to its settled bets."""

import random

import pytest
from pyspark.sql import functions as F

from slipspark.operators import batches as bs
from slipspark.operators import extract as ex
from slipspark.operators import ocr_text as ct
from slipspark.operators import settle as st
from slipspark.operators import summary as sm


def _brute(rows):
    """text, images, images with text, numbers of each batch."""
    out = {}
    for batch, seq, image, text, numbers in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, max(r[1] or 0, 0), r[2])):
        texts, images, speaking, found = out.get(batch, ([], 0, 0, 0))
        tidy = (text or "").strip()
        out[batch] = (texts + [tidy] if tidy else texts, images + 1, speaking + bool(tidy), found + (numbers or 0) * bool(tidy))
    return {b: ("\n".join(t), i, s, f) for b, (t, i, s, f) in out.items()}


@pytest.mark.parametrize("width", [2, 5, 256])
def test_ordered_texts(spark, monkeypatch, width):
    monkeypatch.setattr(bs, "WIDTH", width)
    rng = random.Random(width)
    rows = [(7, seq, seq, f"t{seq}\nmore", 1) for seq in range(600)]  # one batch holds most images
    rows += [(rng.randrange(3), rng.randrange(900), 1000 + i, rng.choice([f"x{i}", " ", None, "", f" \n y{i}　"]), rng.choice([0, 3, None])) for i in range(200)]
    rows += [(8, None, 1, "last", 1), (8, 5, 2, "middle", None), (8, -3, 3, "first", 2), (8, 5, 4, "tied", 1), (9, 1, 5, None, 4), (None, 2, 6, "none", 1), (None, 1, 7, "no", 1)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "batch_id int, seq int, image_id int, text string, numbers int").repartition(5)
    got = {r.batch_id: (r.text, r.images, r.images_with_text, r.numbers_found) for r in bs.batch_texts(frame, F.col("numbers")).collect()}
    assert got == _brute(rows)
    assert bs.batch_texts(frame.limit(0)).count() == 0


def test_groups_stay_small(spark):
    """A batch of any size meets in groups of WIDTH texts."""
    rows = spark.range(5000).select(F.lit(1).alias("b"), F.col("id").alias("place"), F.lit(0).alias("tie"), F.lit("x").alias("text"))
    level = bs._joined(rows, ["b"], [])
    sizes = level.select((F.length("text") + 1) / 2).collect()
    assert max(r[0] for r in sizes) == bs.WIDTH and level.count() == -(-5000 // bs.WIDTH)


def _image(batch, seq, lines):
    corner = lambda x, y: [float(x), float(y)]
    boxes = [[corner(10, 40 * i), corner(90, 40 * i), corner(90, 40 * i + 10), corner(10, 40 * i + 10)] for i in range(len(lines))]
    return (batch, seq, seq, list(reversed(boxes)), list(reversed(lines)), None)


def test_chat_batch_to_settled_bets(spark):
    """Golden continuation lines over two images, chatter between them, then settled."""
    images = [
        _image("a", 1, ["好的", "18..06..12/25", "0", "5号6号各下", "30元"]),
        _image("a", 2, ["收到，谢谢"]),
        _image("a", 3, ["46.47", "5.9二中二出50", "复试二中二各20", "23.22.27.06"]),
        _image("b", 1, ["嗯"]),
    ]
    frame = spark.createDataFrame(images, "batch_id string, seq int, image_id int, boxes array<array<array<double>>>, txts array<string>, scores array<double>")
    texts = ct.chat_texts(frame).select("batch_id", "seq", "image_id", "text")
    wide = bs.chat_slips(bs.batch_texts(texts)).withColumn("slip_id", F.col("batch_id"))
    lines = {m: F.col(f"lines_{m}") for m in ("pingma", "lianma", "fushi")}
    rows = {r.batch_id: r for r in wide.withColumn("said", bs.classified_text(F.col("images"), lines)).collect()}
    assert rows["a"].text == "18..06..12/25\n0\n5号6号各下\n30元\n46.47\n5.9二中二出50\n复试二中二各20\n23.22.27.06"
    assert (rows["a"].images, rows["a"].images_with_text, rows["b"].images_with_text, rows["b"].text) == (3, 2, 0, "")
    assert rows["a"].said == "OCR 已分类 3 张图片：平码2行，连码2行，复式2行"
    assert rows["b"].said == "OCR 已分类 1 张图片：未分类到有效内容"
    draws = spark.createDataFrame([("d", 18, [23, 22, 1, 2, 3, 4, 18], [""])], "draw_date string, special int, numbers array<int>, zodiacs array<string>")
    drawn = st.with_draw(wide.withColumn("draw_date", F.lit("d")), st.draw_inputs(draws))
    totals = {r.slip_id: r for r in sm.all_mode_summaries(sm.with_winners(ex.with_groups(drawn))).collect()}
    # 25 on each of 18, 06, 12; two pairs at 50; six pairs at 20 of which one is drawn. A cut amount is not a line of its own.
    assert (float(totals["a"].total_bet_amount), float(totals["a"].total_win_amount)) == (75 + 100 + 120, 25 * 47 + 20 * 65)
    assert float(totals["b"].total_bet_amount) == 0


def test_appended(spark):
    wide = "slip_id int, pingma string, lianma string, fushi string"
    slips = spark.createDataFrame([(1, "狗20 ", None, ""), (2, "x", "y", "z")], wide)
    more = spark.createDataFrame([(1, " 羊5", "46.47", None), (3, "马1", "", "")], wide)
    got = {r.slip_id: (r.pingma, r.lianma, r.fushi) for r in bs.appended(slips, more).collect()}
    assert got == {1: ("狗20\n羊5", "46.47", ""), 2: ("x", "y", "z"), 3: ("马1", "", "")}
