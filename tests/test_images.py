"""Recognition tables against plain restatements of the rules on small inputs."""

import random

from pyspark.sql import functions as F

from slipspark import dims
from slipspark.functions import tokens
from slipspark.operators import ocr_table as tb
from slipspark.operators import ocr_text as ct
from slipspark.sources.ocr import IMAGES_DDL

# Golden inputs and what they must give.
KEPT = [
    ["澳门彩特码10号12号14号24号26号32号", "10元,4号14号24号34号44号个号各下", "100元,5号15号25号35号45号个号各下", "70元"],
    ["12...48..07/250..46..44..08.16.22..30.02..28", "..06..20...40..26.05..29..07..21..32..24.36/15", "0"],
]


def test_chat_lines_survive(spark):
    rows = spark.createDataFrame([("\n".join(lines),) for lines in KEPT], "text string")
    assert [r.cleaned.split("\n") for r in ct.clean_chats(rows).collect()] == KEPT


def test_chat_line_rules(spark):
    cases = {
        "你好\n10元": "",
        "5号各下\n12345\n10 元": "5号各下\n10元",
        "1/5\n7\n8": "1/5\n7",
        "1.2\n3.4.": "1.2\n3.4.",
        "1.2\n.3..4\n.3": "1.2",
        "1.2\n.3.4": "1.2\n.3.4",
        "1/2.3\n4.5\n6": "1/2.3\n4.5",
        "5号｜6\n1|2": "5号｜6\n1/2",
        "１号": "１号",
        "a/\n" + "1" * 50 + "x": "",
        "1/\n12": "",
        "1.5/\n12": "1.5/\n12",
        "狗 猫\x0b猪": "狗\n猪",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "text string")
    assert {r.text: r.cleaned for r in ct.clean_chats(rows).collect()} == cases


def test_long_digit_run_is_quick(spark):
    rows = spark.createDataFrame([("1.5/\n" + "12" * 20000 + "x",)], "text string")
    assert ct.clean_chats(rows).first().cleaned == "1.5/"


def _image(rng, image_id):
    boxes, txts, scores = [], [], []
    for _ in range(rng.randint(0, 60)):
        x, y = rng.uniform(150, 1000), rng.uniform(100, 1000)
        boxes.append([[x - 9, y - 4], [x + 9, y - 4], [x + 9, y + 4], [x - 9, y + 4]])
        txts.append(rng.choice(["5", "50", "l2", "O", "S00", "12345", "元", "7 0", "1o", "８"]))
        scores.append(rng.choice([0.5, 0.61234, 0.61236, 0.9, 0.95, 1.0]))
    if image_id % 3 == 0:
        scores = scores[: len(scores) // 2]
    return image_id, 1000, rng.choice([300, 1000]), boxes, txts, scores


def _clean(text):
    digits = "".join(c for c in text.translate(str.maketrans("OoIl|Ss", "0011155")) if c.isdecimal())
    return str(int(digits)) if digits and 0 < int(digits) <= 9999 else ""


def _rects(width, height):
    L = dims.LAYOUT
    for n in range(1, 50):
        g = min(3, (n - 1) // 12)
        r = n - 37 if g == 3 else (n - 1) % 12
        x = width * L["tableX"] + g * (width * L["groupWidth"]) + width * L["numberColumnWidth"] + width * L["paddingX"]
        y = height * L["tableY"] + r * (height * L["rowHeight"]) + height * L["paddingY"]
        w = width * L["groupWidth"] - width * L["numberColumnWidth"] - width * L["paddingX"] * L["sourceWidthPaddingMultiplier"]
        h = height * L["rowHeight"] - height * L["paddingY"] * L["sourceHeightPaddingMultiplier"]
        yield n, max(0, round(x)), max(0, round(y)), min(width, round(x + w)), min(height, round(y + h))


def test_cells_against_plain_rules(spark):
    rng = random.Random(7)
    images = [_image(rng, i) for i in range(40)]
    df = spark.createDataFrame(images, IMAGES_DDL)
    got = {(r.image_id, r.number): (r.amount, r.confidence) for r in tb.cell_rows(tb.fast_cells(df)).collect()}
    want = {}
    for image_id, width, height, boxes, txts, scores in images:
        rects = list(_rects(width, height))
        for i, (box, text) in enumerate(zip(boxes, txts)):
            amount, score = _clean(text), scores[i] if i < len(scores) else 0.0
            x, y = sum(p[0] for p in box) / 4, sum(p[1] for p in box) / 4
            hit = next((n for n, x1, y1, x2, y2 in rects if x1 - 6 <= x <= x2 + 6 and y1 - 6 <= y <= y2 + 6), None)
            if not amount or hit is None:
                continue
            old = want.get((image_id, hit), ("", -1.0))
            if score >= old[1] or len(amount) > len(old[0]):
                want[image_id, hit] = (amount, round(score, 4))
    assert got == want and len(want) > 150


def test_lines_against_plain_rules(spark):
    rng = random.Random(11)
    images = [_image(rng, i) for i in range(40)]
    got = {r.image_id: r.raw_text for r in ct.chat_texts(spark.createDataFrame(images, IMAGES_DDL)).collect()}
    for image_id, _, _, boxes, txts, _ in images:
        items = [(sum(p[1] for p in b) / 4, sum(p[0] for p in b) / 4, t) for b, t in zip(boxes, txts)]
        items.sort(key=lambda item: (round(item[0] / 12), item[1]))
        lines, height = [], None
        for y, _, text in items:
            if height is None or abs(y - height) <= 14:
                lines = lines or [""]
                lines[-1] += text
                height = y if height is None else (height + y) / 2
            else:
                lines.append(text)
                height = y
        assert got[image_id] == "\n".join(lines)


def test_merge_rules(spark):
    ddl = "image_id bigint, number int, amount string, confidence double"
    fast = spark.createDataFrame([(1, 1, "5", 0.96), (1, 2, "5", 0.9), (1, 3, "5", 0.9), (1, 4, "5", 0.9), (1, 6, "5", 0.5)], ddl)
    verify = spark.createDataFrame(
        [(1, 1, "50", 0.99), (1, 2, "6", 0.9), (1, 3, "6", 0.8), (1, 4, "60", 0.6), (1, 5, "7", 0.55), (1, 6, "70", 0.5)], ddl
    )
    per_image = lambda rows: rows.groupBy("image_id").agg(F.collect_list(F.struct("number", "amount", "confidence")).alias("cells"))
    merged = tb.merge_passes(per_image(fast), per_image(verify))
    got = {r.number: (r.amount, r.confidence) for r in tb.cell_rows(merged).collect()}
    assert got == {1: ("5", 0.96), 2: ("6", 0.9), 3: ("5", 0.9), 4: ("60", 0.6), 5: ("7", 0.55), 6: ("5", 0.5)}


def test_bet_text(spark):
    cells = F.array(*[F.struct(F.lit(n).alias("number"), F.lit(a).alias("amount")) for n, a in [(9, "5"), (1, "5"), (3, "20")]])
    assert spark.range(1).select(tb.bet_text(cells).alias("t")).first().t == "1号9号一个号各下5元，3号一个号各下20元"


def test_layout_override(spark):
    assert tb.layout_with({"rowHeight": 1, "other": 2}) == {**dims.LAYOUT, "rowHeight": 1.0}


def test_amount_rules(spark):
    rows = spark.createDataFrame([("Ool",), ("s5",), ("8 0元",), ("10000",), ("０12",), ("9" * 60,), ("",)], "t string")
    got = rows.select(tokens.clean_amount_web(F.col("t")), tokens.clean_amount_service(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("1", "1"), ("5", "55"), ("80", "80"), ("", ""), ("12", "12"), ("", ""), ("", "")]
