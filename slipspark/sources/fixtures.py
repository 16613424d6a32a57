"""Slips, draws, images and feeds derived row by row from the given tables.

Every table here is a projection of a given one: a row of ``orders`` renders one slip, one image or one set of cell
readings, a row of ``lineitem`` one text line, a row of ``events`` one poll or request. Nothing is grouped to build them,
so they grow with the tables and have no hot keys of their own.

The arithmetic is written once and rendered in two SQL dialects. Spark turns the numbers into text and reads them back;
the checking SQL computes the answers from the numbers and never parses a text.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipspark import dims

NL = "chr(10)"


class SparkText:
    """Array expressions as Spark SQL writes them."""

    @staticmethod
    def each(count: str, var: str, body: str) -> str:
        return f"transform(sequence(0, cast({count} as int) - 1), {var} -> {body})"

    @staticmethod
    def join(items: str, sep: str) -> str:
        return f"array_join({items}, {sep})"

    @staticmethod
    def pick(options: list[str], index: str) -> str:
        return f"element_at(array({', '.join(_quoted(o) for o in options)}), cast({index} as int) + 1)"


class CheckText:
    """The same expressions for the checking engine."""

    @staticmethod
    def each(count: str, var: str, body: str) -> str:
        return f"list_transform(range(0, cast({count} as int)), lambda {var}: {body})"

    @staticmethod
    def join(items: str, sep: str) -> str:
        return f"array_to_string({items}, {sep})"

    @staticmethod
    def pick(options: list[str], index: str) -> str:
        return f"([{', '.join(_quoted(o) for o in options)}])[cast({index} as int) + 1]"


def _quoted(text: str) -> str:
    return "'" + text + "'"


def nn(x: str) -> str:
    return f"lpad(cast({x} as string), 2, '0')"


# Numbers and amounts of a slip; k is the order key, c the customer key, g the group, j the place in it.
def bag(g: str, j: str) -> str:
    """May repeat a number within a group."""
    return f"((k * 7 + c * 3 + {g} * 11 + {j} * {j} * 5 + {j} * (1 + k % 6)) % 49 + 1)"


def distinct(g: str, j: str) -> str:
    """No repeats for up to eight places."""
    return f"((k * 5 + c * 3 + {g} * 13 + {j} * (1 + k % 6)) % 49 + 1)"


def amount(g: str) -> str:
    return f"((k * 3 + c + {g} * 7) % 50 + 1)"


SLASH_GROUPS = "(1 + k % 3)"
CN_GROUPS = "(1 + c % 2)"
ZODIAC_BETS = "(1 + k % 2)"
NAME = "translate(cast(c as string), '0123456789', 'abcdefghij')"
SLASH_FORM = "(k % 4)"  # 0 lines, 1 one line, 2 amount broken over lines, 3 blank lines between
CN_FORM = "((k + c) % 3)"  # 0 lines, 1 one line, 2 amount on the next line
CN_BETWEEN = "CASE WHEN g = 0 THEN '' WHEN k % 5 = 0 THEN '买' WHEN k % 10 = 1 THEN ' 下' ELSE '，' END"
PER_NUMBER = ["一个号", "个号", "每个号", "每号", "各号", ""]
AMOUNT_WORD = ["各下", "各押", "各买", "各", "下", "押", "买"]
ZODIACS = list(dims.ZODIAC_ORDER)


def slash_size(g: str) -> str:
    return f"(1 + (k + c + {g} * 3) % 5)"


def cn_size(g: str) -> str:
    return f"(1 + (k * 2 + c + {g}) % 4)"


def zodiac_index(g: str) -> str:
    return f"((k + c + {g} * 5) % 12)"


@cache
def _rendered(of, most: int, sep: str, unit: str) -> str:
    """One to ``most`` numbers in text form, for each first number and each k % 6, which decide all that follow."""
    texts = []
    for first in range(49):
        for k in range(6):
            c = next(c for c in range(49) if eval(of("0", "0"), {"k": k, "c": c}) == first + 1)
            numbers = [eval(of("0", "j"), {"k": k, "c": c, "j": j}) for j in range(most)]
            texts += [sep.join(f"{n:02d}{unit}" for n in numbers[: i + 1]) for i in range(most)]
    return "|".join(texts)


def _numbers(t, g: str, size: str, sep: str, of=bag, unit: str = "", skip: int = 0) -> str:
    """Numbers of a group as text, from place ``skip`` on.

    All numbers follow from the first and k % 6 (only ``distinct`` may skip), so the texts of keys from 0 on are looked up;
    rendering number by number would be most of the work of building a slip. The checking engine renders each.
    """
    place = f"(j + {skip})" if skip else "j"
    member = nn(of(g, place))
    general = t.join(t.each(size, "j", f"concat({member}, {_quoted(unit)})" if unit else member), _quoted(sep))
    if t is not SparkText:
        return general
    bounded = re.fullmatch(r"\((\d+) \+ .* % (\d+)\)", size)
    most = int(bounded[1]) + int(bounded[2]) - 1 if bounded else int(size)
    texts = f"split({_quoted(_rendered(of, most, sep, unit))}, '[|]')"
    index = f"(({of(g, str(skip))} - 1) * 6 + k % 6) * {most} + {size}"
    return f"CASE WHEN k >= 0 AND c >= 0 THEN element_at({texts}, cast({index} as int)) ELSE {general} END"


def slash_text(t) -> str:
    dotted = _numbers(t, "g", slash_size("g"), ".")
    spaced = _numbers(t, "g", slash_size("g"), "..")
    lines = lambda body, sep: t.join(t.each(SLASH_GROUPS, "g", body), sep)
    a = amount("g")
    return (
        f"CASE {SLASH_FORM} WHEN 0 THEN {lines(f'concat({NAME}, {_quoted('：')}, {dotted}, {_quoted('/')}, {a})', NL)} "
        f"WHEN 1 THEN {lines(f'concat({spaced}, {_quoted('/')}, {a})', _quoted('..'))} "
        f"WHEN 2 THEN {lines(f'concat({NAME}, {_quoted('：')}, {dotted}, {_quoted('/')}, {a}, {NL}, {_quoted('0')})', NL)} "
        f"ELSE {lines(f'concat({dotted}, {_quoted('/ ')}, {a})', f'concat({NL}, {NL})')} END"
    )


def cn_text(t) -> str:
    numbers = _numbers(t, "g + 20", cn_size("g"), "", unit="号")
    words = f"{t.pick(PER_NUMBER, 'k % 6')}, {t.pick(AMOUNT_WORD, '(k + g) % 7')}"
    a = amount("g + 20")
    tail = "CASE WHEN k % 2 = 0 THEN '元' ELSE '.5' END"
    lines = lambda body, sep: t.join(t.each(CN_GROUPS, "g", body), sep)
    return (
        f"CASE {CN_FORM} WHEN 0 THEN {lines(f'concat({NAME}, {_quoted('：')}, {numbers}, {words}, {a}, {tail})', NL)} "
        f"WHEN 1 THEN {lines(f'concat({CN_BETWEEN}, {numbers}, {words}, {a}, {tail})', _quoted(''))} "
        f"ELSE {lines(f'concat({numbers}, {words}, {NL}, {a}, {_quoted('元')})', NL)} END"
    )


def zodiac_text(t) -> str:
    word = t.pick(["", "各下", "买"], "k % 3")
    body = f"concat({t.pick(ZODIACS, zodiac_index('g'))}, {word}, {amount('g + 5')}, CASE WHEN c % 2 = 0 THEN '' ELSE '.5' END)"
    return t.join(t.each(ZODIAC_BETS, "g", body), "'，'")


def pingma_text(t) -> str:
    return f"concat({slash_text(t)}, {NL}, {cn_text(t)}, {NL}, {zodiac_text(t)})"


BLOCK_PLAYS = ["二中二", "三中三", "复四三", "二中三"]
BLOCK_FORM = "(c % 3)"  # 0 two number lines, 1 numbers in the header, 2 closed by a line without numbers
BLOCK_REST = "(1 + k % 4)"
INLINE_PLAYS = ["二中二", "三中三", "二中三"]
INLINE_SIZE = "(2 + (k + c) % 5)"
POOL_WORD = ["各", "每组", "出", ""]


def block_text(t) -> str:
    play = t.pick(BLOCK_PLAYS, "k % 4")
    first = _numbers(t, "0", "3", ".", distinct)
    rest = _numbers(t, "0", BLOCK_REST, ".", distinct, skip=3)
    a = amount("0")
    return (
        f"CASE {BLOCK_FORM} "
        f"WHEN 0 THEN concat('复试', {play}, '各', {a}, {NL}, {first}, {NL}, CASE WHEN k % 2 = 0 THEN {NL} ELSE '' END, {rest}) "
        f"WHEN 1 THEN concat({first}, {play}, '每组', {a}, '元', {NL}, {rest}) "
        f"ELSE concat('复式', {play}, '各', {a}, '.5', {NL}, {first}, {NL}, '完', {NL}, {rest}) END"
    )


def inline_text(t) -> str:
    play = t.pick(INLINE_PLAYS, "c % 3")
    pool = _numbers(t, "3", INLINE_SIZE, ".", distinct)
    second = _numbers(t, "4", "4", ".", distinct)
    return (
        f"concat({play}, ' ', {pool}, '/', {amount('3')}, CASE WHEN k % 2 = 0 THEN '' ELSE '.5' END, "
        f"CASE WHEN k % 3 = 0 THEN concat(' 三中三 ', {second}, '/', {amount('4')}) ELSE '' END)"
    )


def pool_zodiac_index(i: str) -> str:
    """Four places in the sequence; on every seventh key they repeat, which makes the bet invalid."""
    return f"((k + c + {i} * (CASE WHEN k % 7 = 0 THEN 6 ELSE 1 + c % 2 END)) % 12)"


def zodiac_pool_text(t) -> str:
    names = t.join(t.each("4", "i", t.pick(ZODIACS, pool_zodiac_index("i"))), "''")
    a = amount("6")
    digits = ["", "一", "二", "三", "四", "五", "六", "七", "八", "九"]
    ones = t.pick(digits, f"({a} % 10)")
    tens = t.pick(["", ""] + digits[2:], f"(({a} - {a} % 10) / 10)")
    ten = f"CASE WHEN {a} >= 10 THEN '十' ELSE '' END"
    spelled = f"CASE WHEN k % 2 = 0 THEN cast({a} as string) ELSE concat({tens}, {ten}, {ones}) END"
    return f"concat({names}, '复四三', {t.pick(POOL_WORD, 'c % 4')}, {spelled}, CASE WHEN k % 5 = 0 THEN '元' ELSE '' END)"


def fushi_text(t) -> str:
    return f"concat({block_text(t)}, {NL}, {inline_text(t)}, {NL}, {zodiac_pool_text(t)})"


LISTED_PICK = "(2 + c % 2)"
LISTED_LINES = "(1 + k % 3)"


def listed_text(t) -> str:
    play = t.pick(["二中二", "三中三"], "c % 2")
    line = _numbers(t, "(g + 5)", LISTED_PICK, ".", distinct)
    lines = t.join(t.each(LISTED_LINES, "g", line), NL)
    own = f"CASE WHEN k % 2 = 1 THEN {_numbers(t, '9', LISTED_PICK, '.', distinct)} ELSE '' END"
    dropped = f"CASE WHEN k % 5 = 0 THEN concat({_numbers(t, '30', LISTED_PICK, '.', distinct)}, {NL}, {NL}) ELSE '' END"
    wrong_size = f"CASE WHEN k % 4 = 0 THEN concat({NL}, {_numbers(t, '31', '5', '.', distinct)}) ELSE '' END"
    unpriced = f"CASE WHEN c % 5 = 0 THEN concat({NL}, '二中三各5') ELSE '' END"
    return f"concat({dropped}, {lines}, {wrong_size}, {unpriced}, {NL}, {own}, {play}, '出', {amount('9')})"


def mixed_pingma_text(t) -> str:
    """Straight lines that survive classification as they are; bets broken over lines are tested elsewhere."""
    dotted = _numbers(t, "g", slash_size("g"), ".")
    slash = t.join(t.each(SLASH_GROUPS, "g", f"concat({dotted}, '/', {amount('g')})"), NL)
    numbers = _numbers(t, "20", cn_size("0"), "", unit="号")
    zodiac = f"concat({t.pick(ZODIACS, zodiac_index('0'))}, {amount('5')})"
    return f"concat({numbers}, '一个号各下', {amount('20')}, '元', {NL}, {slash}, {NL}, {zodiac})"


def mixed_listed_text(t) -> str:
    line = _numbers(t, "(g + 5)", LISTED_PICK, ".", distinct)
    lines = t.join(t.each(LISTED_LINES, "g", line), NL)
    play = t.pick(["二中二", "三中三"], "c % 2")
    return f"concat({lines}, {NL}, {_numbers(t, '9', LISTED_PICK, '.', distinct)}, {play}, '出', {amount('9')})"


def mixed_block_text(t) -> str:
    play = t.pick(BLOCK_PLAYS, "k % 4")
    first = _numbers(t, "0", "3", ".", distinct)
    rest = _numbers(t, "0", "(2 + k % 3)", ".", distinct, skip=3)
    return f"concat('复试', {play}, '各', {amount('0')}, {NL}, {first}, {NL}, {rest})"


def mixed_pool_text(t) -> str:
    return f"concat({mixed_block_text(t)}, {NL}, {zodiac_pool_text(t)})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows of a task: some seconds of work where a row becomes a slip or an image.
TASK_ROWS = 50_000


def spread(rows: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Deal the rows evenly, while they are still narrow, where splits hold too few or too many of them.

    The number of splits says little: a split without the middle of a row group is empty, so a file of few large row groups
    is read by few tasks however many splits it has. So the rows of each split are counted, which reads footers only. Tasks
    grow in number with the rows, not in size; rows that lie evenly already stay where they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    held = rows.groupBy(F.spark_partition_id().alias("split")).agg(F.count("*").alias("n"))
    largest, total = held.agg(F.max("n"), F.sum("n")).first()
    tasks = max(cores, -(-(total or 0) // task_rows))
    return rows if (largest or 0) * tasks <= 2 * (total or 0) else rows.repartition(tasks)


def keyed_from(orders: DataFrame) -> DataFrame:
    return orders.selectExpr("o_orderkey AS k", "o_custkey AS c", "cast(o_orderdate AS date) AS draw_date")


def keyed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(keyed_from(table(spark, sf_dir, "orders")))


# Some slips lack a text, some days a draw; some images come without scores or blank cells, some requests without client.
ABSENT = {"pingma": "k % 41 = 3", "lianma": "k % 43 = 5", "fushi": "k % 47 = 7"}
UNDRAWN = "d % 13 = 6"
NO_SCORES, NO_BLANKS = "k % 29 = 4", "k % 23 = 9"
NO_CLIENT = "event_id % 31 = 0"


def present(mode: str, text: str) -> str:
    return f"CASE WHEN {ABSENT[mode]} THEN NULL ELSE {text} END"


def slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide slips, one per order."""
    return slips_from(keyed_orders(spark, sf_dir))


def slips_from(keyed: DataFrame, *more: str) -> DataFrame:
    t = SparkText
    return keyed.selectExpr(
        "k AS slip_id",
        "draw_date",
        *more,
        f"{present('pingma', pingma_text(t))} AS pingma",
        f"{present('lianma', listed_text(t))} AS lianma",
        f"{present('fushi', fushi_text(t))} AS fushi",
    )


# Slips of several lotteries a day, on days that the feed covers.
LOTTERIES = ["click", "error", "purchase", "signup", "view"]
FEED_START, FEED_DAYS = "2024-01-01", 33


def lottery_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide slips keyed by lottery and the feed's date text."""
    keyed = slips(spark, sf_dir).drop("draw_date")
    return keyed.selectExpr(
        "*",
        f"{SparkText.pick(LOTTERIES, 'slip_id % 5')} AS lottery_type",
        f"cast(date_add(DATE '{FEED_START}', cast(slip_id % {FEED_DAYS} AS int)) AS string) AS date",
    )


def texts(spark: SparkSession, sf_dir: str, render) -> DataFrame:
    """(slip_id, text) of one kind, one per order."""
    return keyed_orders(spark, sf_dir).selectExpr("k AS slip_id", f"{render(SparkText)} AS text")


def mixed_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed texts, one per order: listed combinations, chatter, pools, straight bets."""
    t = SparkText
    parts = [mixed_listed_text(t), "'收到，谢谢'", mixed_pool_text(t), mixed_pingma_text(t)]
    return keyed_orders(spark, sf_dir).selectExpr(
        "k AS slip_id", "draw_date", f"concat({f', {NL}, '.join(parts)}) AS raw_text"
    )


def draw_number(i: str) -> str:
    return f"((d * 5 + {i} * 11) % 49 + 1)"


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One draw per order date but for undrawn ones; every third draw comes without zodiacs."""
    return draws_from(table(spark, sf_dir, "orders"))


def draws_from(orders: DataFrame) -> DataFrame:
    return draws_of(orders.selectExpr("cast(o_orderdate AS date) AS draw_date").distinct())


def draws_of(dated: DataFrame, *more: str) -> DataFrame:
    """A draw for each date."""
    t = SparkText
    day = dated.withColumn("d", F.datediff("draw_date", F.lit("1995-01-01").cast("date"))).where(f"NOT {UNDRAWN}")
    return day.selectExpr(
        "draw_date",
        *more,
        f"cast({t.each('7', 'i', draw_number('i'))} AS array<int>) AS numbers",
        f"cast({draw_number('6')} AS int) AS special",
        f"CASE WHEN d % 3 = 0 THEN array('') ELSE {t.each('7', 'i', t.pick(ZODIACS, f'({draw_number("i")} - 1) % 12'))} END AS zodiacs",
    )


# Slips come up to two and a half days before or after noon of their day, the draw in the evening.
ARRIVED = "cast(draw_date AS timestamp) + (k % 5 - 2) * INTERVAL 1 DAY + (k % 24) * INTERVAL 1 HOUR AS arrived_at"
SYNCED = "cast(draw_date AS timestamp) + INTERVAL '21:30' HOUR TO MINUTE AS synced_at"


# Polls: one per event. Issues change by day; some polls bring six numbers, an error code, or broken JSON.
FEED_DAY = "day(cast(ts AS date))"


def feed_number(i: str) -> str:
    return f"((d * 5 + t * 3 + {i} * 11) % 49 + 1)"


def feed_from(events: DataFrame) -> DataFrame:
    t = SparkText
    keyed = events.selectExpr(
        "event_id", "event_type AS lottery_type", "ts", f"{FEED_DAY} AS d", "length(event_type) AS t"
    )
    count = "CASE WHEN event_id % 97 = 0 THEN 6 ELSE 7 END"
    number = f"CASE WHEN i = 0 THEN cast({feed_number('i')} AS string) ELSE concat(' ', {nn(feed_number('i'))}) END"
    zodiac = t.pick(ZODIACS, f"({feed_number('i')} - 1) % 12")
    element = t.pick(["金", "木", "水", "火", "土"], f"{feed_number('i')} % 5")
    item = (
        "named_struct('id', event_id, 'year', 2024, 'qishu', 2024000 + d, 'date', cast(cast(ts AS date) AS string), "
        f"'num', {t.join(t.each(count, 'i', number), _quoted(','))}, "
        f"'shengxiao', CASE WHEN event_id % 89 = 0 THEN '' ELSE {t.join(t.each('7', 'i', zodiac), _quoted(','))} END, "
        f"'wuxing', {t.join(t.each('7', 'i', element), _quoted(','))}, 'nqi', 2024001 + d)"
    )
    body = (
        "CASE WHEN event_id % 103 = 0 THEN '<html>' WHEN event_id % 101 = 0 THEN '{\"code\":0,\"msg\":\"busy\",\"data\":[]}' "
        f"ELSE to_json(named_struct('code', 1, 'msg', '', 'data', array({item}))) END"
    )
    return keyed.selectExpr("event_id", "lottery_type", "cast(ts AS timestamp) AS ts", f"{body} AS payload")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_from(spread(table(spark, sf_dir, "events")))


REQUEST = (f"CASE WHEN {NO_CLIENT} THEN NULL ELSE user_id END AS client", "cast(ts AS timestamp) AS ts", "event_id AS request_id")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log: one request per event."""
    return table(spark, sf_dir, "events").selectExpr(
        *REQUEST
    )


# Images: one per order. Boxes are 20 px wide and 10 px high around a centre.
IMAGE_WIDTH = "(800 + c % 5 * 100)"
IMAGE_HEIGHT = "(900 + k % 3 * 150)"
IMAGE_BOXES = "(8 + (k + c) % 9)"
READINGS = "(4 + (k + c) % 7)"


def box_x(i: str) -> str:
    return f"((k * 37 + c * 11 + {i} * {i} * 53 + {i} * 101) % {IMAGE_WIDTH})"


def box_y(i: str) -> str:
    return f"((k * 91 + c * 17 + {i} * {i} * 29 + {i} * 67) % {IMAGE_HEIGHT})"


def box_score(i: str) -> str:
    return f"(cast(50 + (k * 3 + {i} * 13) % 51 as double) / 100)"


def box_amount(i: str) -> str:
    return f"((k + c * 7 + {i} * 31) % 12000 - 50)"


def box_text(i: str) -> str:
    """Digits as recognised: some are read as letters, some amounts are out of range or carry noise."""
    plain = f"cast({box_amount(i)} as string)"
    return f"CASE WHEN {i} % 3 = 0 THEN translate({plain}, '015', 'OlS') WHEN {i} % 3 = 1 THEN concat({plain}, '元') ELSE {plain} END"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = SparkText
    x, y = box_x("i"), box_y("i")
    corner = lambda dx, dy: f"array(cast({x} + {dx} AS double), cast({y} + {dy} AS double))"
    box = f"array({corner(-10, -5)}, {corner(10, -5)}, {corner(10, 5)}, {corner(-10, 5)})"
    return keyed_orders(spark, sf_dir).selectExpr(
        "k AS image_id",
        f"cast({IMAGE_WIDTH} AS int) AS width",
        f"cast({IMAGE_HEIGHT} AS int) AS height",
        f"{t.each(IMAGE_BOXES, 'i', box)} AS boxes",
        f"{t.each(IMAGE_BOXES, 'i', box_text('i'))} AS txts",
        f"CASE WHEN {NO_SCORES} THEN NULL ELSE {t.each(f'({IMAGE_BOXES} - k % 2)', 'i', box_score('i'))} END AS scores",
    )


# Chat images: one per order, batches by customer; a line of the mixed text is a box, and the engine reads some images from the end.
CHAT_BATCH_DAY = "date_add(DATE '1995-01-01', cast(c % 700 AS int))"
SILENT = "k % 11 = 5"


def chat_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch_id, seq, image_id, boxes, txts, scores; images of nothing but chatter among them."""
    t = SparkText
    parts = [mixed_listed_text(t), "'收到，谢谢'", mixed_pool_text(t), mixed_pingma_text(t)]
    text = f"CASE WHEN {SILENT} THEN '收到，谢谢' ELSE concat({f', {NL}, '.join(parts)}) END"
    lines = keyed_orders(spark, sf_dir).selectExpr("k", "c", f"split({text}, {NL}) AS lines")
    corner = lambda x, dy: f"array(cast({x} AS double), cast(20 + 40 * i + {dy} AS double))"
    box = f"transform(lines, (l, i) -> array({corner(50, -8)}, {corner(400, -8)}, {corner(400, 8)}, {corner(50, 8)}))"
    turned = lambda items: f"CASE WHEN k % 2 = 0 THEN {items} ELSE reverse({items}) END"
    return lines.selectExpr("c AS batch_id", "k AS seq", "k AS image_id", f"{turned(box)} AS boxes", f"{turned('lines')} AS txts", "cast(NULL AS array<double>) AS scores")


def batch_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of the days on which batches are settled."""
    return draws_of(keyed_orders(spark, sf_dir).selectExpr(f"{CHAT_BATCH_DAY} AS draw_date").distinct())


# Images of three sources; two have a layout of their own, one of them with cells that overlap.
IMAGE_SOURCES = ["app", "web", "old"]
LAYOUT_OVERRIDES = [("web", "tableX", 0.1), ("web", "rowHeight", 0.06), ("web", "colour", 1.0), ("old", "paddingY", -0.02), ("old", "groupWidth", 0.2), ("none", "tableX", 0.9)]


def image_source(k: str) -> str:
    return f"CASE {k} % 3 WHEN 0 THEN 'app' WHEN 1 THEN 'web' ELSE 'old' END"


def reading_number(i: str) -> str:
    return f"((k * 5 + {i} * {i} * 7 + c) % 49 + 1)"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second pass over the same images; every eleventh cell is blank."""
    t = SparkText
    one = (
        f"named_struct('number', cast({reading_number('i')} AS int), 'seq', i, 'text', {box_text('(i + 1)')}, "
        f"'score', {box_score('(i + 5)')})"
    )
    return keyed_orders(spark, sf_dir).selectExpr(
        "k AS image_id", f"{t.each(READINGS, 'i', one)} AS readings", f"CASE WHEN {NO_BLANKS} THEN NULL ELSE array(11, 22, 33, 44) END AS blank"
    )


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw chat texts: every conversation turn and every document, whole, with bet lines after it."""
    turns = spread(table(spark, sf_dir, "conversations")).selectExpr(
        "'turn' AS source", "conv_id * 1000 + turn AS chat_id", "text", "turn + conv_id AS n"
    )
    docs = spread(table(spark, sf_dir, "documents")).selectExpr("'document' AS source", "doc_id AS chat_id", "text", "doc_id AS n")
    return turns.unionByName(docs).selectExpr("source", "chat_id", f"{chat_text()} AS text")


def chat_text() -> str:
    """A slash bet and a Chinese-amount bet, both cut over lines, then chatter; the same in both dialects."""
    return (
        f"concat(text, {NL}, cast(n % 49 + 1 as string), '..', cast(n % 40 + 5 as string), '/', cast(n % 9 + 1 as string), {NL}, "
        f"cast(n % 10 as string), {NL}, '5号6号各下', {NL}, cast(n % 900 + 1 as string), '元', {NL}, '好的 ok', {NL}, "
        f"cast(n % 99 as string))"
    )


# Lines: one per line item; p and s are the part and supplier key, o the order key, q the quantity.
def keyed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(
        table(spark, sf_dir, "lineitem").selectExpr(
            "l_orderkey AS o", "l_partkey AS p", "l_suppkey AS s", "l_linenumber AS ln", "cast(l_quantity AS int) AS q"
        )
    )


def lines(spark: SparkSession, sf_dir: str, expression: str) -> DataFrame:
    """One text line per line item."""
    return keyed_lines(spark, sf_dir).selectExpr("o", "p", "s", "ln", "q", f"{expression} AS line")
