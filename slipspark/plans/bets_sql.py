"""Checking SQL for the slip queries: bets, hits and totals computed from the numbers, without reading any text."""

from __future__ import annotations

from slipspark import dims
from slipspark.plans.lines_sql import BASE
from slipspark.sources import fixtures as fx

T = fx.CheckText


def _int(x: str) -> str:
    return f"CAST({x} AS INTEGER)"


def _per(count: str, name: str = "g", source: str = "base") -> str:
    """Source rows repeated ``count`` times, counting in a column."""
    return f"(SELECT *, unnest(range(0, {_int(count)})) AS {name} FROM {source} WHERE {count} > 0)"


def suffix(position: str) -> str:
    return f"CASE WHEN {position} > 0 THEN concat(' 第', {position} + 1, '组') ELSE '' END"


def zodiac_at(index: str) -> str:
    return T.pick(fx.ZODIACS, index)


def zodiac_of(number: str) -> str:
    return zodiac_at(f"(({number}) - 1) % 12")


def zodiac_numbers(index: str) -> str:
    return f"list_filter(range(1, 50), lambda x: (x - 1) % 12 = {index})"


HALF = lambda when: f"CASE WHEN {when} THEN 0.5 ELSE 0 END"
COLUMNS = "k, draw_date, mode, fam, pos, family, kind, user_name, play, label, nums, combos, zods, amt, units, pick, odds"
NO_LISTS = "CAST(NULL AS BIGINT[][]) AS combos, CAST(NULL AS VARCHAR[]) AS zods"


def straight(fam: int, family: str, name: str, nums: str, amt: str, source: str, label: str = "NULL", where: str = "true") -> str:
    return (
        f"SELECT k, draw_date, 'pingma' AS mode, {fam} AS fam, g AS pos, '{family}' AS family, 'straight' AS kind, "
        f"{name} AS user_name, CAST(NULL AS VARCHAR) AS play, {label} AS label, {nums} AS nums, {NO_LISTS}, "
        f"CAST({amt} AS DOUBLE) AS amt, len({nums}) AS units, 1 AS pick, 47 AS odds FROM {source} WHERE {where}"
    )


def pool(fam: int, family: str, pos: str, name: str, play: str, nums: str, amt: str, source: str, where: str) -> str:
    pick = f"CASE WHEN {play} = '二中二' THEN 2 ELSE 3 END"
    n = f"CAST(len({nums}) AS BIGINT)"
    units = f"CASE WHEN {play} = '二中二' THEN {n} * ({n} - 1) / 2 ELSE {n} * ({n} - 1) * ({n} - 2) / 6 END"
    return (
        f"SELECT k, draw_date, 'fushi' AS mode, {fam} AS fam, {pos} AS pos, '{family}' AS family, 'pool' AS kind, "
        f"{name} AS user_name, {play} AS play, {play} AS label, {nums} AS nums, {NO_LISTS}, CAST({amt} AS DOUBLE) AS amt, "
        f"CAST({units} AS BIGINT) AS units, {pick} AS pick, CASE WHEN {play} = '二中二' THEN 65 ELSE 200 END AS odds "
        f"FROM {source} WHERE {where}"
    )


SLASH_NUMS = T.each(fx.slash_size("g"), "j", fx.bag("g", "j"))
CN_NUMS = T.each(fx.cn_size("g"), "j", fx.bag("g + 20", "j"))
SLASH = _per(fx.SLASH_GROUPS)
CN = _per(fx.CN_GROUPS)
ZOD = _per(fx.ZODIAC_BETS)
SLASH_LINES = f"(CASE {fx.SLASH_FORM} WHEN 1 THEN 1 WHEN 2 THEN 2 * {fx.SLASH_GROUPS} ELSE {fx.SLASH_GROUPS} END)"
CN_LINES = f"(CASE {fx.CN_FORM} WHEN 0 THEN {fx.CN_GROUPS} WHEN 1 THEN 1 ELSE 2 * {fx.CN_GROUPS} END)"


def slash_by_line(where: str = "true") -> str:
    name = f"CASE {fx.SLASH_FORM} WHEN 1 THEN concat('第1行', {suffix('g')}) WHEN 3 THEN concat('第', g + 1, '行') ELSE {fx.NAME} END"
    return straight(0, "slash", name, SLASH_NUMS, fx.amount("g"), SLASH, where=where)


def slash_rebuilt(where: str = "true") -> str:
    amt = f"{fx.amount('g')} * CASE WHEN {fx.SLASH_FORM} = 2 THEN 10 ELSE 1 END"
    return straight(0, "slash_wrapped", "concat('第', g + 1, '组')", SLASH_NUMS, amt, SLASH, where=where)


def cn_by_line(first_line: str) -> str:
    name = f"CASE WHEN {fx.CN_FORM} = 0 THEN {fx.NAME} ELSE concat('第', {first_line} + 1, '行', {suffix('g')}) END"
    amt = f"{fx.amount('g + 20')} + {HALF('k % 2 = 1')}"
    return straight(1, "cn", name, CN_NUMS, amt, CN, where=f"{fx.CN_FORM} <> 2")


def cn_rebuilt(where: str) -> str:
    return straight(1, "cn_wrapped", "concat('第', g + 1, '组')", CN_NUMS, fx.amount("g + 20"), CN, where=where)


def zodiac_bets(line: str) -> str:
    index = fx.zodiac_index("g")
    name = f"concat('第', {line} + 1, '行', {suffix('g')})"
    amt = f"{fx.amount('g + 5')} + {HALF('c % 2 = 1')}"
    return straight(2, "zodiac", name, zodiac_numbers(index), amt, ZOD, label=zodiac_at(index))


def blocks() -> str:
    size = f"CASE WHEN {fx.BLOCK_FORM} = 2 THEN 3 ELSE 3 + {fx.BLOCK_REST} END"
    play = T.pick(fx.BLOCK_PLAYS, "k % 4")
    amt = f"{fx.amount('0')} + {HALF(f'{fx.BLOCK_FORM} = 2')}"
    nums = T.each(f"({size})", "j", fx.distinct("0", "j"))
    return pool(0, "pool_block", "0", f"concat('第1行 复式', {play})", play, nums, amt, "base", "k % 4 < 3")


def inline_pools() -> str:
    play = T.pick(fx.INLINE_PLAYS, "c % 3")
    first = T.each(fx.INLINE_SIZE, "j", fx.distinct("3", "j"))
    valid = f"(c % 3 = 0 OR (c % 3 = 1 AND {fx.INLINE_SIZE} >= 3))"
    amt = f"{fx.amount('3')} + {HALF('k % 2 = 1')}"
    one = pool(1, "pool_inline", "0", play, play, first, amt, "base", valid)
    name = f"concat({play}, CASE WHEN {valid} THEN ' 第2组' ELSE '' END)"
    two = pool(1, "pool_inline", "1", name, "'三中三'", T.each("4", "j", fx.distinct("4", "j")), fx.amount("4"), "base", "k % 3 = 0")
    return f"{one} UNION ALL {two}"


def zodiac_pools(line: str) -> str:
    zods = T.each("4", "i", zodiac_at(fx.pool_zodiac_index("i")))
    nums = f"list_filter(range(1, 50), lambda x: list_contains({zods}, {zodiac_of('x')}))"
    return (
        f"SELECT k, draw_date, 'fushi' AS mode, 2 AS fam, 0 AS pos, 'zodiac_pool' AS family, 'zodiac' AS kind, "
        f"concat('第', {line} + 1, '行') AS user_name, '复四三' AS play, '复四三' AS label, {nums} AS nums, "
        f"CAST(NULL AS BIGINT[][]) AS combos, {zods} AS zods, CAST({fx.amount('6')} AS DOUBLE) AS amt, 4 AS units, "
        f"3 AS pick, 200 AS odds FROM base WHERE k % 7 <> 0"
    )


def listed() -> str:
    pick = fx.LISTED_PICK
    line = lambda g: T.each(pick, "j", fx.distinct(g, "j"))
    combos = (
        f"list_concat({T.each(fx.LISTED_LINES, 'g', line('(g + 5)'))}, CASE WHEN k % 2 = 1 THEN [{line('9')}] ELSE [] END)"
    )
    play = T.pick(["二中二", "三中三"], "c % 2")
    return (
        f"SELECT k, draw_date, 'lianma' AS mode, 0 AS fam, 0 AS pos, 'listed' AS family, 'listed' AS kind, "
        f"concat('第', CASE WHEN k % 5 = 0 THEN 3 ELSE 1 END, '行 ', {play}) AS user_name, {play} AS play, {play} AS label, "
        f"list_distinct(flatten({combos})) AS nums, {combos} AS combos, CAST(NULL AS VARCHAR[]) AS zods, "
        f"CAST({fx.amount('9')} AS DOUBLE) AS amt, len({combos}) AS units, {pick} AS pick, "
        f"CASE WHEN c % 2 = 0 THEN 65 ELSE 200 END AS odds FROM base"
    )


def dotted(items: str) -> str:
    return f"array_to_string({items}, '.')"


ZODIAC_POOL_LINE = f"(CASE {fx.BLOCK_FORM} WHEN 1 THEN 3 WHEN 0 THEN 4 ELSE 5 END)"
RAW = (
    f"raw AS ({slash_by_line(f'{fx.SLASH_FORM} <> 2')} UNION ALL {slash_rebuilt(f'{fx.SLASH_FORM} = 2')} "
    f"UNION ALL {cn_by_line(SLASH_LINES)} UNION ALL {cn_rebuilt(f'{fx.CN_FORM} = 2')} "
    f"UNION ALL {zodiac_bets(f'({SLASH_LINES} + {CN_LINES})')} UNION ALL {blocks()} UNION ALL {inline_pools()} "
    f"UNION ALL {zodiac_pools(ZODIAC_POOL_LINE)} UNION ALL {listed()})"
)
GONE = " OR ".join(f"mode = '{mode}' AND {when}" for mode, when in fx.ABSENT.items())
GROUPS = f"{BASE}, {RAW}, groups AS (SELECT *, row_number() OVER (PARTITION BY k, mode ORDER BY fam, pos) - 1 AS ord FROM raw WHERE NOT ({GONE}))"
DRAWS = f"""
days AS (SELECT DISTINCT draw_date, date_diff('day', DATE '1995-01-01', draw_date) AS d FROM base),
draws AS (SELECT draw_date, CAST({fx.draw_number('6')} AS INTEGER) AS special,
  list_prepend({fx.draw_number('6')}, {T.each('6', 'i', fx.draw_number('i'))}) AS drawn,
  {zodiac_of(fx.draw_number('6'))} AS draw_zodiac, {T.each('7', 'i', zodiac_of(fx.draw_number('i')))} AS drawn_zodiacs FROM days WHERE NOT {fx.UNDRAWN})"""


def settled_from(groups: str) -> str:
    zodiac_hits = "len(list_filter(zods, lambda z: list_contains(drawn_zodiacs, z)))"
    won = "list_filter(combos, lambda cb: len(list_filter(cb, lambda x: list_contains(drawn, x))) >= pick)"
    return f"""
hit AS (SELECT s.*, special, draw_zodiac, CAST(CASE kind
    WHEN 'straight' THEN len(list_filter(nums, lambda x: x = special))
    WHEN 'pool' THEN len(list_filter(nums, lambda x: list_contains(drawn, x)))
    WHEN 'listed' THEN len({won})
    ELSE CASE {zodiac_hits} WHEN 4 THEN 4 WHEN 3 THEN 1 ELSE 0 END END AS BIGINT) AS hit_count
  FROM {groups} s LEFT JOIN draws USING (draw_date)),
settled AS (SELECT *, CAST(w AS BIGINT) AS win_units, w * amt * odds AS win_amount FROM (SELECT *, CASE WHEN kind <> 'pool' THEN hit_count
    WHEN pick = 2 THEN hit_count * (hit_count - 1) / 2 ELSE hit_count * (hit_count - 1) * (hit_count - 2) / 6 END AS w FROM hit))"""


SETTLED = f"{GROUPS}, {DRAWS}, {settled_from('groups')}"


def number_text(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


EACH = number_text("amt")
HIT_TEXT = (
    f"CASE kind WHEN 'pool' THEN concat('复式', play, '，', len(nums), '码共', units, '组，命中', hit_count, '码/', win_units, '组，', {EACH}, '一组') "
    f"WHEN 'zodiac' THEN concat('生肖', play, '，', array_to_string(zods, ''), '共4组，命中', win_units, '组，', {EACH}, '一组') "
    f"WHEN 'listed' THEN concat('连码', play, '，列出', units, '组，命中', win_units, '组，', {EACH}, '一组') "
    f"ELSE concat({fx.nn('special')}, '号 / ', draw_zodiac, '，', CASE WHEN label IS NULL THEN '' ELSE concat(label, '肖，') END, "
    f"'命中', hit_count, '码，', len(nums), '码各', {EACH}) END"
)
TOTALS = (
    "CAST(sum(units * amt) AS DOUBLE) AS total_bet_amount, CAST(sum(win_amount) AS DOUBLE) AS total_win_amount, "
    "CAST(sum(len(nums)) AS BIGINT) AS entry_count, count(*) AS group_count"
)
PER_MODE = f"""
modes AS (SELECT unnest(['pingma', 'lianma', 'fushi']) AS mode, unnest([0, 1, 2]) AS mode_ord),
sums AS (SELECT k, mode, {TOTALS}, count(*) FILTER (win_units > 0) AS winner_count FROM settled GROUP BY k, mode),
per_mode AS (SELECT k, draw_date, mode, coalesce(total_bet_amount, 0) AS total_bet_amount, coalesce(total_win_amount, 0) AS total_win_amount,
  coalesce(entry_count, 0) AS entry_count, coalesce(group_count, 0) AS group_count, coalesce(winner_count, 0) AS winner_count
  FROM base CROSS JOIN modes LEFT JOIN sums USING (k, mode))"""
SUMMED = (
    "CAST(sum(total_bet_amount) AS DOUBLE) AS total_bet_amount, CAST(sum(total_win_amount) AS DOUBLE) AS total_win_amount, "
    "CAST(sum(entry_count) AS BIGINT) AS entry_count, CAST(sum(group_count) AS BIGINT) AS group_count"
)
STATUS = "concat('已解析 ', group_count, ' 组，共 ', entry_count, ' 个号码，命中 ', winner_count, ' 组')"


def _extraction(groups: str, *columns: str) -> str:
    extra = {
        "numbers": f"{dotted('nums')} AS numbers",
        "number_set": f"{dotted('list_sort(nums)')} AS number_set",
        "label": "label",
        "play": "play",
        "combo_count": "CAST(units AS BIGINT) AS combo_count",
    }
    shown = ", ".join(extra[c] for c in columns)
    return (
        f"WITH {BASE}, raw AS ({groups}) SELECT k AS slip_id, row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS ord, "
        f"user_name, amt AS amount, CAST(units * amt AS DOUBLE) AS bet_amount, {shown} FROM raw"
    )


def _hits(kind: str) -> str:
    return f"WITH {SETTLED} SELECT k AS slip_id, mode, ord, hit_count, win_units FROM settled WHERE kind = '{kind}' AND hit_count > 0"


# Mixed texts: the renderer knows the bucket of every line.
# A pool line of four zodiacs that repeat is no bet, so classification drops it.
TIDY_POOL = f"CASE WHEN k % 7 = 0 THEN {fx.mixed_block_text(T)} ELSE {fx.mixed_pool_text(T)} END"
MIXED_PINGMA_SLASH = straight(1, "slash", "''", SLASH_NUMS, fx.amount("g"), SLASH)
MIXED_CN = (
    straight(0, "cn", "''", T.each(fx.cn_size("0"), "j", fx.bag("20", "j")), fx.amount("20"), "base", where="true").replace(
        "g AS pos", "0 AS pos"
    )
)
MIXED_ZODIAC = straight(
    2, "zodiac", "''", zodiac_numbers(fx.zodiac_index("0")), fx.amount("5"), "base", label=zodiac_at(fx.zodiac_index("0"))
).replace("g AS pos", "0 AS pos")
MIXED_BLOCK = pool(
    0,
    "pool_block",
    "0",
    "''",
    T.pick(fx.BLOCK_PLAYS, "k % 4"),
    T.each("(5 + k % 3)", "j", fx.distinct("0", "j")),
    fx.amount("0"),
    "base",
    "k % 4 < 3",
)
_LISTED_LINE = lambda g: T.each(fx.LISTED_PICK, "j", fx.distinct(g, "j"))
_MIXED_COMBOS = f"list_concat({T.each(fx.LISTED_LINES, 'g', _LISTED_LINE('(g + 5)'))}, [{_LISTED_LINE('9')}])"
MIXED_LISTED = (
    f"SELECT k, draw_date, 'lianma' AS mode, 0 AS fam, 0 AS pos, 'listed' AS family, 'listed' AS kind, '' AS user_name, "
    f"'' AS play, '' AS label, list_distinct(flatten({_MIXED_COMBOS})) AS nums, {_MIXED_COMBOS} AS combos, "
    f"CAST(NULL AS VARCHAR[]) AS zods, CAST({fx.amount('9')} AS DOUBLE) AS amt, len({_MIXED_COMBOS}) AS units, "
    f"{fx.LISTED_PICK} AS pick, CASE WHEN c % 2 = 0 THEN 65 ELSE 200 END AS odds FROM base"
)
MIXED = (
    f"mixed AS ({MIXED_PINGMA_SLASH} UNION ALL {MIXED_CN} UNION ALL {MIXED_ZODIAC} UNION ALL {MIXED_BLOCK} "
    f"UNION ALL {zodiac_pools('0')} UNION ALL {MIXED_LISTED})"
)
MIXED_SETTLED = f"{BASE}, {MIXED}, {DRAWS}, {settled_from('mixed')}"
EMPTY = dims.EMPTY_STATUS
REPORT_HEAD = (
    f"concat('开奖号：', {fx.nn('special')}, chr(10), '开奖生肖：', draw_zodiac, chr(10), '总赌注金额：', {number_text('bet')}, chr(10), "
    f"'总中奖金额：', {number_text('win')}, chr(10), '投注组数：', groups, chr(10), '投注号码数：', entries, chr(10), '中奖名单：', chr(10), "
)
APPEND_CURRENT = f"CASE WHEN k % 3 = 0 THEN NULL ELSE {fx.zodiac_text(T)} END"
APPEND_ADDITION = f"CASE WHEN c % 4 = 0 THEN NULL ELSE {fx.zodiac_pool_text(T)} END"

SQL = {
    "bets_slash": _extraction(slash_by_line(), "numbers"),
    "bets_cn": _extraction(cn_by_line("0"), "numbers"),
    "bets_zodiac": _extraction(zodiac_bets("0"), "label", "numbers"),
    "bets_pool_inline": _extraction(inline_pools(), "play", "combo_count", "numbers"),
    "bets_zodiac_pool": _extraction(zodiac_pools("0"), "combo_count", "number_set"),
    "bets_slash_wrapped": _extraction(slash_rebuilt(), "numbers"),
    "bets_cn_wrapped": _extraction(cn_rebuilt(f"{fx.CN_FORM} = 2 OR k % 2 = 0"), "numbers"),
    "bets_pool_block": _extraction(blocks(), "play", "combo_count", "numbers"),
    "bets_listed": _extraction(listed(), "play", "combo_count", "number_set"),
    "bets_all": f"""
WITH {GROUPS} SELECT k AS slip_id, mode, ord, family, {dotted('list_sort(nums)')} AS number_set, amt AS amount,
  CAST(units * amt AS DOUBLE) AS bet_amount FROM groups""",
    "group_names": f"""
WITH {GROUPS} SELECT mode, family, user_name, count(*) AS groups, CAST(sum(units * amt) AS DOUBLE) AS stake
FROM groups GROUP BY 1, 2, 3""",
    "classify_lines": f"""
WITH {BASE} SELECT k AS slip_id, {fx.mixed_pingma_text(T)} AS pingma, {fx.mixed_listed_text(T)} AS lianma, {TIDY_POOL} AS fushi
FROM base""",
    "classify_settle": f"""
WITH {MIXED_SETTLED}, modes AS (SELECT unnest(['pingma', 'lianma', 'fushi']) AS mode)
SELECT CAST(draw_date AS VARCHAR) AS draw_date, mode, coalesce(CAST(sum(units * amt) AS DOUBLE), 0) AS total_bet_amount,
  coalesce(CAST(sum(win_amount) AS DOUBLE), 0) AS total_win_amount, CAST(coalesce(sum(len(nums)), 0) AS BIGINT) AS entry_count,
  count(s.k) AS group_count, count(*) FILTER (win_units > 0) AS winner_count
FROM days CROSS JOIN modes LEFT JOIN settled s USING (draw_date, mode) GROUP BY 1, 2""",
    "append_texts": f"""
WITH {BASE}, t AS (SELECT k, {APPEND_CURRENT} AS a, {APPEND_ADDITION} AS b FROM base)
SELECT k AS slip_id, concat_ws(chr(10), a, b) AS joined, concat_ws(chr(10), a, b, '0') AS image_texts FROM t""",
    "combination_enum": f"""
WITH {BASE}, z AS (SELECT {T.each('4', 'i', zodiac_at(fx.pool_zodiac_index('i')))} AS z FROM base WHERE k % 7 <> 0),
e AS (SELECT unnest([concat(z[1], z[2], z[3]), concat(z[1], z[2], z[4]), concat(z[1], z[3], z[4]), concat(z[2], z[3], z[4])]) AS combo FROM z)
SELECT combo, count(*) AS groups FROM e GROUP BY 1""",
    "drawn_set": f"""
WITH {BASE}, {DRAWS} SELECT CAST(draw_date AS VARCHAR) AS draw_date, {dotted('drawn')} AS drawn,
  CAST(list_sum(list_transform(drawn, lambda x: 1::HUGEINT << CAST(x AS INTEGER))) AS BIGINT) AS drawn_mask FROM draws""",
    "drawn_zodiacs": f"""
WITH {BASE}, {DRAWS} SELECT CAST(draw_date AS VARCHAR) AS draw_date, draw_zodiac,
  array_to_string(list_sort(list_distinct(drawn_zodiacs)), '') AS zodiacs FROM draws""",
    "settle_all": f"WITH {SETTLED} SELECT k AS slip_id, mode, ord, hit_count, win_units, CAST(win_amount AS DOUBLE) AS win_amount FROM settled",
    "hit_straight": _hits("straight"),
    "hit_pool": _hits("pool"),
    "hit_listed": _hits("listed"),
    "hit_zodiac": _hits("zodiac"),
    "payout": f"""
WITH {SETTLED} SELECT CAST(draw_date AS VARCHAR) AS draw_date, kind, count(*) AS groups, CAST(sum(win_units) AS BIGINT) AS win_units,
  CAST(sum(win_amount) AS DOUBLE) AS win_amount FROM settled GROUP BY 1, 2""",
    "winners": f"""
WITH {SETTLED} SELECT k AS slip_id, mode, ord, user_name, CAST(win_amount AS DOUBLE) AS win_amount FROM settled WHERE win_units > 0""",
    "hit_text": f"WITH {SETTLED} SELECT k AS slip_id, mode, ord, {HIT_TEXT} AS hit_content FROM settled WHERE win_units > 0",
    "summary_mode": f"""
WITH {SETTLED}, {PER_MODE} SELECT k AS slip_id, mode, total_bet_amount, total_win_amount, entry_count, group_count FROM per_mode""",
    "summary_all": f"""
WITH {SETTLED}, {PER_MODE} SELECT k AS slip_id, {SUMMED}, CAST(sum(winner_count) AS BIGINT) AS winner_count FROM per_mode GROUP BY k""",
    "summary_draft": f"""
WITH {GROUPS} SELECT k AS slip_id, coalesce(CAST(sum(units * amt) AS DOUBLE), 0) AS total_bet_amount, CAST(0 AS DOUBLE) AS total_win_amount,
  coalesce(CAST(sum(len(nums)) AS BIGINT), 0) AS entry_count, count(mode) AS group_count FROM base LEFT JOIN groups USING (k) GROUP BY k""",
    "summary_draw": f"""
WITH {SETTLED}, {PER_MODE} SELECT CAST(draw_date AS VARCHAR) AS draw_date, mode, {SUMMED},
  CAST(sum(winner_count) AS BIGINT) AS winner_count, count(*) AS slips FROM per_mode GROUP BY 1, 2""",
    "summary_rollup": f"""
WITH {SETTLED}, {PER_MODE} SELECT CAST(grouping(draw_date, mode) AS INTEGER) AS level, CAST(draw_date AS VARCHAR) AS draw_date, mode, {SUMMED},
  CAST(sum(winner_count) AS BIGINT) AS winner_count, count(DISTINCT k) AS slips FROM per_mode GROUP BY ROLLUP (draw_date, mode)""",
    "status_text": f"""
WITH {SETTLED}, {PER_MODE}, said AS (
  SELECT 'settled' AS kind, mode, CASE WHEN group_count > 0 THEN {STATUS} WHEN mode = 'pingma' THEN '{EMPTY['pingma']}'
    WHEN mode = 'lianma' THEN '{EMPTY['lianma']}' ELSE '{EMPTY['fushi']}' END AS status FROM per_mode
  UNION ALL SELECT 'crossed', mode, CASE mode WHEN 'pingma' THEN '{EMPTY['pingma']}' WHEN 'lianma' THEN '{EMPTY['lianma']}'
    ELSE '{EMPTY['fushi']}' END FROM base CROSS JOIN modes
  UNION ALL SELECT 'whole', 'all', CASE WHEN group_count > 0 THEN {STATUS} ELSE '{dims.EMPTY_STATUS_ALL}' END FROM (SELECT k, CAST(sum(group_count) AS BIGINT) AS group_count,
    CAST(sum(entry_count) AS BIGINT) AS entry_count, CAST(sum(winner_count) AS BIGINT) AS winner_count FROM per_mode GROUP BY k))
SELECT kind, mode, status, count(*) AS slips FROM said GROUP BY 1, 2, 3""",
    "report_text": f"""
WITH {SETTLED}, {PER_MODE}, t AS (SELECT k, sum(total_bet_amount) AS bet, sum(total_win_amount) AS win,
  CAST(sum(group_count) AS BIGINT) AS groups, CAST(sum(entry_count) AS BIGINT) AS entries FROM per_mode GROUP BY k),
w AS (SELECT k, string_agg(concat(user_name, '：', {HIT_TEXT}, '，中 ', {number_text('win_amount')}), chr(10) ORDER BY mode_ord, ord) AS won
  FROM settled JOIN modes USING (mode) WHERE win_units > 0 GROUP BY k)
SELECT k AS slip_id, {REPORT_HEAD} coalesce(won, '{dims.NO_WINNERS}')) AS report
FROM base LEFT JOIN draws USING (draw_date) JOIN t USING (k) LEFT JOIN w USING (k)""",
    "recognition_counts": f"""
WITH {BASE}, n AS (SELECT 'pingma' AS mode, 2 + {fx.SLASH_GROUPS} AS n FROM base UNION ALL SELECT 'lianma', 1 + {fx.LISTED_LINES} FROM base
  UNION ALL SELECT 'fushi', CASE WHEN k % 7 = 0 THEN 3 ELSE 4 END FROM base)
SELECT mode, CAST(sum(n) AS BIGINT) AS lines, count(*) AS texts, CAST(max(n) AS BIGINT) AS longest FROM n GROUP BY 1""",
}
