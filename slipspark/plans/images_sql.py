"""Checking SQL for the recognition queries."""

from __future__ import annotations

from slipspark import dims
from slipspark.functions.text import PY_LINE_BREAK, PY_WS
from slipspark.operators.ocr_text import BARE_AMOUNT, CONTENT, CUT_AMOUNT, CUT_NUMBER, TWO_DIGITS, WAITS_AMOUNT
from slipspark.plans.bets_sql import DRAWS
from slipspark.plans.lines_sql import BASE
from slipspark.sources import fixtures as fx

T = fx.CheckText
L = dims.LAYOUT


def _items(count: str) -> str:
    return f"(SELECT *, CAST(unnest(range(0, CAST({count} AS INTEGER))) AS BIGINT) AS i FROM base)"


SCORE = f"CASE WHEN {fx.NO_SCORES} THEN 0.0 WHEN i < {fx.IMAGE_BOXES} - k % 2 THEN {fx.box_score('i')} ELSE 0.0 END"
ITEMS = (
    f"items AS (SELECT k, c, i, {fx.IMAGE_WIDTH} AS width, {fx.IMAGE_HEIGHT} AS height, CAST({fx.box_x('i')} AS DOUBLE) AS x, "
    f"CAST({fx.box_y('i')} AS DOUBLE) AS y, {fx.box_text('i')} AS text, CAST({SCORE} AS DOUBLE) AS score FROM {_items(fx.IMAGE_BOXES)})"
)


def amount(box: str) -> str:
    """Amount of a box; a minus sign is dropped with the other characters."""
    return f"abs({fx.box_amount(box)})"


def rounded(x: str) -> str:
    return f"round_even({x}, 0)"


CELLS = f"""
sizes AS (SELECT DISTINCT {fx.IMAGE_WIDTH} AS width, {fx.IMAGE_HEIGHT} AS height FROM base),
cells AS (SELECT *, least(3, (number - 1) // 12) AS g FROM sizes, (SELECT unnest(range(1, 50)) AS number)),
placed_cells AS (SELECT *, CASE WHEN g = 3 THEN number - 37 ELSE (number - 1) % 12 END AS r FROM cells),
rects AS (SELECT *, width * {L['tableX']}::DOUBLE + g * (width * {L['groupWidth']}::DOUBLE) + width * {L['numberColumnWidth']}::DOUBLE + width * {L['paddingX']}::DOUBLE AS x,
  height * {L['tableY']}::DOUBLE + r * (height * {L['rowHeight']}::DOUBLE) + height * {L['paddingY']}::DOUBLE AS y,
  width * {L['groupWidth']}::DOUBLE - width * {L['numberColumnWidth']}::DOUBLE - width * {L['paddingX']}::DOUBLE * {L['sourceWidthPaddingMultiplier']}::DOUBLE AS w,
  height * {L['rowHeight']}::DOUBLE - height * {L['paddingY']}::DOUBLE * {L['sourceHeightPaddingMultiplier']}::DOUBLE AS h FROM placed_cells),
px AS (SELECT *, greatest(0, {rounded('x')}) AS x1, greatest(0, {rounded('y')}) AS y1, least(width, {rounded('x + w')}) AS x2,
  least(height, {rounded('y + h')}) AS y2 FROM rects)"""
INSIDE = f"""
inside AS (SELECT k, i, min(number) AS number, any_value(v) AS v, any_value(score) AS score FROM (
  SELECT it.k, it.i, px.number, {amount('it.i').replace('(k ', '(it.k ').replace(' c * 7', ' it.c * 7')} AS v, it.score FROM items it JOIN px
    ON it.width = px.width AND it.height = px.height AND it.x BETWEEN px.x1 - 6 AND px.x2 + 6 AND it.y BETWEEN px.y1 - 6 AND px.y2 + 6)
  WHERE v BETWEEN 1 AND 9999 GROUP BY k, i)"""


def best(source: str, keys: str, conf: str) -> str:
    """Fold of readings in order; ``conf`` is what is stored of a score."""
    state = lambda s: f"{{'v': {s}.v, 'conf': {conf.format(s + '.score')}, 'score': 0.0::DOUBLE}}"
    kept = "{'v': a.v, 'conf': a.conf, 'score': 0.0::DOUBLE}"
    rule = "b.score >= a.conf OR len(CAST(b.v AS VARCHAR)) > len(CAST(a.v AS VARCHAR))"
    return (
        f"SELECT {keys}, list_reduce(list({{'v': v, 'conf': -1.0::DOUBLE, 'score': score}} ORDER BY i), "
        f"lambda a, b: CASE WHEN {rule} THEN {state('b')} ELSE {kept} END, {{'v': 0::BIGINT, 'conf': -1.0::DOUBLE, 'score': 0.0::DOUBLE}}) AS s "
        f"FROM {source} GROUP BY {keys}"
    )


FAST = f"fast AS ({best('inside', 'k, number', 'round_even({}, 4)')})"
READS = f"""
reads AS (SELECT k, {fx.reading_number('i')} AS number, i, {amount('(i + 1)')} AS v, CAST({fx.box_score('(i + 5)')} AS DOUBLE) AS score
  FROM {_items(fx.READINGS)}),
usable AS (SELECT * FROM reads WHERE (number % 11 <> 0 OR {fx.NO_BLANKS}) AND v BETWEEN 1 AND 9999)"""
VERIFY = f"verify AS ({best('usable', 'k, number', '{}')})"
MERGE = f"""
passes AS (SELECT coalesce(f.k, v.k) AS k, coalesce(f.number, v.number) AS number, f.s.v AS fv, f.s.conf AS fc,
    CASE WHEN v.s.conf >= {dims.VERIFY_CONFIDENCE} THEN v.s.v END AS vv, v.s.conf AS vc
  FROM fast f FULL JOIN verify v ON f.k = v.k AND f.number = v.number),
chosen AS (SELECT *, vv IS NOT NULL AND (fv IS NULL OR fc < {dims.FAST_CONFIDENCE})
  AND (vc >= coalesce(fc, 0) OR len(CAST(vv AS VARCHAR)) > len(coalesce(CAST(fv AS VARCHAR), ''))) AS taken FROM passes),
merged AS (SELECT k, number, CASE WHEN taken THEN vv ELSE fv END AS v, CASE WHEN taken THEN round_even(vc, 4) ELSE fc END AS conf
  FROM chosen WHERE taken OR fv IS NOT NULL)"""
ALL_CELLS = f"{BASE}, {ITEMS}, {CELLS}, {INSIDE}, {FAST}, {READS}, {VERIFY}, {MERGE}"
SHOWN = "k AS image_id, CAST(number AS BIGINT) AS number, CAST(v AS VARCHAR) AS amount, CAST(conf AS DOUBLE) AS confidence"


def bet_texts(source: str, form: str) -> str:
    return (
        f"SELECT '{form}' AS form, k AS image_id, string_agg(bet, '，' ORDER BY lowest) AS text FROM (SELECT k, min(number) AS lowest, "
        f"concat(string_agg(concat(number, '号'), '' ORDER BY number), '一个号各下', v, '元') AS bet FROM {source} GROUP BY k, v) GROUP BY k"
    )


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


CHAT = f"""
docs AS (SELECT 'turn' AS source, conv_id * 1000 + turn AS chat_id, text, turn + conv_id AS n FROM conversations
  UNION ALL SELECT 'document', doc_id, text, doc_id FROM documents),
chat AS (SELECT source, chat_id, {fx.chat_text()} AS text FROM docs),
split AS (SELECT source, chat_id, list_filter(list_transform(regexp_split_to_array(text, {_re(PY_LINE_BREAK)}),
    lambda l: regexp_replace(translate(l, '|：。，', '/:.,'), {_re(f'[{PY_WS}]+')}, '', 'g')), lambda l: l <> '') AS ls FROM chat)"""
# The rule in one pattern; the checking engine's matcher is linear whatever the pattern.
CHUNKS = r"^(?:[./]?\p{Nd}{1,2}){2,}\z"
CONTINUES = (
    f"(regexp_matches(l, {_re(BARE_AMOUNT)}) AND regexp_matches(a[-1], {_re(WAITS_AMOUNT)})) "
    f"OR (regexp_matches(l, {_re(TWO_DIGITS)}) AND regexp_matches(a[-1], {_re(CUT_AMOUNT)})) "
    f"OR (regexp_matches(l, {_re(CHUNKS)}) AND regexp_matches(a[-1], {_re(CUT_NUMBER)}))"
)
LINE_STATE = "{'h': %s, 'line': %s, 'out': %s}"

def _layout(source: str) -> str:
    own = {**L, **{key: value for of, key, value in fx.LAYOUT_OVERRIDES if of == source and key in L}}
    return f"('{source}', " + ", ".join(f"{v}::DOUBLE" for v in own.values()) + ")"


LAYOUT_CELLS = f"""
layout(source, {', '.join(L)}) AS (VALUES {', '.join(_layout(s) for s in fx.IMAGE_SOURCES)}),
frames AS (SELECT DISTINCT {fx.image_source('k')} AS source, {fx.IMAGE_WIDTH} AS width, {fx.IMAGE_HEIGHT} AS height FROM base),
placed_cells AS (SELECT *, CASE WHEN g = 3 THEN number - 37 ELSE (number - 1) % 12 END AS r
  FROM (SELECT *, least(3, (number - 1) // 12) AS g FROM frames, (SELECT unnest(range(1, 50)) AS number))),
rects AS (SELECT source, width, height, number, width * tableX + g * (width * groupWidth) + width * numberColumnWidth + width * paddingX AS rx,
  height * tableY + r * (height * rowHeight) + height * paddingY AS ry, width * groupWidth - width * numberColumnWidth - width * paddingX * sourceWidthPaddingMultiplier AS w,
  height * rowHeight - height * paddingY * sourceHeightPaddingMultiplier AS h FROM placed_cells JOIN layout USING (source)),
px AS (SELECT source, width, height, number, greatest(0, {rounded('rx')}) AS x1, greatest(0, {rounded('ry')}) AS y1, least(width, {rounded('rx + w')}) AS x2,
  least(height, {rounded('ry + h')}) AS y2 FROM rects)"""

SQL = {
    "table_settle": f"""
WITH {ALL_CELLS}, {DRAWS}
SELECT m.k AS slip_id, CAST(sum(v) AS DOUBLE) AS total_bet_amount, CAST(coalesce(sum(47 * v) FILTER (number = special), 0) AS DOUBLE) AS total_win_amount,
  count(*) AS entry_count, count(DISTINCT v) AS group_count, count(*) FILTER (number = special) AS winner_count
FROM merged m JOIN base ON base.k = m.k LEFT JOIN draws USING (draw_date) GROUP BY m.k""",
    "ocr_box_source": f"""
WITH {BASE}, {ITEMS} SELECT score, count(*) AS readings, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(i) AS BIGINT) AS seq_sum
FROM items GROUP BY 1""",
    "box_center": f"WITH {BASE}, {ITEMS} SELECT k AS image_id, i AS seq, x, y FROM items",
    "ocr_lines": f"""
WITH {BASE}, {ITEMS}, ordered AS (SELECT k, list({{'h': y, 'line': text, 'out': []::VARCHAR[]}} ORDER BY round_even(y / {dims.LINE_BAND}, 0), x, i) AS l FROM items GROUP BY k),
folded AS (SELECT k, list_reduce(l, lambda a, b: CASE WHEN abs(b.h - a.h) <= {dims.LINE_GAP}
  THEN {LINE_STATE % ('(a.h + b.h) / 2', 'concat(a.line, b.line)', 'a.out')}
  ELSE {LINE_STATE % ('b.h', 'b.line', 'list_append(a.out, a.line)')} END) AS s FROM ordered),
lines AS (SELECT k, list_append(s.out, s.line) AS ls FROM folded)
SELECT k AS image_id, CAST(unnest(range(0, len(ls))) AS BIGINT) AS line_no, unnest(ls) AS line FROM lines""",
    "chat_clean": f"""
WITH {CHAT} SELECT source, chat_id, array_to_string(list_filter(ls, lambda l: regexp_matches(l, {_re(CONTENT)})), chr(10)) AS cleaned FROM split""",
    "chat_clean_full": f"""
WITH {CHAT}, folded AS (SELECT source, chat_id, list_reduce(list_transform(ls, lambda l: [l]), lambda a, b: CASE
  WHEN regexp_matches(b[1], {_re(CONTENT)}) OR (len(a) > 0 AND ({CONTINUES.replace('(l,', '(b[1],')})) THEN list_concat(a, b) ELSE a END, []::VARCHAR[]) AS kept FROM split)
SELECT source, chat_id, array_to_string(kept, chr(10)) AS cleaned FROM folded""",
    "cell_rects": f"""
WITH {BASE}, {CELLS} SELECT CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, CAST(number AS BIGINT) AS number,
  CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2,
  round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM px""",
    "box_in_cell": f"""
WITH {BASE}, {ITEMS}, {CELLS}, {INSIDE} SELECT k AS image_id, i AS seq, CAST(number AS BIGINT) AS number, CAST(v AS VARCHAR) AS amount FROM inside""",
    "box_in_layout": f"""
WITH {BASE}, {ITEMS}, {LAYOUT_CELLS},
tagged AS (SELECT *, {fx.image_source('k')} AS source FROM items),
held AS (SELECT t.k, t.i, t.source, min(number) AS number, any_value({amount('i')}) AS v FROM tagged t JOIN px USING (source, width, height)
  WHERE x BETWEEN x1 - 6 AND x2 + 6 AND y BETWEEN y1 - 6 AND y2 + 6 GROUP BY ALL)
SELECT k AS image_id, i AS seq, source, CAST(number AS BIGINT) AS number, CAST(v AS VARCHAR) AS amount FROM held WHERE v BETWEEN 1 AND 9999""",
    "cell_best_fast": f"WITH {BASE}, {ITEMS}, {CELLS}, {INSIDE}, {FAST} SELECT {SHOWN.replace('v AS V', 's.v AS V').replace('(conf ', '(s.conf ')} FROM fast",
    "cell_best_verify": f"WITH {BASE}, {READS}, {VERIFY} SELECT {SHOWN.replace('v AS V', 's.v AS V').replace('(conf ', '(s.conf ')} FROM verify",
    "ocr_verify_merge": f"WITH {ALL_CELLS} SELECT {SHOWN} FROM merged",
    "low_confidence": f"WITH {ALL_CELLS} SELECT {SHOWN} FROM merged WHERE conf < {dims.REPORT_CONFIDENCE}",
    "bets_by_amount": f"""
WITH {ALL_CELLS}, web AS (SELECT k, n * 5 AS number, (k + n) % 4 * 50 + 1 AS v FROM (SELECT k, unnest(range(1, CAST(k % 9 + 2 AS INTEGER))) AS n FROM base))
{bet_texts('merged', 'service')} UNION ALL {bet_texts('web', 'web')}""",
}
