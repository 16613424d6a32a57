"""Checking SQL for recognition batches."""

from __future__ import annotations

from slipspark.plans.bets_sql import DRAWS, MIXED_SETTLED
from slipspark.plans.images_sql import ALL_CELLS
from slipspark.plans.lines_sql import BASE
from slipspark.sources import fixtures as fx

_DAY = "CAST(DATE '1995-01-01' + CAST(o_custkey % 700 AS INTEGER) AS DATE) AS draw_date"
_ALL = f"base AS (SELECT o_orderkey AS k, o_custkey AS c, {_DAY} FROM orders)"
_SPEAKING = f"base AS (SELECT * FROM (SELECT o_orderkey AS k, o_custkey AS c, {_DAY} FROM orders) WHERE NOT ({fx.SILENT}))"
_SUM = "CAST(coalesce(sum({}), 0) AS {})"


def _sum(x: str, kind: str, name: str) -> str:
    return f"{_SUM.format(x, kind)} AS {name}"


_PART = lambda label, n: f"CASE WHEN {n} > 0 THEN concat('{label}', {n}, '行') END"
_SAID = (
    f"concat('OCR 已分类 ', images, ' 张图片：', coalesce(nullif(concat_ws('，', {_PART('平码', 'lines_pingma')}, "
    f"{_PART('连码', 'lines_lianma')}, {_PART('复式', 'lines_fushi')}), ''), '未分类到有效内容'))"
)

SQL = {
    "recognition_batches": f"""
WITH chat AS (
  WITH {MIXED_SETTLED.replace(BASE, _SPEAKING)},
  won AS (SELECT k, sum(units * amt) AS bet, sum(win_amount) AS win, sum(len(nums)) AS entries, count(*) AS groups, count(*) FILTER (win_units > 0) AS winners
    FROM settled GROUP BY k),
  texts AS (SELECT k, c, 2 + {fx.SLASH_GROUPS} AS p, 1 + {fx.LISTED_LINES} AS l, CASE WHEN k % 7 = 0 THEN 3 ELSE 4 END AS f FROM base)
  SELECT o_custkey AS batch_id, count(*) AS images, count(texts.k) AS images_with_text, 0 AS numbers_found, {_sum('p', 'BIGINT', 'lines_pingma')},
    {_sum('l', 'BIGINT', 'lines_lianma')}, {_sum('f', 'BIGINT', 'lines_fushi')}, {_sum('bet', 'DOUBLE', 'total_bet_amount')},
    {_sum('win', 'DOUBLE', 'total_win_amount')}, {_sum('entries', 'BIGINT', 'entry_count')}, {_sum('groups', 'BIGINT', 'group_count')},
    {_sum('winners', 'BIGINT', 'winner_count')}
  FROM orders LEFT JOIN texts ON texts.k = o_orderkey LEFT JOIN won ON won.k = o_orderkey GROUP BY 1),
tables AS (
  WITH {ALL_CELLS.replace(BASE, _ALL)}, {DRAWS},
  won AS (SELECT m.k, sum(v) AS bet, coalesce(sum(47 * v) FILTER (number = special), 0) AS win, count(*) AS entries, count(DISTINCT v) AS groups,
    count(*) FILTER (number = special) AS winners FROM merged m JOIN base ON base.k = m.k LEFT JOIN draws USING (draw_date) GROUP BY m.k)
  SELECT o_custkey AS batch_id, count(*) AS images, count(won.k) AS images_with_text, {_sum('entries', 'BIGINT', 'numbers_found')}, count(won.k) AS lines_pingma,
    0 AS lines_lianma, 0 AS lines_fushi, {_sum('bet', 'DOUBLE', 'total_bet_amount')}, {_sum('win', 'DOUBLE', 'total_win_amount')},
    {_sum('entries', 'BIGINT', 'entry_count')}, {_sum('groups', 'BIGINT', 'group_count')}, {_sum('winners', 'BIGINT', 'winner_count')}
  FROM orders LEFT JOIN won ON won.k = o_orderkey GROUP BY 1)
SELECT 'chat' AS kind, *, {_SAID} AS said FROM chat
UNION ALL SELECT 'table', *, concat('OCR 已识别 ', images, ' 张图片、', numbers_found, ' 个号码金额，已追加到输入区') FROM tables""",
}
