"""Checking SQL for the back-testing queries: cells are rows here, never masks, and come from the numbers."""

from __future__ import annotations

from slipspark.operators.backtest import STAKED
from slipspark.plans.bets_sql import DRAWS, GROUPS

_KINDS = ", ".join(f"('{kind}', '{play}')" for kind, play in STAKED)
_PAIRS = "unnest(s) AS a(x), unnest(s) AS b(y) WHERE x < y"
_TRIPLES = "unnest(s) AS a(x), unnest(s) AS b(y), unnest(s) AS c(z) WHERE x < y AND y < z"


def _subsets(source: str, keep: str, where_pick: str) -> str:
    return (
        f"SELECT {keep}, [x, y] AS cell FROM {source}, {_PAIRS} AND {where_pick.format(2)} "
        f"UNION ALL SELECT {keep}, [x, y, z] FROM {source}, {_TRIPLES} AND {where_pick.format(3)}"
    )


SQL = {
    "backtest_draws": f"""
WITH {GROUPS}, {DRAWS},
staked AS (SELECT kind, coalesce(play, '') AS play, amt, odds, pick, nums, combos, zods FROM groups),
lists AS (
  SELECT kind, play, amt, odds, pick, list_transform(nums, lambda x: CAST(x AS VARCHAR)) AS s FROM staked WHERE kind = 'pool'
  UNION ALL SELECT kind, play, amt, odds, pick, list_transform(cb, lambda x: CAST(x AS VARCHAR)) FROM (SELECT *, unnest(combos) AS cb FROM staked WHERE kind = 'listed')
  UNION ALL SELECT kind, play, amt, odds, 3, zods FROM staked WHERE kind = 'zodiac'),
cells AS (
  SELECT 'straight' AS kind, '' AS play, [CAST(n AS VARCHAR)] AS cell, amt, amt * odds AS prize FROM (SELECT *, unnest(nums) AS n FROM staked WHERE kind = 'straight')
  UNION ALL SELECT kind, play, cell, amt, amt * odds FROM ({_subsets('lists', 'kind, play, amt, odds', 'pick = {}')})),
cube AS (SELECT kind, play, cell, count(*) AS units, sum(prize) AS prize, sum(amt) AS stake FROM cells GROUP BY 1, 2, 3),
sides AS (
  SELECT draw_date, 'numbers' AS space, list_transform(list_distinct(drawn), lambda x: CAST(x AS VARCHAR)) AS s FROM draws
  UNION ALL SELECT draw_date, 'zodiacs', list_distinct(drawn_zodiacs) FROM draws),
hit AS (
  SELECT draw_date, 'special' AS space, [CAST(special AS VARCHAR)] AS cell FROM draws
  UNION ALL {_subsets('sides', 'draw_date, space', 'true')}),
won AS (
  SELECT draw_date, kind, play, sum(units) AS units, sum(prize) AS prize FROM hit JOIN cube USING (cell)
  WHERE space = CASE kind WHEN 'straight' THEN 'special' WHEN 'zodiac' THEN 'zodiacs' ELSE 'numbers' END GROUP BY 1, 2, 3),
kinds(kind, play) AS (VALUES {_KINDS}),
stakes AS (SELECT kind, play, sum(stake) AS stake FROM cube GROUP BY 1, 2)
SELECT CAST(draw_date AS VARCHAR) AS draw_date, kind, play, CAST(coalesce(stake, 0) AS DOUBLE) AS stake,
  CAST(coalesce(units, 0) AS BIGINT) AS win_units, CAST(coalesce(prize, 0) AS DOUBLE) AS win_amount
FROM draws CROSS JOIN kinds LEFT JOIN won USING (draw_date, kind, play) LEFT JOIN stakes USING (kind, play)""",
}
