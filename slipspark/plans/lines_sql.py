"""Checking SQL for the line queries; answers come from the numbers a line was made of."""

from __future__ import annotations

from slipspark.plans.lines import PLAYS_SEEN
from slipspark.sources import fixtures as fx

T = fx.CheckText
BASE = "base AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS draw_date FROM orders)"
LINES = (
    "lines AS (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS ln, "
    "CAST(l_quantity AS INTEGER) AS q FROM lineitem)"
)
PLAY = f"(CASE WHEN p % 6 = 4 THEN '复四三' ELSE {T.pick(PLAYS_SEEN, 'p % 6')} END)"
VALID = "BETWEEN 1 AND 49"
STAKE = "(q + CASE WHEN o % 2 = 0 THEN 0.5 ELSE 0 END)"


def zodiac(number: str) -> str:
    return T.pick(fx.ZODIACS, f"({number} - 1) % 12")


def _texts(mode: str, text: str) -> str:
    return f"SELECT k, '{mode}' AS mode, {fx.present(mode, text)} AS raw_text FROM base"


TEXTS = f"{_texts('pingma', fx.pingma_text(T))} UNION ALL {_texts('lianma', fx.listed_text(T))} UNION ALL {_texts('fushi', fx.fushi_text(T))}"


def _clean(read: str) -> str:
    """Amounts a cell text stands for; ``read`` gives the value of full-width digits."""
    return f"""
WITH {LINES}, read AS (
  SELECT CASE ln % 4 WHEN 0 THEN p WHEN 1 THEN {read.split(';')[0]} WHEN 2 THEN p * 100 + 1 ELSE {read.split(';')[1]} END AS v
  FROM lines)
SELECT CASE WHEN v BETWEEN 1 AND 9999 THEN CAST(v AS VARCHAR) ELSE '' END AS amount, count(*) AS readings
FROM read GROUP BY 1"""


SQL = {
    "slip_source": f"""
WITH {BASE}, t AS ({TEXTS})
SELECT mode, count(*) AS slips, CAST(sum(length(raw_text)) AS BIGINT) AS chars,
  CAST(sum(length(raw_text) - length(replace(raw_text, chr(10), '')) + 1) AS BIGINT) AS lines
FROM t GROUP BY 1""",
    "slip_lines": f"""
WITH {BASE}, texts AS ({TEXTS}), t AS (SELECT k, mode, string_split(raw_text, chr(10)) AS ls FROM texts),
r AS (SELECT k, mode, unnest(ls) AS line, unnest(range(0, len(ls))) AS raw_idx FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY k, mode ORDER BY raw_idx) - 1 AS nb_idx FROM r WHERE line <> '')
SELECT mode, CAST(raw_idx AS BIGINT) AS raw_idx, CAST(nb_idx AS BIGINT) AS nb_idx, count(*) AS lines,
  CAST(sum(length(line)) AS BIGINT) AS chars FROM n GROUP BY 1, 2, 3""",
    "normalize_number": f"""
WITH {LINES}, r AS (SELECT CASE ln % 4 WHEN 0 THEN p % 60 WHEN 1 THEN s % 60 WHEN 2 THEN q ELSE NULL END AS v FROM lines)
SELECT CASE WHEN v {VALID} THEN CAST(v AS BIGINT) END AS number, count(*) AS tokens FROM r GROUP BY 1""",
    "extract_numbers": f"""
WITH {LINES}, r AS (SELECT unnest([p % 60, s % 60, ln, q]) AS n FROM lines)
SELECT CAST(n AS BIGINT) AS number, count(*) AS entries FROM r WHERE n {VALID} GROUP BY 1""",
    "number_zodiac": f"""
WITH {LINES}, r AS (SELECT p % 60 AS n FROM lines)
SELECT CASE WHEN n {VALID} THEN {zodiac('n')} ELSE '' END AS zodiac, count(*) AS entries FROM r GROUP BY 1""",
    "zodiac_numbers": f"""
WITH {LINES}, n AS (SELECT unnest(range(1, 50)) AS number), r AS (SELECT p % 12 AS z, count(*) AS c FROM lines GROUP BY 1)
SELECT {zodiac('n.number')} AS zodiac, CAST(n.number AS BIGINT) AS number, CAST(r.c AS BIGINT) AS entries
FROM n JOIN r ON (n.number - 1) % 12 = r.z""",
    "bettor_name": f"""
WITH {LINES}, r AS (SELECT CASE ln % 5 WHEN 0 THEN translate(CAST(s AS VARCHAR), '0123456789', 'abcdefghij')
  WHEN 1 THEN '张三' WHEN 4 THEN '狗' ELSE concat('第', ln + 1, '行') END AS user_name FROM lines)
SELECT user_name, count(*) AS lines FROM r GROUP BY 1""",
    "play_detect": f"WITH {LINES} SELECT {PLAY} AS play, count(*) AS lines FROM lines GROUP BY 1",
    # A bare line without play and word runs its last number into the amount: the longest decimal that ends it wins.
    "trailing_amount": f"""
WITH {LINES}, r AS (SELECT {PLAY} AS play, CASE WHEN p % 6 = 5 AND s % 5 = 3
    THEN CAST(concat(p % 60, CASE WHEN o % 2 = 0 THEN concat(q, '.5') ELSE CAST(q AS VARCHAR) END) AS DECIMAL(18, 4))
    ELSE {STAKE} END AS v, p % 6 = 5 AND s % 5 = 3 AND o % 2 = 1 AS glued, s % 60 AS b, p % 60 AS a, q FROM lines),
m AS (SELECT play, CASE WHEN glued THEN CAST(concat(b, '.', a, q) AS DECIMAL(18, 4)) ELSE v END AS v FROM r)
SELECT play, count(*) AS lines, CAST(sum(v) AS DOUBLE) AS stake, CAST(max(v) AS DOUBLE) AS highest FROM m GROUP BY 1""",
    "numbers_before_play": f"""
WITH {LINES}, r AS (SELECT {PLAY} AS play, p % 60 AS a, s % 60 AS b FROM lines WHERE p % 6 <> 5),
n AS (SELECT play, a AS n FROM r WHERE a {VALID} UNION ALL SELECT play, b FROM r WHERE b {VALID} AND b <> a)
SELECT play, count(*) AS numbers, CAST(sum(n) AS BIGINT) AS number_sum FROM n GROUP BY 1""",
    "cn_integer": f"""
WITH {LINES}, r AS (SELECT CASE ln % 5 WHEN 0 THEN q WHEN 1 THEN q WHEN 2 THEN 20 + q % 10 ELSE 0 END AS v FROM lines)
SELECT CAST(v AS BIGINT) AS value, count(*) AS lines FROM r GROUP BY 1""",
    "amount_clean_web": _clean("q;0"),
    "amount_clean_svc": _clean("q * 10 + 5;q"),
    "combination_count": f"""
WITH {LINES}, r AS (SELECT CAST(q % 20 AS BIGINT) AS n, CAST(ln % 6 AS BIGINT) AS pick FROM lines)
SELECT n, pick, CAST(CASE WHEN pick <= 0 OR n < pick THEN 0
  ELSE factorial(CAST(n AS INTEGER)) / factorial(CAST(pick AS INTEGER)) / factorial(CAST(n - pick AS INTEGER)) END AS BIGINT) AS combos,
  count(*) AS lines FROM r GROUP BY 1, 2, 3""",
}
