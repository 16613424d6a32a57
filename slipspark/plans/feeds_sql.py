"""Checking SQL for the feed and request queries."""

from __future__ import annotations

from slipspark.plans.bets_sql import BASE, GROUPS, PER_MODE, SUMMED, settled_from, zodiac_of
from slipspark.plans.bets_sql import SQL as BETS
from slipspark.sources import fixtures as fx
from slipspark.sources.feeds import INCOMPLETE, NOT_JSON

T = fx.CheckText
ELEMENT = T.pick(["金", "木", "水", "火", "土"], f"{fx.feed_number('6')} % 5")
POLLS = f"""
polls AS (SELECT event_id, ts, event_type AS lottery_type, day(ts) AS d, length(event_type) AS t,
  CASE WHEN event_id % 103 = 0 THEN '{NOT_JSON}<html>' WHEN event_id % 101 = 0 THEN 'busy' ELSE '' END AS fetch_error FROM events),
feed AS (SELECT *, CASE WHEN fetch_error <> '' THEN fetch_error WHEN event_id % 97 = 0 THEN '{INCOMPLETE}' ELSE '' END AS error,
  CAST(2024000 + d AS VARCHAR) AS issue, {T.each('7', 'i', fx.feed_number('i'))} AS nums, {fx.feed_number('6')} AS special,
  event_id % 89 = 0 AS bare FROM polls),
good AS (SELECT * FROM feed WHERE error = '')"""
GOOD = "error = ''"
LATEST = f"""
WITH {POLLS}, r AS (SELECT *, row_number() OVER (PARTITION BY lottery_type ORDER BY ts DESC) AS rn FROM good)
SELECT lottery_type, issue, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, array_to_string(nums, '.') AS numbers,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS synced_at FROM r WHERE rn = 1"""
ASKED = f"asked AS (SELECT *, CASE WHEN {fx.NO_CLIENT} THEN NULL ELSE user_id END AS client FROM events)"
ADMISSION = f"""
WITH RECURSIVE {ASKED}, r AS (SELECT client, event_id, epoch_us(ts) AS t,
    row_number() OVER (PARTITION BY client ORDER BY ts, event_id) AS n FROM asked),
walk AS (
  SELECT client, event_id, n, true AS admitted, [t] AS recent FROM r WHERE n = 1
  UNION ALL
  SELECT client, event_id, n, len(kept) < 5, CASE WHEN len(kept) < 5 THEN list_append(kept, t) ELSE kept END
  FROM (SELECT r.client, r.event_id, r.n, r.t, list_filter(w.recent, lambda x: r.t - x < 259200000000) AS kept
    FROM walk w JOIN r ON r.client IS NOT DISTINCT FROM w.client AND r.n = w.n + 1))
SELECT client, event_id AS request_id, admitted FROM walk"""

FEED_BASE = f"""base AS (SELECT o_orderkey AS k, o_custkey AS c, {T.pick(fx.LOTTERIES, 'o_orderkey % 5')} || '|' ||
  CAST(CAST(DATE '{fx.FEED_START}' + CAST(o_orderkey % {fx.FEED_DAYS} AS INTEGER) AS DATE) AS VARCHAR) AS draw_date FROM orders)"""
FEED_SETTLED = f"""{POLLS}, {GROUPS.replace(BASE, FEED_BASE)},
last AS (SELECT *, row_number() OVER (PARTITION BY lottery_type, CAST(ts AS DATE) ORDER BY ts DESC) AS rn FROM good),
draws AS (SELECT lottery_type || '|' || CAST(CAST(ts AS DATE) AS VARCHAR) AS draw_date, special, nums AS drawn, {zodiac_of('special')} AS draw_zodiac,
  list_transform(nums, lambda n: {zodiac_of('n')}) AS drawn_zodiacs FROM last WHERE rn = 1), {settled_from('groups')}"""

SQL = {
    "feed_settle": f"""
WITH {FEED_SETTLED}, {PER_MODE} SELECT k AS slip_id, split_part(draw_date, '|', 1) AS lottery_type, split_part(draw_date, '|', 2) AS date, {SUMMED},
  CAST(sum(winner_count) AS BIGINT) AS winner_count FROM per_mode GROUP BY 1, 2, 3""",
    "draw_feed_parse": f"""
WITH {POLLS} SELECT lottery_type, fetch_error AS error, CASE WHEN fetch_error = '' THEN issue END AS issue, count(*) AS polls
FROM feed GROUP BY 1, 2, 3""",
    "draw_normalize": f"""
WITH {POLLS} SELECT event_id, lottery_type, error, CASE WHEN {GOOD} THEN array_to_string(nums[1:6], '.') END AS normal_numbers,
  CASE WHEN {GOOD} THEN CAST(special AS BIGINT) END AS special, CASE WHEN {GOOD} THEN CASE WHEN bare THEN '' ELSE {zodiac_of('special')} END END AS special_zodiac,
  CASE WHEN {GOOD} THEN {ELEMENT} END AS special_element, CASE WHEN {GOOD} THEN CAST(2024001 + d AS VARCHAR) END AS next_issue FROM feed""",
    "draw_latest": LATEST,
    "draw_sync_stream": LATEST,
    "draw_store": LATEST,
    "draw_new_issue": f"""
WITH {POLLS}, p AS (SELECT *, lag(issue) OVER (PARTITION BY lottery_type ORDER BY ts, event_id) AS before FROM good)
SELECT event_id, lottery_type, issue FROM p WHERE before IS DISTINCT FROM issue""",
    "draw_changed": f"""
WITH {POLLS}, p AS (SELECT *, lag(nums) OVER (PARTITION BY lottery_type ORDER BY ts, event_id) AS before FROM good)
SELECT lottery_type, issue, count(*) FILTER (before IS DISTINCT FROM nums) AS changes, CAST(0 AS BIGINT) AS mismatches, count(*) AS polls
FROM p GROUP BY 1, 2""",
    "draw_events_stream": f"""
WITH {POLLS}, p AS (SELECT *, lag(nums) OVER w AS before, lag(issue) OVER w AS issue_before FROM good WINDOW w AS (PARTITION BY lottery_type ORDER BY ts, event_id))
SELECT lottery_type, issue, count(*) FILTER (issue_before IS DISTINCT FROM issue) AS new_issues, count(*) FILTER (before IS DISTINCT FROM nums) AS changes,
  count(*) AS polls FROM p GROUP BY 1, 2""",
    "draw_sync_status": f"""
WITH {POLLS} SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_attempt_at, strftime(max(ts) FILTER ({GOOD}), '%Y-%m-%d %H:%M:%S.%f') AS last_success_at,
  count(*) AS attempts, count(*) FILTER ({GOOD}) AS successes, arg_max(error, ts) AS last_error FROM feed""",
    "resettle_stream": BETS["summary_all"].replace("FROM per_mode", "FROM per_mode JOIN draws USING (draw_date)"),
    "trailing_requests": f"""
WITH {ASKED} SELECT client, event_id AS request_id, count(*) OVER (PARTITION BY client ORDER BY epoch_us(ts)
  RANGE BETWEEN 259199999999 PRECEDING AND CURRENT ROW) AS trailing FROM asked""",
    "admission": ADMISSION,
    "admission_stream": ADMISSION,
    "resettle_join_stream": BETS["summary_all"],
    "admission_late_stream": ADMISSION,
}
SQL["sync_progress"] = SQL["draw_sync_status"]
