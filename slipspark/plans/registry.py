"""All named queries and their checking SQL."""

from __future__ import annotations

from slipspark.plans import backtest, backtest_sql, batches, batches_sql, bets, bets_sql, feeds, feeds_sql, images, images_sql, lines, lines_sql

QUERIES = {**lines.QUERIES, **bets.QUERIES, **backtest.QUERIES, **batches.QUERIES, **images.QUERIES, **feeds.QUERIES}
SQL = {**lines_sql.SQL, **bets_sql.SQL, **backtest_sql.SQL, **batches_sql.SQL, **images_sql.SQL, **feeds_sql.SQL}
