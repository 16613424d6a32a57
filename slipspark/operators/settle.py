"""Bet groups against draws: drawn sets, hits, payouts, winner texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipspark import dims
from slipspark.functions.combos import combination_count
from slipspark.functions.lets import let
from slipspark.functions.text import MONEY, nullif_blank, plain_number
from slipspark.functions.tokens import number_zodiac, numbers_in, two_digits

# A draw row is a few hundred bytes: this bound keeps a broadcast below about 100 MB.
MAX_BROADCAST_DRAWS = 200_000
SALTS = 64


def drawn_set(special: Column, extras: Column) -> Column:
    """Distinct drawn numbers, the special one first."""
    return F.array_compact(F.array_distinct(F.concat(F.array(special), extras)))


def with_extras(draws: DataFrame) -> DataFrame:
    """Draws whose other numbers come as text get ``numbers``: all numbers 1 to 49 that the text holds, in its order."""
    if "numbers" in draws.columns or "extras" not in draws.columns:
        return draws
    return draws.withColumn("numbers", numbers_in(F.coalesce("extras", F.lit(""))))


def drawn_zodiacs(given: Column, drawn: Column, order: str = dims.ZODIAC_ORDER) -> Column:
    """Distinct zodiacs of the given one and of every drawn number."""
    derived = F.transform(drawn, lambda n: number_zodiac(n, order))
    return F.array_compact(F.array_distinct(F.concat(F.array(nullif_blank(given)), derived)))


def keys_of(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def one_per_key(draws: DataFrame, key: str | Sequence[str] = "draw_date") -> DataFrame:
    """The last synced draw of each key, ties by issue, then by what was drawn."""
    keys = keys_of(key)
    rest = [c for c in draws.columns if c not in keys]
    rank = [c for c in ("synced_at", "issue") if c in rest]
    return draws.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*rank, *(c for c in rest if c not in rank))).alias("d")).select(*keys, "d.*")


def draw_inputs(draws: DataFrame, key: str | Sequence[str] = "draw_date", order: str = dims.ZODIAC_ORDER) -> DataFrame:
    """Draws reduced to what settlement reads, one per key (a date, or a lottery and a date).

    A zodiac missing from the feed comes from the number. Of several draws of a key the last synced one counts.
    """
    return draw_values(one_per_key(with_extras(draws), key), keys_of(key), order)


def draw_values(draws: DataFrame, keep: Sequence[str], order: str = dims.ZODIAC_ORDER) -> DataFrame:
    """What settlement reads of each draw row, beside the columns ``keep``; row by row, so streams have it too."""
    draws = with_extras(draws)
    special_zodiac = F.coalesce(nullif_blank(F.get("zodiacs", F.lit(6))), number_zodiac(F.col("special"), order))
    return (
        draws.withColumn("draw_zodiac", special_zodiac)
        .withColumn("drawn", drawn_set(F.col("special"), F.col("numbers")))
        .withColumn("drawn_zodiacs", drawn_zodiacs(F.col("draw_zodiac"), F.col("drawn"), order))
        .select(*keep, "special", "draw_zodiac", "drawn", "drawn_zodiacs")
    )


def with_draw(slips: DataFrame, draws: DataFrame, key: str | Sequence[str] = "draw_date", max_rows: int = MAX_BROADCAST_DRAWS) -> DataFrame:
    """Equi-join slips to the inputs of ``draw_inputs``; a slip whose draw isn't there yet stays, with nothing drawn.

    Draws within ``max_rows`` are broadcast and the slips never move. A longer draw table is joined by shuffle, each
    draw copied to every salt so that a date holding a large share of the slips is spread over ``SALTS`` tasks.
    """
    keys = keys_of(key)
    if draws.limit(max_rows + 1).count() <= max_rows:
        return filled(slips.join(F.broadcast(draws), keys, "left"))
    salted = draws.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = slips.withColumn("salt", F.pmod(F.xxhash64("slip_id"), F.lit(SALTS)).cast("int"))
    return filled(spread.join(salted, [*keys, "salt"], "left").drop("salt"))


def filled(slips: DataFrame) -> DataFrame:
    """Nothing drawn where no draw was joined."""
    none = {"draw_zodiac": F.lit(""), "drawn": F.array().cast("array<int>"), "drawn_zodiacs": F.array().cast("array<string>")}
    return slips.withColumns({name: F.coalesce(name, value) for name, value in none.items() if name in slips.columns})


def straight_hits(numbers: Column, special: Column) -> Column:
    """Entries equal to the special number; a repeated entry counts each time."""
    return F.size(F.filter(numbers, lambda n: n == special))


def pool_hits(pool: Column, drawn: Column) -> Column:
    """Pool members drawn; a pool holds no number twice."""
    return F.size(F.array_intersect(pool, drawn))


def combo_hits(combos: Column, drawn: Column, pick: Column) -> Column:
    """Combinations with at least ``pick`` members drawn; of numbers or of zodiacs."""
    return F.size(F.filter(combos, lambda combo: F.size(F.array_intersect(combo, drawn)) >= pick))


def _by_kind(g: Column, special: Column, drawn: Column, zodiacs: Column, same: Callable[[Column], Column], pool: Callable[[Column], Column]) -> Column:
    return (
        F.when(g["kind"] == "straight", same(straight_hits(g["numbers"], special)))
        .when(g["kind"] == "pool", let(pool_hits(g["numbers"], drawn), pool))
        .when(g["kind"] == "listed", same(combo_hits(g["combos"], drawn, g["pick"])))
        .otherwise(same(combo_hits(g["zodiac_combos"], zodiacs, g["pick"])))
    )


def hits(g: Column, special: Column, drawn: Column, zodiacs: Column) -> Column:
    """(hit_count, win_units) of a group; win_units are what the payout multiplies."""
    pair = lambda hit, units: F.struct(hit.cast("bigint").alias("hit_count"), units.cast("bigint").alias("win_units"))
    same = lambda value: let(value, lambda v: pair(v, v))
    return _by_kind(g, special, drawn, zodiacs, same, lambda hit: pair(hit, combination_count(hit, g["pick"])))


def win_units(g: Column, special: Column, drawn: Column, zodiacs: Column) -> Column:
    """``hits(...).win_units`` alone."""
    units = lambda value: value.cast("bigint")
    return _by_kind(g, special, drawn, zodiacs, units, lambda hit: combination_count(hit, g["pick"]))


def payout(win_units: Column, amount: Column, odds: Column) -> Column:
    return (win_units * odds.cast("bigint") * amount).cast(MONEY)


def hit_text(g: Column, hit_count: Column, win_units: Column, special: Column, draw_zodiac: Column) -> Column:
    """What a winner line says about the hit. Fixed wording."""
    each = plain_number(g["amount"])
    size = F.size(g["numbers"]).cast("string")
    hit, won, combos = (c.cast("string") for c in (hit_count, win_units, g["combo_count"]))
    number = F.coalesce(two_digits(special), F.lit(""))
    label = F.when(F.coalesce(g["label"], F.lit("")) == "", F.lit("")).otherwise(F.concat(g["label"], F.lit("肖，")))
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (
        F.when(
            g["kind"] == "pool",
            say("复式", g["play"], "，", size, "码共", combos, "组，命中", hit, "码/", won, "组，", each, "一组"),
        )
        .when(
            g["kind"] == "zodiac",
            say("生肖", g["play"], "，", F.array_join(g["zodiacs"], ""), "共", combos, "组，命中", won, "组，", each, "一组"),
        )
        .when(
            g["kind"] == "listed",
            say("连码", g["play"], "，列出", combos, "组，命中", won, "组，", each, "一组"),
        )
        .otherwise(say(number, "号 / ", draw_zodiac, "，", label, "命中", hit, "码，", size, "码各", each))
    )


def settle_rows(groups: DataFrame) -> DataFrame:
    """Group rows carrying draw inputs, plus hit_count, win_units and win_amount."""
    g = {name: F.col(name) for name in ("kind", "numbers", "combos", "zodiac_combos", "pick")}
    return (
        groups.withColumn("hit", hits(g, F.col("special"), F.col("drawn"), F.col("drawn_zodiacs")))
        .withColumn("hit_count", F.col("hit.hit_count"))
        .withColumn("win_units", F.col("hit.win_units"))
        .withColumn("win_amount", payout(F.col("win_units"), F.col("amount"), F.col("odds")))
        .drop("hit")
    )


def winner_rows(settled: DataFrame) -> DataFrame:
    """Groups that won anything, with the text of the hit."""
    g = {name: F.col(name) for name in ("kind", "play", "label", "numbers", "zodiacs", "combo_count", "amount")}
    text = hit_text(g, F.col("hit_count"), F.col("win_units"), F.col("special"), F.col("draw_zodiac"))
    return settled.filter("win_units > 0").withColumn("hit_content", text)


def winners_of(groups: Column, special: Column, drawn: Column, zodiacs: Column, draw_zodiac: Column) -> Column:
    """Winners of a group array, in group order, without leaving the slip's row.

    Few groups win, so what a winner line says is worked out for these only.
    """
    won = F.filter(groups, lambda g: win_units(g, special, drawn, zodiacs) > 0)
    line = lambda g, hit: F.struct(
        g.user_name.alias("user_name"),
        hit_text(g, hit.hit_count, hit.win_units, special, draw_zodiac).alias("hit_content"),
        payout(hit.win_units, g.amount, g.odds).alias("win_amount"),
    )
    return F.transform(won, lambda g: let(hits(g, special, drawn, zodiacs), lambda hit: line(g, hit)))
