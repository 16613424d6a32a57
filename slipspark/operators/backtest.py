"""Every slip against every draw, without joining slips to draws.

What a slip wins depends on few numbers: the special one for a straight entry, the two or three members of a combination for the
rest. So stakes and prizes are summed per such cell first: 49 numbers, 1,176 pairs, 18,424 triples and 220 triples of zodiacs, for a
handful of plays. This stake cube is bounded by the draw's rules, whatever the number of slips; it is built by one exploding
aggregation whose partial sums leave a task with no more rows than the cube has. A draw then reads the cells that it hits: one number,
21 pairs and 35 triples of seven drawn numbers, and the triples of its zodiacs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipspark import dims
from slipspark.functions.lets import empty, let
from slipspark.functions.text import MONEY
from slipspark.operators.settle import keys_of
from slipspark.session import shared_dir

#: What can be staked: kind of group, and play (none for straight bets).
STAKED = (
    ("straight", ""),
    *(("pool", play) for play in dims.PLAYS),
    *(("listed", play) for play in dims.PLAYS),
    ("zodiac", dims.ZODIAC_POOL_PLAY),
)
PICKS = tuple(sorted({pick for pick, _ in dims.PLAYS.values()}))
MASKS = "array<bigint>"


def number_bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int"))


def zodiac_bit(zodiac: Column, order: str = dims.ZODIAC_ORDER) -> Column:
    at = F.array_position(F.array(*[F.lit(z) for z in order]), zodiac) - 1
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at.cast("int"))


def union_mask(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(b))


def subset_masks(bits: Column, pick: int) -> Column:
    """Masks of all ``pick``-member subsets of an array of different single bits."""
    if pick == 1:
        return bits
    size = F.size(bits)
    later = lambda i: F.slice(bits, i + 2, size)
    return F.flatten(F.transform(bits, lambda b, i: F.transform(subset_masks(later(i), pick - 1), lambda s: s.bitwiseOR(b))))


def subsets(bits: Column, pick: int) -> Column:
    """``subset_masks`` of an expression, which is computed once."""
    return let(bits, lambda b: subset_masks(b, pick))


def cells_of(g: dict[str, Column], order: str = dims.ZODIAC_ORDER) -> Column:
    """Cells that a group stakes its amount on, a cell as often as it is staked on."""
    bits = lambda members, bit: F.transform(members, bit)
    zodiac = lambda z: zodiac_bit(z, order)
    pools = F.when(F.lit(False), empty(MASKS))
    for pick in PICKS:
        pools = pools.when(g["pick"] == pick, subsets(bits(g["numbers"], number_bit), pick))
    cells = (
        F.when(g["kind"] == "straight", bits(g["numbers"], number_bit))
        .when(g["kind"] == "pool", pools)
        .when(g["kind"] == "listed", F.transform(g["combos"], lambda c: union_mask(bits(c, number_bit))))
        .when(g["kind"] == "zodiac", F.transform(g["zodiac_combos"], lambda c: union_mask(bits(c, zodiac))))
    )
    return F.coalesce(cells, empty(MASKS))


def stake_cube(groups: DataFrame, order: str = dims.ZODIAC_ORDER) -> DataFrame:
    """kind, play, cell, units, stake, prize over all group rows; no more rows than the rules have cells."""
    g = {name: F.col(name) for name in ("kind", "numbers", "combos", "zodiac_combos", "pick")}
    play = F.when(F.col("kind") == "straight", F.lit("")).otherwise(F.col("play")).alias("play")
    staked = groups.select("kind", play, "amount", "odds", F.explode(cells_of(g, order)).alias("cell"))
    return staked.groupBy("kind", "play", "cell").agg(
        F.count("*").alias("units"),
        F.sum("amount").cast(MONEY).alias("stake"),
        F.sum(F.col("amount") * F.col("odds")).cast(MONEY).alias("prize"),
    )


def space_of(kind: Column) -> Column:
    """Which of a draw's cells a kind of group looks at."""
    return F.when(kind == "straight", F.lit("special")).when(kind == "zodiac", F.lit("zodiacs")).otherwise(F.lit("numbers"))


def draw_cells(draws: DataFrame, keys: list[str], order: str = dims.ZODIAC_ORDER) -> DataFrame:
    """keys, space, cell: what each draw of ``draw_inputs`` hits."""
    in_space = lambda space, cells: F.transform(cells, lambda c: F.struct(F.lit(space).alias("space"), c.alias("cell")))
    numbers = F.transform("drawn", number_bit)
    zodiacs = F.array_compact(F.transform("drawn_zodiacs", lambda z: zodiac_bit(z, order)))
    cells = F.concat(
        in_space("special", F.array(number_bit(F.col("special")))),
        *[in_space("numbers", subsets(numbers, pick)) for pick in PICKS],
        in_space("zodiacs", subsets(zodiacs, dims.PLAYS[dims.ZODIAC_POOL_PLAY][0])),
    )
    return draws.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*").where(F.col("cell").isNotNull())


def backtest(groups: DataFrame, draws: DataFrame, key: str | list[str] = "draw_date", order: str = dims.ZODIAC_ORDER) -> DataFrame:
    """Totals of all group rows against each draw of ``draw_inputs``: keys, kind, play, stake, win_units, win_amount.

    Every draw has a row for each kind and play, with zeros where nothing is staked or won. Work is one pass over the groups and a
    hundred rows or so for each draw; neither side is copied to the other.
    """
    keys, spark = keys_of(key), groups.sparkSession
    path = shared_dir(spark, "stake-cube")
    stake_cube(groups, order).write.parquet(path)
    cube = spark.read.parquet(path)
    # bounded by the rules: under 80,000 rows for all kinds and plays together
    hit = draw_cells(draws, keys, order).join(F.broadcast(cube.withColumn("space", space_of(F.col("kind")))), ["space", "cell"])
    shape = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(play).alias("play")) for kind, play in STAKED])
    none = draws.select(*keys, F.explode(shape).alias("s")).select(*keys, "s.*", F.lit(0).cast("bigint").alias("units"), F.lit(0).cast(MONEY).alias("prize"))
    totals = hit.select(*none.columns).unionByName(none).groupBy(*keys, "kind", "play").agg(F.sum("units").alias("win_units"), F.sum("prize").cast(MONEY).alias("win_amount"))
    stakes = cube.groupBy("kind", "play").agg(F.sum("stake").cast(MONEY).alias("stake"))
    zero = F.coalesce("stake", F.lit(0).cast(MONEY)).alias("stake")
    return totals.join(F.broadcast(stakes), ["kind", "play"], "left").select(*keys, "kind", "play", zero, "win_units", "win_amount")
