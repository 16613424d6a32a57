"""Slip texts to bet groups.

A slip is one row and stays one row: every extractor is an expression over its text, so extraction is a map-only stage
however the slips are distributed, and a popular bettor or draw date cannot unbalance it. Only lines whose meaning
depends on earlier lines (wrapped amounts, pool blocks, listed combinations) need an ordered fold over the line array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipspark import dims
from slipspark.functions.combos import combination_count, k_subsets
from slipspark.functions.lets import built_once, empty, let
from slipspark.functions.text import AMOUNT, JS_WS, MONEY, amount_of, contains_any, non_blank, raw_lines
from slipspark.functions.tokens import (
    bettor_name,
    cn_integer,
    numbers_before_play,
    numbers_in,
    play_odds,
    play_of,
    play_pick,
    trailing_amount,
    zodiac_numbers,
)

_AW = "|".join(dims.AMOUNT_WORDS)
PLAY_WORDS = (*dims.PLAYS, dims.UNPRICED_PLAY)
_GW = "|".join(dims.PER_GROUP_WORDS)
_Z = f"[{dims.ZODIAC_ORDER}]"
_WS = f"[{JS_WS}]*"

# Fixed patterns of the bet language. Of a bet the patterns find the mark and the amount; its text is what stands before, back
# to the last bet or separator, so a line is read once and not again from every place where a text could begin. A mark
# right at that beginning is part of the text: a text has at least one character.
SLASH_MARK = rf"(?s)\G(.*?)/(?<=[^/\r\n]/)(?<!\G/){_WS}+(\d+)"
_UP_TO_SLASH_TEXT = r"^(?:[^/\r\n]*+[/\r\n])++"
# Every amount word ends in one of these characters, each of which is an amount word itself, and no word holds a digit:
# so the last character before the amount decides, and words left of it may count as text. The range rules out most characters.
_AW_END = r"[下-押&&[各下押买]]"
_SEPARATORS = r"，,。；;\r\n"
CHINESE_MARK = rf"(?s)\G(.*?){_AW_END}(?<=[^{_SEPARATORS}].)(?<!\G.){_WS}+(\d+(?:\.\d+)?){_WS}+元?+"
_UP_TO_CHINESE_TEXT = rf"^(?:[^{_SEPARATORS}]*+[{_SEPARATORS}])++"
# The zodiac is looked for first and the separator behind it second; one that the last match took is used up.
_ZODIAC = f"[{min(dims.ZODIAC_ORDER)}-{max(dims.ZODIAC_ORDER)}&&{_Z}]"
ZODIAC_BET = rf"({_ZODIAC})(?:(?<=^.)|(?<=[，,。；;{JS_WS}].)(?<!\G.)){_WS}(?:{_AW})?{_WS}(\d+(?:\.\d+)?){_WS}元?"
INLINE_POOL = rf"(?:二中[二三]|三中三){_WS}[^/，,。；;\r\n]+?/{_WS}\d+(?:\.\d+)?"
ZODIAC_POOL = rf"^({_Z}{{4}}){_WS}复四三{_WS}(?:{_GW})?{_WS}(\d+(?:\.\d+)?|[{dims.CN_DIGITS}两十]+){_WS}元?\z"
YUAN_AMOUNT = rf"\G(?:\D++|\d++(?!{_WS}元))*+(\d++){_WS}+元"
# Numbers of what such an amount ends, without the amount.
_BEFORE_YUAN = rf"(?<!\d)0*+([1-9]|[1-4]\d)(?!\d)(?!{_WS}元\z)"

GROUPS = (
    "array<struct<family:string,kind:string,user_name:string,play:string,label:string,numbers:array<int>,"
    "combos:array<array<int>>,zodiacs:array<string>,zodiac_combos:array<array<string>>,amount:decimal(28,4),"
    "combo_count:bigint,bet_amount:decimal(38,4),pick:int,odds:int>>"
)
BETS = "array<struct<family:string,label:string,numbers:array<int>,amount:decimal(28,4)>>"
NAMED_BETS = "array<struct<family:string,label:string,numbers:array<int>,amount:decimal(28,4),user_name:string>>"


def _bets(family: str, heads: Column, amounts: Column, numbers_of=numbers_in, label_of=None) -> Column:
    """Pair texts with amounts; drop pairs without numbers or amount."""
    paired = F.zip_with(
        heads,
        amounts,
        lambda head, amount: F.struct(
            F.lit(family).alias("family"),
            (label_of(head) if label_of else F.lit(None).cast("string")).alias("label"),
            numbers_of(head).alias("numbers"),
            amount_of(amount).alias("amount"),
        ),
    )
    return F.filter(paired, lambda bet: (F.size(bet.numbers) > 0) & (bet.amount > 0))


def _matched(text: Column, guard: Column, pattern: str, family: str, **kinds) -> Column:
    # The guard is a cheap necessary condition; without it the lazy patterns rescan long prose from every position.
    heads = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    amounts = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.when(guard, _bets(family, heads, amounts, **kinds)).otherwise(empty(BETS))


def _marked(text: Column, mark: str, separators: str, up_to_text: str, family: str) -> Column:
    """Bets whose marks match: the text of each is what stands between the last match, or the last separator, and the mark."""
    part = lambda group: F.regexp_extract_all(text, F.lit(mark), F.lit(group))
    numbers = lambda piece: numbers_in(F.when(contains_any(piece, separators), F.regexp_replace(piece, up_to_text, "")).otherwise(piece))
    return let(part(2), lambda amounts: F.when(F.size(amounts) > 0, _bets(family, part(1), amounts, numbers_of=numbers)).otherwise(empty(BETS)))


def slash_bets(line: Column, family: str = "slash") -> Column:
    bets = _marked(line, SLASH_MARK, "/\r\n", _UP_TO_SLASH_TEXT, family)
    return F.when(line.contains("/"), bets).otherwise(empty(BETS))


def chinese_bets(line: Column) -> Column:
    bets = _marked(line, CHINESE_MARK, "，,。；;\r\n", _UP_TO_CHINESE_TEXT, "cn")
    return F.when(contains_any(line, "各下押买"), bets).otherwise(empty(BETS))


def zodiac_bets(line: Column) -> Column:
    return _matched(
        line, contains_any(line, dims.ZODIAC_ORDER), ZODIAC_BET, "zodiac", numbers_of=zodiac_numbers, label_of=lambda zodiac: zodiac
    )


def _chained(*arrays: Column) -> Column:
    """``concat`` of arrays that are never null. Inside a lambda a concat evaluates through a lazy list, which costs more."""
    return F.flatten(F.array(*arrays))


_LINE_FAMILIES = {"slash": slash_bets, "cn": chinese_bets, "zodiac": zodiac_bets}


def _suffixed(name: Column, position: Column) -> Column:
    suffix = F.concat(F.lit(" 第"), (position + 1).cast("string"), F.lit("组"))
    return F.concat(name, F.when(position > 0, suffix).otherwise(F.lit("")))


def _nth(position: Column) -> Column:
    return F.concat(F.lit("第"), (position + 1).cast("string"), F.lit("组"))


def _straight(bet: Column) -> Column:
    return _group(
        bet.family,
        "straight",
        bet.user_name,
        numbers=bet.numbers,
        amount=bet.amount,
        label=bet.label,
        units=F.size(bet.numbers),
    )


def _named(bet: Column, name: Column) -> Column:
    return F.struct(
        bet.family.alias("family"),
        bet.label.alias("label"),
        bet.numbers.alias("numbers"),
        bet.amount.alias("amount"),
        name.alias("user_name"),
    )


def _group(
    family,
    kind: str,
    name: Column,
    *,
    numbers: Column,
    amount: Column,
    units: Column,
    play: Column | None = None,
    label: Column | None = None,
    combo_count: Column | None = None,
    combos: Column | None = None,
    zodiacs: Column | None = None,
    zodiac_combos: Column | None = None,
) -> Column:
    none = F.lit(None)
    family = family if isinstance(family, Column) else F.lit(family)
    return F.struct(
        family.alias("family"),
        F.lit(kind).alias("kind"),
        name.alias("user_name"),
        (none if play is None else play).cast("string").alias("play"),
        (none if label is None else label).cast("string").alias("label"),
        numbers.alias("numbers"),
        (none if combos is None else combos).cast("array<array<int>>").alias("combos"),
        (none if zodiacs is None else zodiacs).cast("array<string>").alias("zodiacs"),
        (none if zodiac_combos is None else zodiac_combos).cast("array<array<string>>").alias("zodiac_combos"),
        amount.cast(AMOUNT).alias("amount"),
        (none if combo_count is None else combo_count).cast("bigint").alias("combo_count"),
        (units.cast("bigint") * amount).cast(MONEY).alias("bet_amount"),
        (F.lit(1) if play is None else play_pick(play)).alias("pick"),
        (F.lit(dims.STRAIGHT_ODDS) if play is None else play_odds(play)).alias("odds"),
    )


def line_bets(text: Column, families: tuple[str, ...] = ("slash", "cn", "zodiac")) -> Column:
    """Straight bets read line by line; bets of one line are numbered across the families."""
    return _line_bets(raw_lines(text), families)


def _line_bets(lines: Column, families: tuple[str, ...] = ("slash", "cn", "zodiac")) -> Column:

    def of_line(line: Column, index: Column) -> Column:
        named = lambda bets: let(
            bettor_name(line, index),
            lambda name: F.transform(bets, lambda bet, k: _named(bet, _suffixed(name, k))),
        )
        found = _chained(*[_LINE_FAMILIES[family](line) for family in families])
        return let(found, lambda bets: F.when(F.size(bets) > 0, named(bets)).otherwise(empty(NAMED_BETS)))

    return F.flatten(F.transform(non_blank(lines), of_line))


def _lines_if(said: Column, lines: Column) -> Column:
    """The lines of a text that says something, else one empty line."""
    return F.when(said, lines).otherwise(F.array(F.lit("")))


def line_groups(text: Column, families: tuple[str, ...] = ("slash", "cn", "zodiac")) -> Column:
    return F.transform(line_bets(text, families), _straight)


def wrapped_slash_bets(text: Column) -> Column:
    """Slash bets whose text was broken over lines; rebuilt by a fold, because what continues depends on what was kept."""
    return _wrapped_slash_bets(text, raw_lines(text))


def _wrapped_slash_bets(text: Column, lines: Column) -> Column:
    usable = F.filter(_lines_if(text.contains("/"), lines), lambda line: (line != "") & ~contains_any(line, "号各下押买元特码"))

    # Conditions are ordered so that a line is only looked into when the lines before it leave something open.
    def step(acc: Column, line: Column) -> Column:
        resumes = acc.cut_number & (F.size(numbers_in(line)) >= 2)
        keep = line.contains("/") | resumes | (acc.cut_amount & line.rlike(r"^\d{1,2}\z"))
        glued = line.contains("/") & (acc.text != "") & ~resumes
        return F.when(
            keep,
            F.struct(
                F.concat(acc.text, F.when(glued, F.lit(".")).otherwise(F.lit("")), line).alias("text"),
                line.rlike(r"\.\d\z").alias("cut_number"),
                line.rlike(r"/\d{1,2}\z").alias("cut_amount"),
            ),
        ).otherwise(acc)

    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("cut_number"), F.lit(False).alias("cut_amount"))
    rebuilt = F.aggregate(usable, start, step, lambda acc: acc.text)
    bets = let(rebuilt, lambda joined: slash_bets(joined, "slash_wrapped"))
    return F.transform(bets, lambda bet, k: _named(bet, _nth(k)))


def wrapped_chinese_bets(text: Column) -> Column:
    """Chinese-amount bets over lines, cut at each amount in 元; a cut that yields no bet stays in the next source."""
    return _wrapped_chinese_bets(text, raw_lines(text))


def _wrapped_chinese_bets(text: Column, lines: Column) -> Column:
    kept = F.filter(
        _lines_if(text.contains("元"), lines),
        lambda line: contains_any(line, ("号", "元", "特码", "各下", "各押", "各买")) | line.rlike(r"[下押买]\d"),
    )
    joined = F.regexp_replace(F.array_join(kept, "."), r"([各下押买])\.(?=\d)", "$1")

    def pieces(whole: Column) -> Column:
        part = lambda group: F.regexp_extract_all(whole, F.lit(YUAN_AMOUNT), F.lit(group))
        return F.arrays_zip(part(0).alias("text"), part(1).alias("digits"))

    def step(acc: Column, piece: Column) -> Column:
        def with_source(source_text: Column) -> Column:
            bet = F.struct(
                F.lit("cn_wrapped").alias("family"),
                F.lit(None).cast("string").alias("label"),
                F.regexp_extract_all(source_text, F.lit(_BEFORE_YUAN), F.lit(1)).cast("array<int>").alias("numbers"),
                amount_of(piece["digits"]).alias("amount"),
            )
            return let(
                bet,
                lambda b: F.when(
                    (F.size(b.numbers) > 0) & (b.amount > 0),
                    F.struct(F.lit("").alias("carry"), F.array_append(acc.out, b).alias("out")),
                ).otherwise(F.struct(source_text.alias("carry"), acc.out.alias("out"))),
            )

        return let(F.concat(acc.carry, piece["text"]), with_source)

    start = F.struct(F.lit("").alias("carry"), empty(BETS).alias("out"))
    bets = F.aggregate(let(joined, pieces), start, step, lambda acc: acc.out)
    return F.transform(bets, lambda bet, k: _named(bet, _nth(k)))


def wrapped_slash_groups(text: Column) -> Column:
    return F.transform(wrapped_slash_bets(text), _straight)


def wrapped_chinese_groups(text: Column) -> Column:
    return F.transform(wrapped_chinese_bets(text), _straight)


def _combo_line(line: Column, index: Column) -> Column:
    """What a line says about plays, computed once before a fold reads it."""
    return let(
        play_of(line),
        lambda play: F.struct(
            index.alias("index"),
            (line == "").alias("blank"),
            line.contains("/").alias("slash"),
            play.alias("play"),
            F.coalesce(play_pick(play), F.lit(0)).alias("pick"),
            F.when(play != "", trailing_amount(line)).otherwise(F.lit(0).cast(AMOUNT)).alias("amount"),
            numbers_before_play(line, play).alias("numbers"),
        ),
    )


def _said_lines(text: Column) -> Column:
    """Lines of a text that names a play."""
    return _lines_if(contains_any(text, PLAY_WORDS), raw_lines(text))


def _play_lines(text: Column) -> Column:
    return F.transform(_said_lines(text), _combo_line)


def pool_block_groups(text: Column) -> Column:
    """Pools opened by a priced play line and filled by the number lines below it."""
    return _pool_block_groups(_said_lines(text))


def _pool_block_groups(lines: Column) -> Column:
    pool = "array<struct<start:int,play:string,amount:decimal(28,4),numbers:array<int>>>"

    def pending(acc: Column) -> Column:
        return F.struct(
            acc["start"].alias("start"),
            acc.play.alias("play"),
            acc.amount.alias("amount"),
            F.array_distinct(acc.numbers).alias("numbers"),
        )

    def state(open_, start, play, amount, numbers, out) -> Column:
        return F.struct(
            open_.alias("open"),
            start.alias("start"),
            play.alias("play"),
            amount.alias("amount"),
            numbers.alias("numbers"),
            out.alias("out"),
        )

    none = empty("array<int>")

    def step(acc: Column, x: Column) -> Column:
        header = (x.play != "") & (x.amount > 0) & ~x.slash
        closed_out = F.when(acc.open, F.array_append(acc.out, pending(acc))).otherwise(acc.out)
        grows = acc.open & (x.play == "") & ~x.slash & (F.size(x.numbers) > 0)
        return (
            F.when(header, state(x.pick > 0, x["index"], x.play, x.amount, x.numbers, closed_out))
            .when(x.blank | ~acc.open, acc)
            .when(grows, state(acc.open, acc["start"], acc.play, acc.amount, F.concat(acc.numbers, x.numbers), acc.out))
            .otherwise(state(F.lit(False), acc["start"], acc.play, acc.amount, none, closed_out))
        )

    zero = state(
        F.lit(False), F.lit(0), F.lit(""), F.lit(0).cast(AMOUNT), none, empty(pool)
    )
    finish = lambda acc: F.when(acc.open, F.array_append(acc.out, pending(acc))).otherwise(acc.out)
    pools = F.aggregate(F.transform(lines, _combo_line), zero, step, finish)
    named = F.transform(
        pools,
        lambda p: _pool(
            "pool_block",
            F.concat(F.lit("第"), (p["start"] + 1).cast("string"), F.lit("行 复式"), p.play),
            p.play,
            p.numbers,
            p.amount,
        ),
    )
    return F.filter(named, lambda g: g.combo_count > 0)


def _pool(family: str, name: Column, play: Column, numbers: Column, amount: Column) -> Column:
    size = F.struct(F.size(numbers).alias("n"), play_pick(play).alias("k"))
    return let(
        let(size, lambda s: combination_count(s.n, s.k)),
        lambda count: _group(
            family, "pool", name, play=play, label=play, numbers=numbers, amount=amount, combo_count=count, units=count
        ),
    )


def inline_pool_groups(line: Column, name: Column) -> Column:
    """Pools written on one line as play, numbers, slash, amount."""
    found = F.transform(
        F.regexp_extract_all(line, F.lit(INLINE_POOL), F.lit(0)),
        lambda bet: F.struct(
            F.substring(bet, 1, 3).alias("play"),
            F.array_distinct(
                numbers_in(F.substring_index(F.substring(bet, F.lit(4), F.length(bet)), "/", 1))
            ).alias("numbers"),
            trailing_amount(bet).alias("amount"),
        ),
    )
    priced = F.filter(
        found,
        lambda p: play_pick(p.play).isNotNull() & (F.size(p.numbers) >= play_pick(p.play)) & (p.amount > 0),
    )
    return F.transform(priced, lambda p, k: _pool("pool_inline", _suffixed(name, k), p.play, p.numbers, p.amount))


def zodiac_pool_groups(line: Column, name: Column) -> Column:
    """Four distinct zodiacs, every three of them a combination; an array of one group or none."""
    parts = F.struct(
        F.array_distinct(F.split(F.regexp_extract(line, ZODIAC_POOL, 1), "")).alias("zodiacs"),
        let(F.regexp_extract(line, ZODIAC_POOL, 2), cn_integer).alias("amount"),
    )
    play = F.lit(dims.ZODIAC_POOL_PLAY)
    valid = F.filter(F.array(parts), lambda p: (F.size(p.zodiacs) == 4) & (p.amount > 0))
    return F.transform(
        valid,
        lambda p: _group(
            "zodiac_pool",
            "zodiac",
            name,
            play=play,
            label=play,
            numbers=F.flatten(F.transform(p.zodiacs, lambda z: zodiac_numbers(z))),
            zodiacs=p.zodiacs,
            zodiac_combos=k_subsets(p.zodiacs, 4, 3),
            amount=p.amount,
            combo_count=F.lit(4),
            units=F.lit(4),
        ),
    )


def listed_groups(text: Column) -> Column:
    """Number lines held until a line with play and amount prices those of the right size."""
    listed = "array<struct<start:int,play:string,amount:decimal(28,4),combos:array<array<int>>>>"

    def state(pending, start, out) -> Column:
        return F.struct(pending.alias("pending"), start.alias("start"), out.alias("out"))

    no_combos = empty("array<array<int>>")

    def step(acc: Column, x: Column) -> Column:
        closes = (x.play != "") & (x.amount > 0) & (x.pick > 0)
        holds = (
            F.when(closes, F.size(x.numbers) == x.pick)
            .when(x.play == "", ~x.slash & (F.size(x.numbers) >= 2))
            .otherwise(F.lit(False))
        )
        held = F.struct(
            F.when(holds, F.array_append(acc.pending, x.numbers)).otherwise(acc.pending).alias("pending"),
            F.when(holds & (F.size(acc.pending) == 0), x["index"]).otherwise(acc["start"]).alias("start"),
        )

        def priced(h: Column) -> Column:
            fitting = F.filter(h.pending, lambda combo: F.size(combo) == x.pick)
            bet = F.struct(
                h["start"].alias("start"), x.play.alias("play"), x.amount.alias("amount"), fitting.alias("combos")
            )
            return (
                F.when(x.blank, state(no_combos, acc["start"], acc.out))
                .when(
                    closes & F.exists(h.pending, lambda combo: F.size(combo) == x.pick),
                    state(no_combos, h["start"], F.array_append(acc.out, bet)),
                )
                .otherwise(state(h.pending, h["start"], acc.out))
            )

        return let(held, priced)

    zero = state(no_combos, F.lit(0), empty(listed))
    groups = F.aggregate(_play_lines(text), zero, step, lambda acc: acc.out)
    return F.transform(
        groups,
        lambda g: _group(
            "listed",
            "listed",
            F.concat(F.lit("第"), (g["start"] + 1).cast("string"), F.lit("行 "), g.play),
            play=g.play,
            label=g.play,
            numbers=F.array_distinct(F.flatten(g.combos)),
            combos=g.combos,
            amount=g.amount,
            combo_count=F.size(g.combos),
            units=F.size(g.combos),
        ),
    )


def total_stake(groups: Column) -> Column:
    return F.aggregate(groups, F.lit(0).cast(MONEY), lambda acc, g: (acc + g.bet_amount).cast(MONEY))


def _bet_stake(bets: Column) -> Column:
    stake = lambda bet: F.size(bet.numbers).cast("bigint") * bet.amount
    return F.aggregate(bets, F.lit(0).cast(MONEY), lambda acc, bet: (acc + stake(bet)).cast(MONEY))


def pingma_groups(text: Column) -> Column:
    """Straight bets; a wrapped reading replaces its line-by-line twin when it finds a strictly higher stake."""
    readings = lambda lines: F.struct(
        _line_bets(lines).alias("lines"),
        _wrapped_slash_bets(text, lines).alias("slash_wrapped"),
        _wrapped_chinese_bets(text, lines).alias("cn_wrapped"),
    )

    def family(r: Column, name: str) -> Column:
        return F.filter(r.lines, lambda bet: bet.family == name)

    def better(by_line: Column, wrapped: Column) -> Column:
        higher = (F.size(wrapped) > 0) & (_bet_stake(wrapped) > _bet_stake(by_line))
        return F.when(higher, wrapped).otherwise(by_line)

    chosen = let(
        let(raw_lines(text), readings),
        lambda r: _chained(
            better(family(r, "slash"), r.slash_wrapped), better(family(r, "cn"), r.cn_wrapped), family(r, "zodiac")
        ),
    )
    return F.transform(chosen, _straight)


def fushi_groups(text: Column) -> Column:
    """Pool blocks first, then the one-line pools in line order."""

    none = empty(GROUPS)

    def of_line(line: Column, index: Column) -> Column:
        # A line full of four zodiacs and 复四三 leaves no room for a slash, so it holds one kind or the other.
        name = bettor_name(line, index)
        return (
            F.when(line.contains("/"), inline_pool_groups(line, name))
            .when(line.contains("复四三"), zodiac_pool_groups(line, name))
            .otherwise(none)
        )

    by_line = lambda lines: F.flatten(F.transform(non_blank(lines), of_line))
    return let(_said_lines(text), lambda lines: _chained(_pool_block_groups(lines), by_line(lines)))


MODE_GROUPS = {"pingma": pingma_groups, "lianma": listed_groups, "fushi": fushi_groups}
#: The one mode whose texts can hold a kind of group.
KIND_MODE = {"straight": "pingma", "listed": "lianma", "pool": "fushi", "zodiac": "fushi"}
_EXTRACTORS = {mode: built_once(extractor) for mode, extractor in MODE_GROUPS.items()}


def groups_of(mode: str, text: str) -> Column:
    """Bet groups of the text column under the mode column."""
    chain = F.when(F.lit(False), F.lit(None))
    for name, extractor in _EXTRACTORS.items():
        chain = chain.when(F.col(mode) == name, extractor(text))
    return F.coalesce(chain, empty(GROUPS))


def with_groups(slips: DataFrame) -> DataFrame:
    """Wide slips (one text column per mode) plus a ``groups_<mode>`` array column for each. Map-only.

    An absent text holds no bet.
    """
    return slips.withColumns({f"groups_{mode}": F.coalesce(_EXTRACTORS[mode](mode), empty(GROUPS)) for mode in dims.MODES})


def group_rows(slips: DataFrame, groups: Column, keys: tuple[str, ...] = ("slip_id",)) -> DataFrame:
    """One row per bet group, ``ord`` counting from 0 in the order of the slip."""
    return slips.select(*keys, F.posexplode(groups).alias("ord", "g")).select(*keys, "ord", "g.*")


def extract(slips: DataFrame, keys: tuple[str, ...] = ("slip_id", "mode")) -> DataFrame:
    """Long slips ``(slip_id, mode, raw_text)`` to rows of bet groups."""
    return group_rows(slips, groups_of("mode", "raw_text"), keys)
