"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Rules find the seeds: mail addresses, IPv4 addresses, card numbers, phone numbers, and secrets, which are runs of 32 or more
hexadecimal digits. Around a seed, and around every other token that looks like an identifier, lie lexical patterns of several levels: the
one and the two words before it, the word behind it, the words on either side, and the shape of the token itself (which of its
characters are digits, letters, marks). Patterns and instances make
a bipartite graph of counted edges. It is scored in turns: a pattern by the share of its instances that are known to be of
a kind, an instance by the patterns around it. Patterns that reach ``confident`` with enough different seeds then name the
unseen identifiers that have them. Found spans are added to those of the four rules, never in their place.

Every rule is linear in the length of the text: runs are taken possessively, and a rule starts only where a run does.
Texts are scanned in one map-only pass; from there on only spans, contexts and counts move. Edges are summed before the
exchange, so a frequent pattern or instance is a few rows, not one task.

Defined results: a null or empty text has no spans. Identifiers and contexts have any length; where fewer than two words lie between
two identifiers, the one before stands for a word, as ``#``. Repeated rows get the same spans. Spans are code points, end exclusive.
Columns named like a result are replaced, others are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipspark.functions.lets import exploded, let
from slipspark.llm.common import written

#: Kinds of the four rules, and that of the method's own seeds.
KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"

# Fixed by the rules for the four kinds; written so that no run is walked twice. \\G is the end of the match before.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a rule to be tried.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_IP_PARTS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2}|)(?:\.|$)){4}$"
#: A token that looks like an identifier: five characters or more, a digit or an at sign among them.
IDENTIFIER = r"(?<![A-Za-z0-9@._+-])(?=[A-Za-z._+-]*+[0-9@])[A-Za-z0-9@._+-]{4,}[A-Za-z0-9](?![A-Za-z0-9@_+-])"
#: A token that is a secret by itself: hexadecimal, with letters and digits.
_SECRET_RULE = r"^(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}$"
#: Two words, or one, at the end of a gap, read backwards, and the word at its start.
_BACK_TWO, _BACK_ONE, _NEXT = r"^\s*(\S+\s+\S+)", r"^\s*(\S+)", r"^\s*(\S+)"

SPAN = "array<struct<start:long,end:long,value:string,context:array<string>>>"
#: Hits that are placed in one fold; more are placed piece by piece.
PIECE = 256

ROUNDS, CONFIDENT, LEAST_SEEDS = 3, 0.8, 4
#: Copies of a sure pattern, so that a frequent one is not one task.
SALTS = 16


def _fold(items: Column) -> Column:
    """Places of hits relative to the first gap: struct(at, out)."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"), x["context"].alias("context"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    return F.aggregate(items, zero, step)


def _placed(items: Column) -> Column:
    """Spans of all hits: folded in pieces, so that the work stays linear however many there are."""
    starts = F.sequence(F.lit(0), (F.size(items) - 1).cast("int"), F.lit(PIECE))
    pieces = F.transform(starts, lambda at: _fold(F.slice(items, at + 1, F.lit(PIECE))))

    def joined(folded: Column) -> Column:
        bases = F.aggregate(
            F.transform(folded, lambda p: p["at"]),
            F.array(F.lit(0).cast("long")),
            lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n),
        )
        moved = let(
            bases,
            lambda b: F.transform(
                folded,
                lambda p, i: F.transform(
                    p["out"], lambda s: F.struct((s["start"] + F.get(b, i)).alias("start"), (s["end"] + F.get(b, i)).alias("end"), s["value"].alias("value"), s["context"].alias("context"))
                ),
            ),
        )
        return F.flatten(moved)

    return let(pieces, joined)


def shape(value: Column) -> Column:
    """What a token looks like: its digits and letters as classes; of hexadecimal tokens the length alone."""
    hexadecimal = value.rlike(_SECRET_RULE.replace("{32,}", "{8,}"))
    classes = F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[A-Za-z]", "a")
    return F.when(hexadecimal, F.concat(F.lit("hex"), F.length(value).cast("string"))).otherwise(classes)


def _before(gap: Column, earlier: Column) -> Column:
    """The two words before a hit, or less, backwards; what lies before the hit before counts where the gap is short."""
    words = lambda text, pattern: F.regexp_extract(F.reverse(F.lower(text)), pattern, 1)
    longer = F.concat(F.coalesce(earlier, F.lit("")), F.lit(" # "), gap)

    def chosen(two: Column) -> Column:
        return F.when(two != "", two).otherwise(F.when(earlier.isNull(), words(gap, _BACK_ONE)).otherwise(words(longer, _BACK_TWO)))

    return let(words(gap, _BACK_TWO), chosen)


def _patterns(hit: Column, gap: Column, earlier: Column, after: Column) -> Column:
    """The patterns of a hit, each with its level; those that it hasn't got are left out."""

    def of(w: Column) -> Column:
        back = F.regexp_replace(w["back"], r"\s+", " ")
        two, one, follows = F.reverse(back), F.reverse(F.substring_index(back, " ", 1)), w["next"]
        level = lambda name, has, *parts: F.when(has, F.concat(F.lit(name), *parts))
        return F.array_compact(
            F.array(
                level("2<", back.contains(" "), two),
                level("1<", back != "", one),
                level("1>", follows != "", follows),
                level("<>", (back != "") & (follows != ""), one, F.lit(" # "), follows),
                level("=", F.lit(True), shape(hit)),
            )
        )

    words = F.struct(_before(gap, earlier).alias("back"), F.regexp_extract(F.lower(after), _NEXT, 1).alias("next"))
    return let(words, of)


def spans_of(text: Column, pattern: str) -> Column:
    """All matches with place and patterns, leftmost first: what lies between the matches gives the places."""

    def both(gaps: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            gap = F.get(gaps, i)
            return F.struct(gap.alias("gap"), hit.alias("hit"), _patterns(hit, gap, F.get(gaps, i - 1), F.get(gaps, i + 1)).alias("context"))

        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return let(hits, lambda h: F.when(F.size(h) > 0, let(F.transform(h, one), _placed)))

    return F.coalesce(let(F.split(text, pattern, -1), both), F.array().cast(SPAN))


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(_IP_PARTS)
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def seeds(text: Column, kind: str) -> Column:
    need = _NEEDS[kind]
    likely = text.contains(need) if need else text.rlike("[0-9][ -]?[0-9]")
    found = F.filter(spans_of(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    return F.when(likely, found).otherwise(F.array().cast(SPAN))


def base_spans(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Every row with the spans of the four rules (a column per kind) and ``others``: identifiers that overlap none."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("*", *(seeds(body, k).alias(f"__{k}") for k in KINDS), F.when(body.rlike("[0-9@]"), spans_of(body, IDENTIFIER)).otherwise(F.array().cast(SPAN)).alias("__others"))
    taken = F.concat(*(F.col(f"__{k}") for k in KINDS))
    free = let(taken, lambda t: F.filter("__others", lambda o: ~F.exists(t, lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"]))))
    return rows.withColumn("__others", free)


def edges_of(found: DataFrame) -> DataFrame:
    """(pattern, instance, kind, n): the graph, one row per different edge; kind is null for what no rule knows."""
    parts = []
    for kind in (*KINDS, None):
        one = exploded(found, (), f"__{kind or 'others'}", "s")
        known = F.lit(kind) if kind else F.when(F.col("s.value").rlike(_SECRET_RULE), F.lit(SECRET))
        parts.append(one.select(F.explode("s.context").alias("pattern"), F.lower("s.value").alias("instance"), known.cast("string").alias("kind")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionAll(part)
    return rows.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.count("*").alias("n"))


def score_patterns(edges: DataFrame, *, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """(pattern, kind, score, n_seeds): the best kind of every pattern after scoring patterns and instances in turns.

    A pattern's score for a kind is what its instances score together, over their number plus one. An unknown instance
    scores, for a kind, the chance that at least one of its patterns is right, of those with ``least_seeds`` seeds.
    """
    known = edges.where("kind is not null").select("instance", "kind", F.lit(1.0).alias("p")).distinct()
    scores = known
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    unknown = edges.where("kind is null").select("pattern", "instance")
    patterns = None
    for turn in range(rounds):
        sums = edges.select("pattern", "instance").join(scores, "instance").groupBy("pattern", "kind")
        sums = sums.agg(F.sum("p").alias("p"), F.count(F.when(F.col("p") == 1.0, 1)).alias("n_seeds"))
        patterns = written(sums.join(sizes, "pattern").select("pattern", "kind", (F.col("p") / (F.col("size") + 1)).alias("score"), "n_seeds"), "pii-patterns")
        if turn + 1 < rounds:
            miss = F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-6)))))
            learned = unknown.join(patterns.where(F.col("n_seeds") >= least_seeds), "pattern").groupBy("instance", "kind").agg((1 - miss).alias("p"))
            scores = known.unionAll(written(learned, "pii-instances").select("instance", "kind", "p"))
    best = F.max(F.struct("score", "n_seeds", "kind")).alias("b")
    return patterns.groupBy("pattern").agg(best).select("pattern", "b.kind", "b.score", "b.n_seeds")


RESULT = ["spans"]


def _of_kind(kind: str) -> Column:
    return F.transform(f"__{kind}", lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def find_pii(docs: DataFrame, *, rounds: int = ROUNDS, confident: float = CONFIDENT, least_seeds: int = LEAST_SEEDS, text: str = "text") -> DataFrame:
    """Every row, without its text, with ``spans`` (kind, start, end): those of the four rules by kind, then the added ones.

    Added spans are secrets, of that kind, and ``context_<kind of the pattern>``; of several sure patterns the best one names an
    identifier, of equal ones the first kind.
    """
    # rows are told apart by id and text: equal rows have equal spans
    marked = docs.drop(*RESULT).withColumn("__row", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    found = written(base_spans(marked, text=text).drop(text), "pii-spans")
    patterns = score_patterns(written(edges_of(found), "pii-edges"), rounds=rounds, least_seeds=least_seeds)
    sure = written(patterns.where((F.col("score") >= confident) & (F.col("n_seeds") >= least_seeds)).select(F.col("pattern").alias("__context"), "kind", "score"), "pii-sure")

    others = exploded(found.where("size(__others) > 0"), ("doc_id", "__row"), "__others", "s")
    secrets = others.where(F.col("s.value").rlike(_SECRET_RULE)).select("doc_id", "__row", "s.start", "s.end", F.lit(SECRET).alias("kind"))
    unknown = others.where(~F.col("s.value").rlike(_SECRET_RULE)).select("doc_id", "__row", "s.start", "s.end", F.explode("s.context").alias("__context"))
    # a context may be frequent, and sure patterns many: then salts spread it
    salt = F.pmod(F.xxhash64("doc_id", "__row", "start"), F.lit(SALTS)).cast("int")
    salted = sure.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = unknown.withColumn("__salt", salt).join(salted, ["__context", "__salt"])
    named = named.groupBy("doc_id", "__row", "start", "end").agg(F.max_by("kind", F.struct("score", F.translate("kind", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"))).alias("kind"))
    added = secrets.unionByName(named.withColumn("kind", F.concat(F.lit("context_"), "kind")))
    added = added.select("doc_id", "__row", F.struct("start", "end", "kind").alias("s"))
    added = added.groupBy("doc_id", "__row").agg(F.array_sort(F.collect_set("s")).alias("__added")).toDF("__id", "__hash", "__added")
    rows = found.join(added, (F.col("__row") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    plain = [_of_kind(k) for k in KINDS]
    more = F.transform(F.coalesce("__added", F.array().cast("array<struct<start:long,end:long,kind:string>>")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = rows.withColumn("spans", F.concat(*plain, more))
    return rows.drop("__row", "__id", "__hash", "__added", "__others", *(f"__{k}" for k in KINDS))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(rows: DataFrame) -> DataFrame:
    """The columns of the contract."""
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    added = F.size(F.filter("spans", lambda s: ~s["kind"].isin(*KINDS))).cast("long")
    return rows.select("doc_id", *map(_count_of, KINDS), added.alias("n_added"), F.size("spans").cast("long").alias("n_spans"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
