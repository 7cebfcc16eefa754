"""Personal data: fixed patterns first, then bootstrapped contextual extraction.

Base spans are found by fixed patterns for e-mail addresses, IP addresses, card numbers and
phone numbers. They are the seeds of a graph of contexts (the one or two words before a
value, with the signs in between) and values (base spans, and other tokens with a digit).
In each round a context is scored by the share of its distinct values that are known to be
of a kind, a value by the contexts it occurs in; contexts whose share is high with confidence
(the lower bound of its interval, so that a few values prove little in any table) make
further values known. Rounds go on until no context is accepted any more. Tokens in an
accepted context that became known are new spans of its kind. Column expressions and joins only.

Defined results: a null text counts as empty; repeated documents each keep their row and
count once in the graph; without seeds, or without accepted contexts, only base spans remain;
texts of any length are searched whole; an empty table gives an empty result; other columns
of the input, whatever their names, are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlots.llm.common import keyed, on_key, settled, stored

KINDS = ("email", "ip", "card", "phone")

# Possessive, and anchored to where a run of their characters begins (or the last match
# ended), so that no text is scanned twice. Equal to the plain patterns they stand for.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Whole chains of digits, single spaces and hyphens, with 14 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TOKEN = r"(?<![A-Za-z0-9._%+@/-])(?=[A-Za-z._%+@/-]*+[0-9])[A-Za-z0-9._%+@/-]++"
BYTE = "^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"

# What a text must hold for a pattern to be worth trying.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "token": "[0-9]"}

# The last two words before a value, and all that stands between and after them, backwards.
BEFORE = r"^[^\p{L}]*+(?:\p{L}++(?:[^\p{L}]++\p{L}++)?+)?+"

# More rounds than any chain of contexts; each accepts one at least.
MAX_ROUNDS = 100
# Least share of a context's values that are of one kind: lower end of its 90 % interval.
MIN_CONTEXT = 0.6
CONFIDENCE = 1.645
MIN_VALUE = 0.8

KEY = ("doc_id", "text_hash")


def _luhn(digits: Column) -> Column:
    def place(digit: Column, at: Column) -> Column:
        n = digit.cast("int") * (1 + at % 2)
        return F.when(n > 9, n - 9).otherwise(n)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), place), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike(BYTE))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _matches(kind: int, pattern: str, guard: str) -> Column:
    """All matches of a pattern: number, characters from the end of the last one, value, text before it."""
    tried = F.col("text").rlike(guard)
    hits = F.when(tried, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    pieces = F.when(tried, F.split("text", pattern, -1))
    pairs = F.zip_with(pieces, hits, lambda piece, hit: F.struct(piece.alias("piece"), hit.alias("hit")))
    return F.transform(
        # The piece after the last match has no match of its own.
        F.filter(pairs, lambda pair: pair["hit"].isNotNull()),
        lambda pair, at: F.struct(
            F.lit(kind).alias("kind"), at.alias("number"), F.length(pair["piece"]).alias("gap"),
            pair["hit"].alias("value"),
            F.reverse(F.regexp_extract(F.reverse(pair["piece"]), BEFORE, 0)).alias("context"),
        ),
    )


def spans_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, end, kind, value, context) of base spans, and tokens elsewhere with a null kind.

    Places are running sums over the matches of a document, so that many matches in one
    text cost no more than their number.
    """
    token = len(KINDS)
    patterns = ((EMAIL, GUARDS["email"]), (IP, GUARDS["ip"]), (CARD, GUARDS["card"]), (PHONE, GUARDS["phone"]),
                (TOKEN, GUARDS["token"]))
    none = F.array().cast("array<struct<kind:int,number:int,gap:int,value:string,context:string>>")
    rows = keyed(docs).select(*KEY, *[
        F.coalesce(_matches(kind, *pattern), none).alias(f"kind_{kind}") for kind, pattern in enumerate(patterns)
    ])
    found = (
        rows.select(*KEY, F.explode(F.concat(*[f"kind_{kind}" for kind in range(token + 1)])).alias("m"))
        .select(*KEY, "m.*").repartition(*KEY)
    )
    # Equal rows are peers: sums over them are divided by how many they are.
    in_order = Window.partitionBy(*KEY, "kind").orderBy("number")
    upto = F.sum(F.col("gap") + F.length("value")).over(in_order.rangeBetween(Window.unboundedPreceding, 0))
    copies = F.count("*").over(in_order.rangeBetween(0, 0))
    placed = found.withColumn("end", (upto / copies).cast("int")).withColumn("start", F.col("end") - F.length("value"))
    valid = F.coalesce(
        *[F.when(F.col("kind") == number, _valid(kind, F.col("value"))) for number, kind in enumerate(KINDS)], F.lit(True)
    )
    trimmed = F.when(F.col("kind") == token, F.regexp_replace("value", "[._%+@/-]+$", "")).otherwise(F.col("value"))
    kept = placed.where(valid).withColumn("value", trimmed).withColumn("end", F.col("start") + F.length("value"))
    so_far = Window.unboundedPreceding, 0
    is_base = F.col("kind") < token
    before = F.max(F.when(is_base, F.col("end"))).over(Window.partitionBy(*KEY).orderBy("start").rangeBetween(*so_far))
    after = F.min(F.when(is_base, F.col("start"))).over(Window.partitionBy(*KEY).orderBy(F.desc("start")).rangeBetween(*so_far))
    apart = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return kept.withColumn("apart", apart).where(is_base | F.col("apart")).select(
        *KEY, "start", "end", F.when(is_base, F.col("kind")).alias("kind"), "value", "context"
    ).distinct()


def _contexts(context: Column) -> Column:
    """The last word, and the last two words, with the signs up to the value."""
    tail = F.regexp_replace(F.regexp_extract(context, r"[^\p{L}]*$", 0), r"\s+", " ")
    words = F.regexp_extract_all(F.lower(context), F.lit(r"\p{L}+"), F.lit(0))
    made = F.transform(
        F.sequence(F.lit(1), F.lit(2)),
        lambda n: F.when(
            (F.size(words) >= n) & ~tail.rlike("[0-9]"),
            F.concat(F.array_join(F.slice(words, F.size(words) - n + 1, n), " "), F.lit("|"), tail),
        ),
    )
    return F.filter(made, lambda one: one.isNotNull())


def occurrences(spans: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, end, kind, value, context), a row per context; kind is null for tokens."""
    return spans.select(
        *KEY, "start", "end", "kind", F.lower("value").alias("value"),
        F.explode(_contexts(F.col("context"))).alias("context"),
    )


def _surely(share: Column, n: Column) -> Column:
    """Lower bound of a share that was observed in n cases."""
    z = CONFIDENCE
    spread = z * F.sqrt(F.greatest(share * (1 - share), F.lit(0.0)) / n + z * z / (4 * n * n))
    return (share + z * z / (2 * n) - spread) / (1 + z * z / n)


def bootstrapped(
    found: DataFrame, min_context: float = MIN_CONTEXT, min_value: float = MIN_VALUE
) -> tuple[DataFrame, DataFrame]:
    """(context, kind, score) of the accepted contexts, (value, kind, score) of the known values."""
    links = settled(found.groupBy("context", "value").agg(F.max("kind").alias("kind")))
    degrees = settled(links.groupBy("context").agg(F.count("*").alias("degree")))
    seeds = settled(
        links.where("kind IS NOT NULL").groupBy("value", "kind").agg(F.lit(1.0).alias("score"))
    )
    links = links.select("context", "value")
    known, accepted = seeds, 0
    for _ in range(MAX_ROUNDS):
        sums = links.join(known, "value").groupBy("context", "kind").agg(F.sum("score").alias("sum"))
        contexts = settled(
            sums.join(degrees, "context")
            .where(_surely(F.col("sum") / F.col("degree"), F.col("degree")) >= min_context)
            .select("context", "kind", (F.col("sum") / (F.col("degree") + 1)).alias("score"))
        )
        # Known values only grow, and with them the accepted contexts.
        before, accepted = accepted, contexts.count()
        if accepted == before:
            return contexts, known
        # The chance that not all accepted contexts of a value are wrong.
        miss = F.exp(F.sum(F.log(1 - F.col("score"))))
        fresh = (
            links.join(contexts, "context").groupBy("value", "kind").agg((1 - miss).alias("score"))
            .where(F.col("score") >= min_value)
        )
        known = settled(
            seeds.unionByName(fresh).groupBy("value", "kind").agg(F.max("score").alias("score"))
        )
    raise RuntimeError(f"contexts did not settle in {MAX_ROUNDS} rounds")


def personal_data(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, text_hash, base, found): base spans and all spans, each (start, kind, end), by place."""
    spans = stored(spans_of(docs), "pii-spans")
    every = settled(occurrences(spans))
    contexts, known = bootstrapped(every, **how)
    new = (
        every.where("kind IS NULL").drop("kind")
        .join(contexts.select("context", "kind"), "context").join(known.select("value", "kind"), ["value", "kind"])
        .select(*KEY, "start", "kind", "end", F.lit(False).alias("base")).distinct()
    )
    base = spans.where("kind IS NOT NULL").select(*KEY, "start", "kind", "end", F.lit(True).alias("base"))
    span = F.struct("start", "kind", "end")
    lists = base.unionByName(new).groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"),
        F.array_sort(F.collect_list(span)).alias("found"),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return on_key(keyed(docs).select(*KEY), lists).select(
        *KEY, F.coalesce("base", none).alias("base"), F.coalesce("found", none).alias("found")
    )


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )
