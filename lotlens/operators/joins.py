"""Key resolution and joins. Lookups are broadcast by Spark only if they are under its size threshold."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlens.functions.keys import block_of, lot_of
from lotlens.operators.windows import best_per_group


def bridge(df: DataFrame, lookup: DataFrame, key: str, into: str) -> DataFrame:
    """Replace one key by another through a lookup (key, into), the smallest target at ties; rows without a match are dropped."""
    return df.join(lookup.groupBy(key).agg(F.min(into).alias(into)).filter(F.col(into).isNotNull()), key)


def semi(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows without a match; rows with a null key have none."""
    return df.join(keys, on, "left_anti")


def narrowed(keys: DataFrame, on: str, most: int, *tables: DataFrame) -> list[DataFrame]:
    """The tables with the rows of the keys alone, by a broadcast, if the keys are counted as at most `most`; else as they are.

    For tables that are aggregated by the key and then joined to it. Rows of many keys would have to be shuffled and sorted
    whole to be picked, for each aggregate and all in one task; it is less to aggregate them all and let the join drop them.
    """
    if keys.limit(most + 1).count() > most:
        return list(tables)
    return [semi(df, F.broadcast(keys), on) for df in tables]


def left_default(df: DataFrame, other: DataFrame, on: str | Sequence[str], defaults: dict[str, object]) -> DataFrame:
    return df.join(other, on, "left").fillna(defaults)


def condo_lookup(buildings: DataFrame, key: str, units: str) -> DataFrame:
    """block, and the building on it with most units, the smaller key at ties."""
    blocks = buildings.select(F.col(key).alias("main"), block_of(F.col(key)).alias("block"), F.col(units).alias("_u"))
    return best_per_group(blocks, ["block"], [F.col("_u").desc_nulls_last(), F.col("main")]).select("block", "main")


def resolve_condo(df: DataFrame, buildings: DataFrame, key: str, units: str, min_condo_lot: int = 1000) -> DataFrame:
    """Adds `resolved` and `method`: the key itself if it is a building, else the block's main building for a condo lot."""
    direct = buildings.select(F.col(key).alias("_k"), F.col(key).alias("_direct")).distinct()
    main = condo_lookup(buildings, key, units).select(F.col("block").alias("_block"), F.col("main").alias("_main"))
    out = df.withColumn("_block", block_of(F.col(key))).withColumn("_k", F.col(key)).join(direct, "_k", "left").join(main, "_block", "left")
    condo = F.when(lot_of(F.col(key)) >= min_condo_lot, F.col("_main"))
    method = F.when(F.col("_direct").isNotNull(), "direct").when(condo.isNotNull(), "condo").otherwise("none")
    return out.withColumn("resolved", F.coalesce("_direct", condo)).withColumn("method", method).select(*df.columns, "resolved", "method")


def resolve_tiers(df: DataFrame, tiers: Sequence[tuple[str, Sequence[str], DataFrame]], target: str) -> DataFrame:
    """Adds `target` and `method` from the first tier that hits; a tier is (name, key columns, lookup with target)."""
    out, found = df, []
    for i, (name, keys, lookup) in enumerate(tiers):
        unique = lookup.groupBy(*keys).agg(F.min(target).alias(f"_t{i}"))
        out = out.join(unique, list(keys), "left")
        found.append((name, F.col(f"_t{i}")))
    method = F.when(F.lit(False), "")
    for name, hit in found:
        method = method.when(hit.isNotNull(), name)
    out = out.withColumn(target, F.coalesce(*[hit for _, hit in found])).withColumn("method", method.otherwise("none"))
    return out.drop(*[f"_t{i}" for i in range(len(found))])


def expand_gap(df: DataFrame, gap: Column, number: str = "n", cap: int | None = None) -> DataFrame:
    """A row for each of 1..gap; none for a gap of 0, since sequence(1, 0) would count down."""
    size = gap if cap is None else F.least(gap, F.lit(cap))
    return df.withColumn("_gap", size).filter("_gap > 0").withColumn(number, F.explode(F.sequence(F.lit(1), F.col("_gap").cast("int")))).drop("_gap")


def event_within(signals: DataFrame, outcomes: DataFrame, key: str, signal_date: str, outcome_date: str, days: Sequence[int]) -> DataFrame:
    """The signals with a flag `within_<d>` for each d: an outcome in the closed interval [date, date + d].

    Only the first outcome on or after the signal matters: both sides are reduced to distinct days of a key, and one
    window over these takes the next day with an outcome, so a key with many of both multiplies nothing.
    """
    dated = lambda df, c, outcome: df.select(key, F.col(c).alias("_d"), F.lit(outcome).alias("_outcome"))
    per_day = dated(signals, signal_date, False).union(dated(outcomes, outcome_date, True)).groupBy(key, "_d").agg(F.bool_or("_outcome").alias("_outcome"), F.bool_or(~F.col("_outcome")).alias("_signal"))
    # backwards in time, so that the frame grows: each day is added once
    onwards = Window.partitionBy(key).orderBy(F.desc("_d")).rowsBetween(Window.unboundedPreceding, 0)
    first = per_day.filter("_d is not null").withColumn("_first", F.min(F.when(F.col("_outcome"), F.col("_d"))).over(onwards)).filter("_signal and _first is not null")
    out = signals.join(first.select(key, F.col("_d").alias(signal_date), "_first"), [key, signal_date], "left")
    for d in days:
        out = out.withColumn(f"within_{d}", F.coalesce(F.col("_first") <= F.date_add(F.col(signal_date), d), F.lit(False)))
    return out.drop("_first")


def or_match(df: DataFrame, other: DataFrame, pairs: Sequence[tuple[str, str]], id_col: str, other_id: str) -> DataFrame:
    """(id, other id) that agree on any key pair: a union of equi-joins instead of a nested loop."""
    parts = [df.select(id_col, F.col(a).alias("_k")).join(other.select(other_id, F.col(b).alias("_k")), "_k").select(id_col, other_id) for a, b in pairs]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def contains_join(texts: DataFrame, text: str, words: DataFrame, word: str) -> DataFrame:
    """Rows of `texts` with each row of `words` whose word they contain as whole words; `word` is one word in lower case.

    A join on the words of the text replaces the nested loop. Only a hash of the text goes through it with its words;
    the texts meet what was found once, by that hash, and are looked at again.
    """
    parts = F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"))
    split = texts.select(F.xxhash64(text).alias("_row"), F.explode(parts).alias(word))
    found = split.join(words.select(word).distinct(), word).distinct()
    back = texts.withColumn("_row", F.xxhash64(text)).join(found, "_row").filter(F.array_contains(parts, F.col(word)))
    return back.drop("_row").join(words, word)


#: Signs of the key by which texts meet phrases.
GRAM = 4


def phrase_join(texts: DataFrame, text: str, phrases: DataFrame, phrase: str, max_bytes: int = 8 << 20) -> DataFrame:
    """Rows of `texts` with each phrase that they contain as a substring, in any case; repeated rows are kept.

    The phrases are measured. Under `max_bytes` they are collected and each text is tested, in Arrow batches, only for
    those of which it holds one gram of `LONG` signs, so a text is read about once whatever their number. Beyond that a
    phrase is looked up by the one of its grams of four signs (or, if it is shorter, by itself) that fewest phrases hold, in the
    distinct grams of each text. Only a hash of the text goes through that join with its grams; the texts meet the
    phrases they may hold once, by the hash, and are tested as before. Both ways give the same rows.
    """
    lowered = phrases.select(F.lower(phrase).alias("_p")).filter("_p is not null").distinct()
    if phrases.agg(F.coalesce(F.sum(F.octet_length(phrase)), F.lit(0))).first()[0] <= max_bytes:
        held = _held_phrases([r[0] for r in lowered.collect()])
        return texts.withColumn("_p", F.explode(held(F.lower(text)))).join(F.broadcast(phrases.withColumn("_p", F.lower(phrase))), "_p").drop("_p")
    sizes = [r[0] for r in lowered.select(F.least(F.length("_p"), F.lit(GRAM))).distinct().collect()]  # 0 to GRAM
    grams = lowered.select("_p", F.explode(_grams(F.col("_p"), F.least(F.length("_p"), F.lit(GRAM)))).alias("_gram"))
    held = grams.groupBy("_gram").agg(F.count("*").alias("_n"))
    keys = grams.join(held, "_gram").groupBy("_p").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    of_text = F.array_distinct(F.flatten(F.array(*[_grams(F.lower(F.col(text)), F.lit(n)) for n in sizes])))
    split = texts.select(F.xxhash64(text).alias("_row"), F.explode(of_text).alias("_gram"))
    maybe = split.join(keys, "_gram").select("_row", "_p").distinct()
    found = texts.withColumn("_row", F.xxhash64(text)).join(maybe, "_row").filter(F.contains(F.lower(F.col(text)), F.col("_p"))).drop("_row")
    return found.join(phrases.withColumn("_p", F.lower(phrase)), "_p").drop("_p")


#: Signs of the key by which texts are tested for collected phrases, and keys of a phrase that are compared.
LONG, TRIED = 12, 8


def _held_phrases(phrases: Sequence[str]) -> Callable[[Column], Column]:
    """A function of lower-case texts that gives the array of the phrases they hold.

    A phrase hangs at the one of up to `TRIED` of its grams of `LONG` signs that fewest phrases share; shorter ones are
    tested one by one.
    """
    tried = lambda p: {p[i : i + LONG] for i in range(0, len(p) - LONG + 1, len(p) // TRIED + 1)}
    counts = Counter(g for p in phrases for g in tried(p))
    short, by_gram = [], defaultdict(list)
    for p in sorted(phrases):
        if grams := tried(p):
            by_gram[min(grams, key=lambda g: (counts[g], g))].append(p)
        else:
            short.append(p)
    keys = set(by_gram)

    @F.arrow_udf("array<string>")
    def held(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            if t is None:
                out.append(None)
                continue
            near = keys.intersection(t[i : i + LONG] for i in range(len(t) - LONG + 1))
            out.append([p for p in short if p in t] + [p for g in sorted(near) for p in by_gram[g] if p in t])
        return pa.array(out, pa.list_(pa.string()))

    return held


def _grams(c: Column, n: Column) -> Column:
    """Distinct substrings of n signs; none of a shorter text."""
    last = F.length(c) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(c, i, n)))).otherwise(F.array().cast("array<string>"))


def star(base: DataFrame, key: str, *parts: DataFrame) -> DataFrame:
    """Left joins of pre-aggregated parts on one key; all share its partitioning."""
    for p in parts:
        base = base.join(p, key, "left")
    return base


def presence_matrix(keys: DataFrame, key: str, sets: dict[str, DataFrame]) -> DataFrame:
    """A boolean column for each set, and `n_signals`; one aggregation over the tagged union instead of a join each."""
    tagged = keys.select(key, F.lit(None).cast("string").alias("_s"))
    for name, s in sets.items():
        tagged = tagged.union(s.select(key, F.lit(name)))
    flags = [F.coalesce(F.bool_or(F.col("_s") == name), F.lit(False)).alias(name) for name in sets]
    out = tagged.groupBy(key).agg(F.bool_or(F.col("_s").isNull()).alias("_base"), *flags).filter("_base").drop("_base")
    return out.withColumn("n_signals", sum((F.col(s).cast("int") for s in sets), F.lit(0)))
