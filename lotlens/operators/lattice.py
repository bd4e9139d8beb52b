"""All combinations of k signals from one shuffle: a bit mask for each key, a table of masks, sums over their subsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The lattice has 2^k rows, and 3^k ways from a mask to its subsets.
MOST_SIGNALS = 16


def key_masks(rows: DataFrame, key: str, flags: dict[str, Column], outcome: Column) -> DataFrame:
    """key, mask (bit i: some row of the key has flag i), outcome (some row has it); a null flag is none."""
    if not 0 < len(flags) <= MOST_SIGNALS:
        raise ValueError(f"between 1 and {MOST_SIGNALS} signals")
    bits = F.lit(0).cast("bigint")
    for i, flag in enumerate(flags.values()):
        bits = bits.bitwiseOR(F.when(flag, 1 << i).otherwise(0).cast("bigint"))
    return rows.groupBy(key).agg(F.bit_or(bits).alias("mask"), F.coalesce(F.bool_or(outcome), F.lit(False)).alias("outcome"))


def mask_table(masks: DataFrame) -> DataFrame:
    """mask, keys, hits: at most 2^k rows, whatever the number of keys."""
    return masks.groupBy("mask").agg(F.count("*").alias("keys"), F.count_if("outcome").alias("hits"))


def signal_lattice(table: DataFrame, names: Sequence[str], baseline: bool = True) -> DataFrame:
    """A row for each combination of signals, the empty one included, from a table of masks.

    combo (names joined by +), n_signals; keys and hits that have at least these signals; keys_exact and hits_exact
    that have these and no others; rate of the hits, lift over the rate of all keys (the empty combination).
    Combinations that no key has are left out.
    """

    # the subsets of a mask: walking down (s - 1) & mask needs state, so all numbers are tested; 2^k of them, on 2^k rows
    subset = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("mask")), lambda s: s.bitwiseAND(F.col("mask")) == s)
    rows = table.select("mask", "keys", "hits", F.explode(subset).alias("combo_mask"))
    exact = F.col("mask") == F.col("combo_mask")
    of = lambda c: F.sum(c).alias(c)
    own = lambda c: F.coalesce(F.sum(F.when(exact, F.col(c))), F.lit(0)).alias(f"{c}_exact")
    sums = rows.groupBy("combo_mask").agg(of("keys"), of("hits"), own("keys"), own("hits"))
    total = table.agg(F.sum("keys").alias("_keys"), F.sum("hits").alias("_hits"))  # one row
    set_ = F.array_compact(F.array(*[F.when(F.col("combo_mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, name in enumerate(names)]))
    rate = F.col("hits") / F.col("keys")
    lift = F.try_divide(rate, F.col("_hits") / F.col("_keys"))
    out = sums.crossJoin(F.broadcast(total)).select(F.array_join(set_, "+").alias("combo"), F.bit_count("combo_mask").cast("int").alias("n_signals"), "keys", "hits", "keys_exact", "hits_exact", F.round(rate, 6).alias("rate"), *([F.round(lift, 4).alias("lift")] if baseline else []))
    return out


def stacked_rates(table: DataFrame, least: Sequence[int]) -> DataFrame:
    """least, keys, hits, rate of the keys with so many signals or more, from the same table of masks."""
    rows = table.select("keys", "hits", F.bit_count("mask").alias("n"), F.explode(F.array(*[F.lit(x) for x in least])).alias("least"))
    sums = rows.filter("n >= least").groupBy("least").agg(F.sum("keys").alias("keys"), F.sum("hits").alias("hits"))
    return sums.withColumn("rate", F.round(F.col("hits") / F.col("keys"), 6))
