"""Deterministic sampling, balancing and augmentation by hash ranks.

A row's rank is the order of `md5(id|seed|tag)`, ties by id and seq, so a choice does not
depend on partitions.  The first k are found without a global sort: rows are counted by
the leading digits of their hash, the bucket the k-th row falls in is found from those
counts, and only that bucket is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions.noise import add_noise
from glossmill.operators.samples import with_source

#: Leading hex digits that are counted: at most 16 ** 3 buckets for each group.
DIGITS = 3
#: Draws made by one generating row.
CHUNK = 100_000
STRATEGIES = ("uniform", "sqrt", "log")


def order_hash(id_: Column | str, seed: int, tag: str) -> Column:
    return F.md5(F.concat_ws("|", F.col(id_) if isinstance(id_, str) else id_, F.lit(str(seed)), F.lit(tag)))


def share(n: Column, ratio: float) -> Column:
    """`int(n * ratio)` in doubles."""
    return F.floor(n.cast("double") * F.lit(float(ratio))).cast("long")


def ranked(rows: DataFrame, seed: int, tag: str, group: list[str], seq: str | None = None) -> DataFrame:
    """Add `__rank` from 1 within each group by hash, without sorting a group in one task."""
    staged = rows.withColumn("__hash", order_hash("id", seed, tag)).withColumn("__bucket", F.substring("__hash", 1, DIGITS))
    keys = [*group, "__bucket"]
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged.groupBy(*keys).agg(F.count("*").alias("__n")).select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*keys).orderBy("__hash", "id", *([seq] if seq else []))
    numbered = staged.withColumn("__at", F.row_number().over(within))
    join = F.lit(True)
    right = starts.select(*(F.col(k).alias(f"r{k}") for k in keys), "__start")
    for k in keys:
        join = join & F.col(k).eqNullSafe(F.col(f"r{k}"))
    return numbered.join(right, join).withColumn("__rank", F.col("__start") + F.col("__at")).drop("__hash", "__bucket", "__at", "__start", *(f"r{k}" for k in keys))


def pick(rows: DataFrame, ratio: float, seed: int, tag: str, seq: str | None = None) -> DataFrame:
    """The first `int(n * ratio)` of n rows by hash rank, at most all."""
    if ratio <= 0:
        return rows.limit(0)
    staged = rows.withColumn("__hash", order_hash("id", seed, tag)).withColumn("__bucket", F.substring("__hash", 1, DIGITS))
    # At most 16 ** DIGITS rows: where each bucket starts, and how many rows are wanted of all.
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    counts = staged.groupBy("__bucket").agg(F.count("*").alias("__n"))
    starts = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), share(F.sum("__n").over(every), ratio).alias("__wanted"))
    some = staged.join(F.broadcast(starts.where("__start < __wanted")), "__bucket")
    within = Window.partitionBy("__bucket").orderBy("__hash", "id", *([seq] if seq else []))
    return some.withColumn("__at", F.row_number().over(within)).where("__start + __at <= __wanted").select(*rows.columns)


def inject_identity(samples: DataFrame, ratio: float = 0.07, seed: int = 42, seq: str | None = None, rebuild: bool = False) -> DataFrame:
    """Copies of a share of the samples whose source is their target, ids tagged `_id`."""
    return with_source(pick(samples, ratio, seed, "identity", seq), F.col("target"), "_id", rebuild)


def noisy_samples(samples: DataFrame, ratio: float = 0.2, rate: float = 0.05, noise_type: str = "mixed", seed: int = 42, seq: str | None = None, rebuild: bool = False) -> DataFrame:
    """Copies of a share of the samples whose source is their target with synthetic errors, ids tagged `_aug`."""
    if ratio <= 0:
        return samples.limit(0)
    key = F.concat_ws("|", "id", *([F.col(seq).cast("string")] if seq else []), F.lit(str(seed)))
    return with_source(pick(samples, ratio, seed, "noise", seq), add_noise("target", key, noise_type, rate), "_aug", rebuild)


def balanced_targets(counts: DataFrame, strategy: str = "sqrt", target_per_lang: int | None = None) -> DataFrame:
    """(lang, n, target) from (lang, n): fixed, equal, or in proportion to sqrt(n) or ln(n + 1)."""
    if target_per_lang is not None:
        return counts.select("lang", "n", F.lit(int(target_per_lang)).cast("long").alias("target"))
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown strategy: {strategy}")
    # One row per language.
    every = Window.partitionBy(F.lit(1))
    total = F.sum("n").over(every)
    if strategy == "uniform":
        target = F.floor(total / F.count("*").over(every))
    else:
        weight = F.sqrt("n") if strategy == "sqrt" else F.log(F.col("n") + 1)
        target = F.floor(total * weight / F.sum(weight).over(every))
    return counts.select("lang", "n", target.cast("long").alias("target"))


def balance(samples: DataFrame, strategy: str = "sqrt", target_per_lang: int | None = None, seed: int = 42, seq: str | None = None) -> DataFrame:
    """Samples brought to each language's target, with `draw`: 0 for a sample itself, k for its k-th extra draw.

    Above the target the first by hash rank stay; below it all stay and the rest is
    drawn with replacement.  Draws carry their number, as ids repeat.
    """
    names = samples.columns
    targets = balanced_targets(samples.groupBy("lang").agg(F.count("*").alias("n")), strategy, target_per_lang)
    known = targets.select(F.col("lang").alias("__lang"), F.col("n").alias("__size"), F.col("target").alias("__target"))
    rows = ranked(samples, seed, "balance", ["lang"], seq)
    kept = rows.join(known, F.col("lang").eqNullSafe(F.col("__lang"))).where(F.col("__rank") <= F.col("__target")).select(*names, F.lit(0).cast("long").alias("draw"))
    lacking = known.where(F.col("__target") > F.col("__size")).withColumn("__extra", F.col("__target") - F.col("__size"))
    chunks = lacking.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__extra") - 1) / CHUNK))))
    first, last = F.col("__c") * CHUNK + 1, F.least((F.col("__c") + 1) * CHUNK, F.col("__extra"))
    draws = chunks.withColumn("draw", F.explode(F.sequence(first, last)))
    at = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce("__lang", F.lit("")), F.col("draw").cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long"), F.col("__size")) + 1
    draws = draws.select("__lang", "draw", at.alias("__at"))
    extra = rows.join(draws, F.col("lang").eqNullSafe(F.col("__lang")) & (F.col("__rank") == F.col("__at"))).select(*names, "draw")
    return kept.unionByName(extra)


def shuffled(samples: DataFrame, seed: int = 42, extra: str = "draw") -> DataFrame:
    """Rows in the order of their hash: a full permutation, for a sink."""
    more = [F.col(extra).cast("string")] if extra in samples.columns else []
    return samples.orderBy(F.md5(F.concat_ws("|", "id", *more, F.lit(str(seed)), F.lit("shuffle"))), "id", *([extra] if more else []))
