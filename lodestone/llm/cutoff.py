"""Exact score cutoffs per source by iterative histogram refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut

MAX = 1.7976931348623157e308
BINS = 4096
#: Up to so many (key, target) rows are broadcast to the scan; above it the join shuffles.
BROADCAST_KEYS = 10_000


def _bin(s: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of s in [lo, hi]: non-decreasing in s, 0 for lo and bins - 1 for hi, so every round narrows the interval."""
    width = hi / 2 - lo / 2
    raw = F.when(width > 0, F.floor((s / 2 - lo / 2) / width * bins)).otherwise(F.lit(0))
    return F.when(s >= hi, F.lit(bins - 1)).otherwise(F.least(raw, F.lit(bins - 2))).cast("int")


def refine(base: DataFrame, targets: DataFrame, bins: int = BINS) -> DataFrame:
    """The highest cutoff per key at or above which the weights of the key's records add up to its target.

    ``base``: ``k, s`` (double, neither null nor NaN), ``w`` (bigint, >= 0). ``targets``: ``k`` (unique), ``target`` (bigint, at
    most the key's total weight). Each round counts the weights of the open keys into ``bins`` bins, finds the bin that holds the target
    and goes on with the smallest and largest score in it, until it holds one value. The counts are combined on the map side:
    a round shuffles at most ``bins`` rows a key and task, and reads the two or three columns once.

    Result: ``k, target, cutoff, kept_w, kept_n`` (weight and records at or above the cutoff); keys without records are absent.
    """
    spark = base.sparkSession
    targets = cut(targets.filter(F.col("k").isNotNull() & (F.col("target") >= 0)))
    small = targets.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    hint = F.broadcast if small else (lambda d: d)
    base = base.withColumn("s", F.greatest(F.least(F.col("s"), F.lit(MAX)), F.lit(-MAX)))
    state = base.join(hint(targets), "k").groupBy("k", "target").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.sum("w").alias("bin_w"), F.count(F.lit(1)).alias("bin_n"))
    state = cut(state.withColumns({"above_w": F.lit(0).cast("bigint"), "above_n": F.lit(0).cast("bigint")}).select("k", "target", "lo", "hi", "bin_w", "bin_n", "above_w", "above_n"))
    while not state.filter("lo < hi").isEmpty():
        todo = state.filter("lo < hi").select("k", "target", "lo", "hi", "above_w", "above_n")
        hist = (
            base.join(hint(todo), "k").filter("s BETWEEN lo AND hi")
            .withColumn("b", _bin(F.col("s"), F.col("lo"), F.col("hi"), bins))
            .groupBy("k", "b").agg(F.sum("w").alias("bin_w"), F.count(F.lit(1)).alias("bin_n"), F.min("s").alias("b_lo"), F.max("s").alias("b_hi"), F.first("target").alias("target"), F.first("above_w").alias("above_w"), F.first("above_n").alias("above_n"))
        )
        before = W.partitionBy("k").orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1)  # at most `bins` rows a key
        hist = hist.withColumns({"up_w": F.col("above_w") + F.coalesce(F.sum("bin_w").over(before), F.lit(0)), "up_n": F.col("above_n") + F.coalesce(F.sum("bin_n").over(before), F.lit(0))})
        # The first bin from the top that reaches the target; b descends, so take the largest b.
        hit = hist.filter(F.col("up_w") + F.col("bin_w") >= F.col("target")).groupBy("k").agg(F.max_by(F.struct("target", "b_lo", "b_hi", "bin_w", "bin_n", "up_w", "up_n"), "b").alias("x"))
        hit = hit.select("k", "x.target", F.col("x.b_lo").alias("lo"), F.col("x.b_hi").alias("hi"), "x.bin_w", "x.bin_n", F.col("x.up_w").alias("above_w"), F.col("x.up_n").alias("above_n"))
        state = cut(state.filter("lo >= hi").unionByName(hit).coalesce(1) if small else state.filter("lo >= hi").unionByName(hit))
    return state.select("k", "target", F.col("lo").alias("cutoff"), (F.col("above_w") + F.col("bin_w")).alias("kept_w"), (F.col("above_n") + F.col("bin_n")).alias("kept_n"))


def cutoffs(records: DataFrame, targets: DataFrame, key: str = "source_dataset", score: str = "lie_score", pct: str = "keep_pct", bins: int = BINS) -> DataFrame:
    """Per target row: ``<key>, keep_pct, n_scored, cutoff, n_kept, kept_share``.

    The cutoff is the highest score at or above which at least ``pct`` percent of the key's scored records lie; null and NaN
    scores don't count. Ties at the cutoff are all kept. A key with no scored records, or with a null or larger than 100
    percentage, gets a null cutoff and keeps nothing; 0 percent and less keeps the records with the highest score. A null key
    never matches. Of several targets of a key the highest holds. Infinite scores count as the largest finite double.
    """
    base = records.select(F.col(key).alias("k"), F.col(score).cast("double").alias("s")).filter(F.col("k").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s")).withColumn("w", F.lit(1).cast("bigint"))
    wanted = targets.select(F.col(key).alias("k"), F.col(pct).cast("bigint").alias("pct")).filter("k IS NOT NULL").groupBy("k").agg(F.max("pct").alias("pct"))
    sizes = base.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    plan = cut(wanted.join(sizes, "k", "left"))
    ranks = plan.filter("n > 0 AND pct <= 100").select("k", F.expr("greatest(1, (n * pct + 99) div 100)").cast("bigint").alias("target"))
    found = refine(base, ranks, bins)
    out = plan.join(found, "k", "left")
    return out.select(
        F.col("k").alias(key), F.col("pct").alias(pct), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_scored"), "cutoff",
        F.coalesce("kept_n", F.lit(0)).cast("bigint").alias("n_kept"), F.when(F.col("n") > 0, F.round(F.coalesce("kept_n", F.lit(0)) / F.col("n"), 6)).alias("kept_share"),
    )


def keep(records: DataFrame, cut_table: DataFrame, key: str = "source_dataset", score: str = "lie_score") -> DataFrame:
    """The records at or above their key's cutoff, all their columns; no shuffle while the cutoffs are few."""
    c = cut_table.filter("cutoff IS NOT NULL").select(F.col(key).alias("__k"), F.col("cutoff").alias("__cutoff"))
    c = cut(c)
    c = F.broadcast(c) if c.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else c
    s = F.greatest(F.least(F.col(score).cast("double"), F.lit(MAX)), F.lit(-MAX))
    return records.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).join(c, (F.col(key) == F.col("__k")) & (s >= F.col("__cutoff"))).drop("__k", "__cutoff")
