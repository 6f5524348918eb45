"""Counts, rates and coverage: aggregate each side first, then join the small results and fill with zeros."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import per_10k
from ..session import cut


def rate_table(exposure: DataFrame, events: DataFrame, keys: Sequence[str], n: str = "n_sentences", k: str = "n_accusations", rate: str = "rate_10k") -> DataFrame:
    """Rows per key of both tables and their rate per 10,000; keys without events get 0."""
    e = exposure.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    a = events.groupBy(*keys).agg(F.count(F.lit(1)).alias(k))
    return e.join(a, list(keys), "left").withColumn(k, F.coalesce(k, F.lit(0))).withColumn(rate, per_10k(F.col(k), F.col(n)))


def labelled_rates(fact: DataFrame, keys: Sequence[str], label: Column, n: str = "n_sentences", k: str = "n_accusations", rate: str = "rate_10k") -> DataFrame:
    """The same from one table with a label: one pass, no join."""
    return fact.groupBy(*keys).agg(F.count(F.lit(1)).alias(n), F.count_if(label).alias(k)).withColumn(rate, per_10k(F.col(k), F.col(n)))


def rolling_ratio(df: DataFrame, order: str, num: str, den: str, before: int = 6, after: int = 5, partition: Sequence[str] = ()) -> DataFrame:
    """Ratio of rolled sums over a frame that must be full, per 10,000. Runs on aggregates (months), never on facts."""
    w = W.partitionBy(*partition).orderBy(order).rowsBetween(-before, after)
    full = F.count(F.lit(1)).over(w) == before + after + 1
    return df.withColumn("smooth_10k", F.when(full, per_10k(F.sum(num).over(w), F.sum(den).over(w))))


def with_share(df: DataFrame, value: str, out: str = "pct", digits: int = 1) -> DataFrame:
    total = df.agg(F.sum(value).alias("__total"))
    return df.join(F.broadcast(total)).withColumn(out, F.round(F.col(value) * 100.0 / F.col("__total"), digits)).drop("__total")  # one row


def prune_thin(df: DataFrame, columns: Sequence[str], least: int) -> DataFrame:
    """Drops the levels with fewer than ``least`` rows, column by column, counting anew after each."""
    for c in columns:
        big = df.groupBy(c).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least).select(c)
        df = df.join(big, c, "left_semi")
    return df


def keep_with_distinct(df: DataFrame, key: str, of: str, least: int) -> DataFrame:
    ok = df.groupBy(key).agg(F.count_distinct(of).alias("__n")).filter(F.col("__n") >= least)
    return df.join(ok, key, "left_semi")


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, non_null, pct`` of each column in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("non_null"), F.round(F.col(c) * 100.0 / F.col("__n"), 1).alias("pct")) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> DataFrame:
    """One row ``q`` with the exact linear quantiles; null and NaN don't count, nulls without any value.

    Values are counted, the counts sorted over range partitions and summed up from the partitions before: no task holds all values.
    """
    v = F.col(column).cast("double")
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = df.select(v.alias("v")).filter("v IS NOT NULL AND NOT isnan(v)").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts.repartitionByRange(n, "v").withColumn("p", F.spark_partition_id()))
    parts = counts.groupBy("p").agg(F.sum("n").alias("k"))  # as many rows as partitions
    before = parts.select("p", F.coalesce(F.sum("k").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("k").over(W.partitionBy(F.lit(1))).alias("total"))
    up = counts.join(F.broadcast(before), "p").withColumn("up", F.col("before") + F.sum("n").over(W.partitionBy("p").orderBy("v")))
    at = lambda rank: F.min(F.when(F.col("up") > rank, F.col("v")))
    place = [(F.col("total") - 1) * F.lit(float(p)) for p in probs]
    got = up.agg(F.max("total").alias("total"), *[at(F.floor(h)).alias(f"a{i}") for i, h in enumerate(place)], *[at(F.ceil(h)).alias(f"b{i}") for i, h in enumerate(place)])
    return got.select(F.array(*[F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (h - F.floor(h)) for i, h in enumerate(place)]).alias("q"))


def describe(df: DataFrame, column: str, probs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Exact summary statistics with linear quantiles."""
    c = F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double"))
    one = df.agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    qs = [F.round(F.col("q")[i], 6).alias(f"p{round(p * 100):02d}") for i, p in enumerate(probs)]
    return one.join(F.broadcast(quantiles(df, column, probs))).select("n", "mean", "std", "min", "max", *qs)  # one row each


def ecdf(df: DataFrame, group: str, column: str, out: str = "ecdf") -> DataFrame:
    """Each row with the share of its group's rows at or below its value: running sums over the distinct values, joined back."""
    counts = df.groupBy(group, column).agg(F.count(F.lit(1)).alias("__n"))
    w = W.partitionBy(group)
    share = counts.select(F.col(group).alias("__g"), F.col(column).alias("__v"), (F.sum("__n").over(w.orderBy(column)) / F.sum("__n").over(w)).alias(out))
    return df.join(share, F.col(group).eqNullSafe(F.col("__g")) & F.col(column).eqNullSafe(F.col("__v"))).drop("__g", "__v")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows drawn without repetition by a seeded draw on a whole-number key: the same for any partitioning."""
    mixed = (F.col(key).cast("bigint") % 1000003) * 7919 + F.lit(int(seed) * 1103 + 101)
    return df.orderBy(mixed % 1000003, F.col(key)).limit(n)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a, b, r`` of every pair, pairwise complete, in one pass."""
    clean = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = clean.agg(*[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"`{a}~{b}`"), 6).alias("r")) for a, b in pairs])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def qcut(df: DataFrame, column: str, out: str = "bin", n: int = 4) -> DataFrame:
    """Right-closed quantile bins from linear quantiles, the lowest value included; null stays null."""
    edges = quantiles(df, column, [i / n for i in range(1, n)]).withColumnRenamed("q", "__e")
    expr = F.lit(n - 1)
    for i in reversed(range(n - 1)):
        expr = F.when(F.col(column) <= F.col("__e")[i], F.lit(i)).otherwise(expr)
    return df.join(F.broadcast(edges)).withColumn(out, F.when(F.col(column).isNotNull(), expr)).drop("__e")  # one row


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a total order, by a heap per task."""
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, group: Sequence[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("__r") <= n).drop("__r")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """``bin, n`` of equal-width bins, the last one closed; values outside and NaN don't count."""
    c = F.col(column)
    inside = df.filter(c.between(low, high) & ~F.isnan(c.cast("double")))
    return inside.groupBy(F.least(F.floor((c - low) / F.lit((high - low) / bins)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
