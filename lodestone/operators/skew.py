"""Per-key aggregation that stays balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """Keys holding more than ``share`` of all rows, with their counts (``key, key_rows``).

    At most ``1 / share`` keys can qualify, so the result is bounded whatever the input size.
    """
    counts = df.groupBy(F.col(key).alias("heavy_key")).agg(F.count(F.lit(1)).alias("key_rows"))
    total = df.agg(F.count(F.lit(1)).alias("n")).first().n
    return counts.filter(F.col("key_rows") > F.lit(share * total))


def salted_aggregate(df: DataFrame, key: str, score: str, distinct: str, salts: int = 64, share: float = 0.01) -> DataFrame:
    """Two-stage salted aggregation per ``key``.

    Stage 1 appends a salt to the rows of heavy keys (a seeded hash of the distinct column and of nothing else, so that a
    retried task draws the same salt) and aggregates per (key, salt, distinct value); stage 2 reduces those to one partial per
    (key, salt); stage 3 merges the partials by the original key. A distinct value falls into one salt, so the partial distinct
    counts add up exactly. Both first stages combine on the map side: a map task sends one row per (key, salt, value) it holds.

    Result: ``<key>, n_rows, n_scored, mean_score, n_distinct``. A null key is a group of its own; null and NaN scores count as
    rows but not for the mean (null if a key has no score); null distinct values aren't counted. An empty input gives no rows;
    other columns are ignored. Scores are added as decimals, so the mean doesn't depend on the order of rows.
    """
    work = df.select(F.col(key).alias("k"), F.col(score).cast("double").alias("s"), F.col(distinct).alias("d"))
    # Bounded: at most 1 / share keys. Collected as literals, so no join is needed to tell heavy rows.
    heavy = [r[0] for r in heavy_keys(work, "k", share).select("heavy_key").collect()]
    finite = F.col("s").isNotNull() & ~F.isnan("s")
    work = work.select("k", "d", _salt(F.col("k"), F.col("d"), heavy, salts).alias("salt"), F.when(finite, F.col("s").cast("decimal(28,12)")).alias("s"))
    stage1 = work.groupBy("k", "salt", "d").agg(F.count(F.lit(1)).alias("n"), F.count("s").alias("ns"), F.sum("s").alias("ss"))
    stage2 = stage1.groupBy("k", "salt").agg(F.sum("n").alias("n"), F.sum("ns").alias("ns"), F.sum("ss").alias("ss"), F.count("d").alias("nd"))
    merged = stage2.groupBy("k").agg(F.sum("n").alias("n_rows"), F.sum("ns").alias("n_scored"), F.sum("ss").alias("ss"), F.sum("nd").alias("n_distinct"))
    mean = F.when(F.col("n_scored") > 0, F.round(F.col("ss").cast("double") / F.col("n_scored"), 6))
    return merged.select(F.col("k").alias(key), "n_rows", "n_scored", mean.alias("mean_score"), "n_distinct")


def _salt(k: Column, d: Column, heavy: list, salts: int) -> Column:
    values = [v for v in heavy if v is not None]
    is_heavy = k.isin(values) if values else F.lit(False)
    if None in heavy:
        is_heavy = is_heavy | k.isNull()
    return F.when(F.coalesce(is_heavy, F.lit(False)), F.pmod(F.xxhash64(d, F.lit(7)), F.lit(salts))).otherwise(F.lit(0))
