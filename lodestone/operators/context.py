"""Preceding-context windows over rows in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut


def dense_index(df: DataFrame, order: str, out: str = "seq") -> DataFrame:
    """A dense 0-based index in the order of a unique column: range partitions, counted, offset by the counts before. No global window."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    local = df.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("__m", F.monotonically_increasing_id())
    local = cut(local.withColumns({"__p": F.shiftright("__m", 33), "__i": F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__m"))
    counts = local.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # as many rows as partitions
    return local.join(F.broadcast(counts.withColumn("__b", before).select("__p", "__b")), "__p").withColumn(out, F.col("__i") + F.col("__b")).drop("__p", "__i", "__b")


def preceding_context(rows: DataFrame, hits: DataFrame, seq: str = "seq", file: str = "source_file", speaker: str = "speaker", text: str = "sentence", size: int = 8) -> DataFrame:
    """``<seq>, context`` of each hit: up to ``size`` rows before it in dense order, of the same unbroken run of its file, rendered.

    Rows look forward: each is sent to the hits of the next ``size`` positions (equi-join on the position), so the work follows
    the hits and no file, however large, is sorted in one task. A ``[Name]`` header stands where the speaker changes (``unknown`` for
    none), the hit's own line is marked ``>>> ``.
    """
    h = hits.select(F.col(seq).alias("hit"), F.col(file).alias("hit_file"), F.explode(F.sequence(F.col(seq) - size, F.col(seq))).alias("pos"))
    r = rows.select(F.col(seq).alias("pos"), F.col(file).alias("f"), F.coalesce(F.when(F.trim(speaker) != "", F.trim(speaker)), F.lit("unknown")).alias("who"), F.trim(F.coalesce(text, F.lit(""))).alias("line"))
    got = h.join(r, "pos").groupBy("hit").agg(F.array_sort(F.collect_list(F.struct("pos", "f", "who", "line"))).alias("x"), F.first("hit_file").alias("hit_file"))
    # the run: rows after the last one of another file (nulls are a file of their own)
    breaks = F.filter("x", lambda e: ~e["f"].eqNullSafe(F.col("hit_file")))
    last = F.coalesce(F.array_max(F.transform(breaks, lambda e: e["pos"])), F.lit(-1))
    run = F.filter("x", lambda e: e["pos"] > last)
    start = F.struct(F.lit(None).cast("string").alias("who"), F.lit("").alias("out"))
    sep = lambda acc: F.when(acc["out"] == "", F.lit("")).otherwise(F.lit("\n"))

    def step(acc, e):
        head = F.when(acc["who"].eqNullSafe(e["who"]), F.lit("")).otherwise(F.concat(F.lit("["), e["who"], F.lit("]\n")))
        mark = F.when(e["pos"] == F.col("hit"), F.lit(">>> ")).otherwise(F.lit(""))
        return F.struct(e["who"].alias("who"), F.concat(acc["out"], sep(acc), head, mark, e["line"]).alias("out"))

    return got.select(F.col("hit").alias(seq), F.aggregate(run, start, step)["out"].alias("context"))
