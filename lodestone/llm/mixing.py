"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .cutoff import refine

#: Targets up to which their table is sent to all workers; beyond it the joins shuffle.
MAX_TARGETS = 10_000


def water_fill(weights: list[float], caps: list[int], total: int) -> list[int]:
    """Whole amounts that share ``total`` by ``weights``, none above its cap.

    Sources whose share exceeds their cap are clamped to it and the excess goes to the others in proportion to their weights,
    until all are feasible; if every source is clamped, less than the total is given. Computed in fractions: no rounding drift.
    """
    w = [Fraction(x).limit_denominator(10**9) if x and x > 0 else Fraction(0) for x in weights]
    given, open_ = [0] * len(w), {i for i in range(len(w)) if w[i] > 0 and caps[i] > 0}
    left = Fraction(total)
    while open_ and left > 0:
        all_w = sum(w[i] for i in open_)
        over = {i for i in open_ if left * w[i] / all_w >= caps[i]}
        if not over:
            for i in open_:
                given[i] = int(left * w[i] / all_w)
            break
        for i in over:
            given[i] = caps[i]
            left -= caps[i]
        open_ -= over
    return given


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> list[dict]:
    """Water-filled amounts per (mix, source). ``sizes``: ``source, available``. ``total``: size of each mix, by default all its sources' available tokens."""
    t = targets.select("mix", "source", F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("bigint").alias("reps")).filter("mix IS NOT NULL AND source IS NOT NULL")
    t = t.groupBy("mix", "source").agg(F.max("share").alias("share"), F.max("reps").alias("reps"))
    rows = t.join(sizes, "source", "left").collect()  # one row per target asked for
    out = []
    for mix in sorted({r.mix for r in rows}):
        own = sorted((r for r in rows if r.mix == mix), key=lambda r: r.source)
        have = [int(r.available or 0) for r in own]
        shares = [r.share if r.share and r.share == r.share else 0.0 for r in own]
        caps = [h * max(0, int(r.reps or 0)) for h, r in zip(have, own)]
        given = water_fill(shares, caps, sum(have) if total is None else total)
        for r, h, s, c, g in zip(own, have, shares, caps, given):
            out.append({"mix": mix, "source": r.source, "target_share": s, "max_repeats": int(r.reps or 0), "available": h, "planned": g, "whole": g // h if h else 0, "extra": g % h if h else 0, "clamped": bool(s > 0 and g >= c)})
    return out


PLAN = "mix string, source string, target_share double, max_repeats bigint, available bigint, planned bigint, whole bigint, extra bigint, clamped boolean"


def mix(docs: DataFrame, targets: DataFrame, seed: int = 17, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(usage, shares) of the mixes. ``docs``: ``doc_id, source, n_tokens``, one row per document.

    usage: ``mix, source, doc_id, times`` for each document used at least once: each is repeated as often as its source is used
    whole, and once more if its seeded hash lies in the fraction that the last, partial repetition takes. That fraction ends at the document
    with which the planned tokens are reached; it is found exactly by refining a histogram of the hash, without sorting a source.
    shares: ``mix, source, target_share, max_repeats, available_tokens, planned_tokens, used_tokens, actual_share, clamped`` for every target,
    also of sources without documents. No document is used more than ``max_repeats`` times. Null sources match no target, null or
    negative sizes count as 0, null or NaN shares and null repeats as 0; repeated targets take the highest values, repeated ids count per row.
    """
    spark = docs.sparkSession
    docs = cut(docs.select("doc_id", "source", F.greatest(F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)), F.lit(0)).alias("n_tokens")).filter("source IS NOT NULL"))
    sizes = docs.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    rows = plan(sizes, targets, total)
    few = F.broadcast if len(rows) <= MAX_TARGETS else lambda d: d
    p = few(spark.createDataFrame([tuple(r.values()) for r in rows], PLAN))
    # 53 bits of a seeded hash as a score in [0, 1); a mix has its own draw
    score = F.expr(f"shiftrightunsigned(xxhash64(doc_id, mix, {int(seed)}L), 11) / double(9007199254740992)")
    k = F.concat_ws("\x1f", "mix", "source")
    used = docs.join(p, "source").withColumns({"s": score, "k": k})
    ends = refine(used.filter("extra > 0 AND n_tokens > 0").select("k", "s", F.col("n_tokens").alias("w")), spark.createDataFrame([("\x1f".join((r["mix"], r["source"])), r["extra"]) for r in rows if r["extra"] > 0], "k string, target bigint"))
    ends = few(ends.select("k", "cutoff"))
    times = F.col("whole") + F.when((F.col("extra") > 0) & (F.col("s") >= F.col("cutoff")), 1).otherwise(0)
    usage = used.join(ends, "k", "left").withColumn("times", times).filter("times > 0")
    got = usage.groupBy("mix", "source").agg(F.sum(F.col("times") * F.col("n_tokens")).alias("used_tokens"))
    shares = p.join(got, ["mix", "source"], "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    sums = shares.groupBy("mix").agg(F.sum("used_tokens").alias("all_tokens"))
    shares = shares.join(sums, "mix").select(
        "mix", "source", "target_share", "max_repeats", F.col("available").alias("available_tokens"), F.col("planned").alias("planned_tokens"), "used_tokens",
        F.round(F.when(F.col("all_tokens") > 0, F.col("used_tokens") / F.col("all_tokens")).otherwise(0.0), 6).alias("actual_share"), "clamped",
    )
    return usage.select("mix", "source", "doc_id", F.col("times").cast("bigint").alias("times")), shares
