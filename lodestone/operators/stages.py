"""Pipeline state kept in tables: upserts, roll-ups, readiness, retries; every write is a new version of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

STAGES = ("query", "fetch", "url_synth", "cv_synth", "annotate_a", "annotate_b", "annotate_c", "annotate_d")


def keep_first(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def insert_ignore(target: DataFrame, new: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """``target`` and the first of each new key that it doesn't have."""
    return target.unionByName(keep_first(new, keys, *order).join(target, list(keys), "left_anti"))


def upsert(target: DataFrame, delta: DataFrame, keys: Sequence[str], version: str, created: str | None = None) -> DataFrame:
    """The latest version per key; ``created`` keeps its earliest value."""
    both = target.unionByName(delta)
    w = W.partitionBy(*keys)
    if created:
        both = both.withColumn(created, F.min(created).over(w))
    return both.withColumn("__r", F.row_number().over(w.orderBy(F.desc(version)))).filter("__r = 1").drop("__r")


def update_by_id(base: DataFrame, delta: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    d = delta.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    return base.join(d, key, "left").withColumns({c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).drop("__hit", *[f"__{c}" for c in columns])


def status_counts(speakers: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """``stage, status, n, pct`` (whole percent of the stage, cut off) in one pass over all stages."""
    pairs = F.array(*[F.struct(F.lit(s).alias("stage"), F.coalesce(f"{s}_status", F.lit("none")).alias("status")) for s in stages])
    g = speakers.select(F.explode(pairs).alias("x")).groupBy("x.stage", "x.status").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.floor(F.col("n") * 100 / F.sum("n").over(W.partitionBy("stage"))).cast("bigint"))


def roll_up(children: DataFrame, parents: DataFrame, key: str, status: str, empty: str = "failed") -> DataFrame:
    """Status of a parent from its children: any success, else any pending, else any failed; ``empty`` without children."""
    c = children.groupBy(key).agg(*[F.count_if(F.col(status) == s).alias(s) for s in ("success", "pending", "failed")], F.count(F.lit(1)).alias("n_children"))
    out = F.when(F.col("success") > 0, "success").when(F.col("pending") > 0, "pending").when(F.col("failed") > 0, "failed").otherwise(empty)
    return parents.select(key).join(c, key, "left").select(key, out.alias("status"), F.coalesce("success", F.lit(0)).alias("n_success"), F.coalesce("failed", F.lit(0)).alias("n_failed"), F.coalesce("n_children", F.lit(0)).alias("n_children"))


def readiness(speakers: DataFrame) -> DataFrame:
    """``stage, ready``: rows pending in a stage whose predecessor succeeded (or, before cv_synth, was skipped), all stages in one pass."""
    before = {"query": None, "fetch": "query", "url_synth": "fetch", "cv_synth": "url_synth", **{f"annotate_{g}": "cv_synth" for g in "abcd"}}
    pend = lambda s: F.coalesce(F.col(f"{s}_status") == "pending", F.lit(False))
    ready = {s: pend(s) & (F.coalesce(F.col(f"{p}_status").isin("success", *(["skipped"] if s == "cv_synth" else [])), F.lit(False)) if p else F.lit(True)) for s, p in before.items()}
    one = speakers.agg(*[F.count_if(c).alias(s) for s, c in ready.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("ready")) for s in before])).alias("x")).select("x.*")


def next_stage(ready: DataFrame, stages: Sequence[str] = STAGES[2:]) -> DataFrame:
    """The stage with most work, the earlier of equals."""
    order = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    return ready.filter(F.col("stage").isin(*stages) & (F.col("ready") > 0)).orderBy(F.desc("ready"), order).limit(1)


def activate_retries(speakers: DataFrame, batch: DataFrame, stage: str) -> DataFrame:
    """Sets the stage back to pending for the ids in a batch's JSON list."""
    ids = batch.select(F.explode(F.from_json("speaker_ids", "array<string>")).alias("speaker_id")).distinct().withColumn("__hit", F.lit(True))
    c = f"{stage}_status"
    return speakers.join(ids, "speaker_id", "left").withColumn(c, F.when(F.col("__hit"), "pending").otherwise(F.col(c))).drop("__hit")
