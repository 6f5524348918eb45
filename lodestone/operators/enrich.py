"""Covariates of a speaker at a date: distinct keys first, interval joins, one wide row per key, joined back null-safely."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .asof import asof_join, running_history, timeline_pick, years_since_active

A = "gender string, birth_year int, birth_place string, confidence string"
B = "parties array<struct<partyfacts_id: bigint, partyfacts_name: string, party_name_raw: string, start_year: int, end_year: int>>, n_parties int, confidence string"
C = "education array<struct<isced_level: int, field: string, institution: string>>, highest_isced int, confidence string"
D = "sectors array<string>, confidence string"


def annotations(ann: DataFrame) -> DataFrame:
    """One row per speaker: the four groups' fields, validated; null where a group is missing, failed or no JSON."""
    ok = ann.filter("status = 'success' AND annotation_json IS NOT NULL")
    a, b, c, d = (F.max(F.when(F.col("group_name") == g, F.from_json("annotation_json", s))) if g in "A" else F.first(F.when(F.col("group_name") == g, F.from_json("annotation_json", s)), ignorenulls=True) for g, s in zip("ABCD", (A, B, C, D)))
    w = ok.groupBy("speaker_id").agg(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    level = F.array_max(F.transform("c.education", lambda e: F.when(e["isced_level"].between(5, 8), e["isced_level"])))
    return w.select("speaker_id", F.lower("a.gender").alias("gender"), "a.birth_year", "a.birth_place", level.alias("highest_isced"), F.array_join(T.valid_codes(F.col("d.sectors"), 1, 8).cast("array<string>"), ",").alias("career_sectors"), F.col("b.parties").alias("parties"))


def timelines(ann: DataFrame) -> DataFrame:
    """``speaker_id, pos, start_year, end_year, party`` (a struct of ``id`` and ``name``; entries without id are kept)."""
    x = annotations(ann).select("speaker_id", F.posexplode("parties").alias("pos", "p"))
    return x.select("speaker_id", "pos", "p.start_year", "p.end_year", F.struct(F.col("p.partyfacts_id").alias("id"), F.col("p.partyfacts_name").alias("name")).alias("party"))


PERSON = ("gender", "birth_year", "birth_place", "highest_isced", "career_sectors", "age", "partyfacts_id", "party_name")


def covariates_by_id(keys: DataFrame, ann: DataFrame) -> DataFrame:
    """Of each distinct (speaker_id, date): PERSON fields at that date and whether there is any timeline (``has_parties``). The party is the timeline's entry at the year, if that has an id; without a year there is none."""
    k = keys.select("speaker_id", "date").distinct().withColumn("year", T.year_of(F.col("date")))
    person = annotations(ann)
    k = k.join(person.withColumn("has_parties", F.coalesce(F.size("parties") > 0, F.lit(False))).drop("parties"), "speaker_id", "left")
    k = timeline_pick(k, timelines(ann), "speaker_id", "year")
    known = F.col("year").isNotNull() & F.col("party.id").isNotNull()
    return k.select(
        "speaker_id", "date", "gender", "birth_year", "birth_place", "highest_isced", "career_sectors", F.when(F.col("birth_year") > 0, F.col("year") - F.col("birth_year")).alias("age"),
        F.when(known, F.col("party.id")).alias("partyfacts_id"), F.when(known, F.col("party.name")).alias("party_name"), F.coalesce("has_parties", F.lit(False)).alias("has_parties"),
    )


def speaker_ids(speakers: DataFrame) -> DataFrame:
    """``speaker, country, source_dataset, speaker_id``, the best supported one of equal names."""
    dim = speakers.select(F.col("name_cleaned").alias("speaker"), "country", "source_dataset", "speaker_id", "n_sentences")
    return dim.groupBy("speaker", "country", "source_dataset").agg(F.max_by("speaker_id", F.struct(F.coalesce("n_sentences", F.lit(0)), "speaker_id")).alias("speaker_id"))


def covariates(keys: DataFrame, speakers: DataFrame, ann: DataFrame) -> DataFrame:
    """Of each distinct (speaker, country, source_dataset, date): ``match`` (no_speaker, no_party, resolved), the speaker's id and PERSON fields."""
    k = keys.select("speaker", "country", "source_dataset", "date").distinct().join(speaker_ids(speakers), ["speaker", "country", "source_dataset"], "left")
    c = covariates_by_id(k.filter("speaker_id IS NOT NULL"), ann).withColumnsRenamed({"speaker_id": "__s", "date": "__d"})
    k = k.join(c, (F.col("speaker_id") == F.col("__s")) & F.col("date").eqNullSafe(F.col("__d")), "left").drop("__s", "__d")
    return k.withColumn("match", F.when(F.col("speaker_id").isNull(), "no_speaker").when(F.col("partyfacts_id").isNull(), "no_party").otherwise("resolved"))


def party_status(dim: DataFrame) -> DataFrame:
    """The stricter status of the party table: a speaker without any timeline counts as ``no_speaker``, one without a date or a party with id as ``no_party``."""
    return dim.withColumn("status", F.when(F.col("speaker_id").isNull() | ~F.coalesce("has_parties", F.lit(False)), "no_speaker").when(F.col("partyfacts_id").isNull(), "no_party").otherwise("resolved"))


def join_back(facts: DataFrame, dim: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """Null-safe left join on ``keys``; the dimension's other columns get the prefix."""
    d = dim.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(prefix + c) for c in dim.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return facts.join(d, cond, "left").drop(*[f"__{k}" for k in keys])


def party_measures(keys: DataFrame, elections: DataFrame, cabinets: DataFrame, scores: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Of each (party, date): vote shares as of the date, government record, and expert scores.

    ``elections``: ``party, day, vote_share`` (NaN counts as missing). ``cabinets``: ``country, cabinet, day, party, in_cabinet, is_pm``, one row per party in
    a cabinet's parliament. ``scores``: ``party, day`` and the measures; a date before the first record takes the first. Years since government run
    from the start of the cabinet after the last one the party was in; null if it is in or never was.
    """
    k = keys.select("party", "date").distinct()
    e = elections.filter("vote_share IS NOT NULL AND NOT isnan(vote_share)")
    h = running_history(e, "party", ["day"], "vote_share").select("party", "day", *[F.col(c).alias(n) for c, n in (("last", "vote_share_last"), ("avg_all", "vote_share_avg"), ("avg_3", "vote_share_avg_last3"), ("delta", "vote_share_delta"))])
    k = asof_join(k, h, ["party"], "date", "day", h.columns[2:])
    starts = cabinets.select("country", "day").distinct()
    members = cabinets.filter("party IS NOT NULL").select("country", "party").distinct()
    grid = members.join(starts, "country").join(cabinets.select("country", "day", "party", "in_cabinet", "is_pm"), ["country", "day", "party"], "left")
    grid = grid.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("in_cabinet", "is_pm")})
    g = years_since_active(grid, "country", "party", "day", "in_cabinet").select("party", "day", "in_cabinet", "is_pm", "exited")
    k = asof_join(k, g, ["party"], "date", "day", ["in_cabinet", "is_pm", "exited"])
    k = k.withColumn("years_since_government", F.when(F.col("in_cabinet") == 1, 0.0).otherwise(F.round(F.datediff("date", "exited") / 365.25, 2))).drop("exited")
    return asof_join(k, scores, ["party"], "date", "day", list(measures), or_first=True)
