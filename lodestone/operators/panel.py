"""Panels, dyads and choice sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEY = ["speaker_id", "country", "source_dataset", "year"]


def speaker_year_panel(exposure: DataFrame, made: DataFrame, received: DataFrame, keys: Sequence[str] = KEY, covariates: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Sentences, accusations made and received per key, zero-filled, with each covariate's first value in ``order`` that isn't null."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in covariates]
    e = exposure.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sentences"), *first)
    m = made.groupBy(*keys).agg(F.count(F.lit(1)).alias("acc_made"))
    r = received.groupBy(*keys).agg(F.count(F.lit(1)).alias("acc_received"))
    out = e.join(m, list(keys), "left").join(r, list(keys), "left")
    return out.withColumns({"acc_made": F.coalesce("acc_made", F.lit(0)), "acc_received": F.coalesce("acc_received", F.lit(0))})


def derive(panel: DataFrame) -> DataFrame:
    return panel.withColumns({"log_exposure": F.round(F.log("n_sentences"), 6), "country_year": F.concat_ws("_", "country", F.col("year").cast("string"))})


def party_year_panel(speakers: DataFrame, named: DataFrame, collective: DataFrame, mode: str = "bloc") -> DataFrame:
    """Party-year rows: sums over speakers, accusations naming the party, and a share of those against its side.

    ``speakers``: ``country, source_dataset, party, year, in_cabinet, is_pm, n_sentences, acc_made, acc_received`` per speaker-year. ``named``:
    ``country, source_dataset, party, year, n``. ``collective``: ``country, source_dataset, year, n_gov, n_opp``. Under ``bloc`` the
    government's count is split evenly among the parties in cabinet and the opposition's among the others (unknown counts as opposition);
    ``pm_only`` gives the government's to the prime minister's party; ``none`` gives nothing.
    """
    if mode not in ("bloc", "pm_only", "none"):
        raise ValueError(f"unknown credit mode {mode!r}")
    k, s = ["country", "source_dataset", "party", "year"], ["country", "source_dataset", "year"]
    p = speakers.filter("party IS NOT NULL").groupBy(*k).agg(
        F.sum("n_sentences").alias("n_sentences"), F.sum("acc_made").alias("acc_made"), F.sum("acc_received").alias("acc_individual"), F.count(F.lit(1)).alias("n_speakers"),
        F.max("in_cabinet").alias("in_cabinet"), F.max("is_pm").alias("is_pm"),
    )
    p = p.join(named.select(*k, F.col("n").alias("acc_named")), k, "left").join(collective.select(*s, "n_gov", "n_opp"), s, "left")
    p = p.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("acc_named", "n_gov", "n_opp")})
    side = W.partitionBy(*s)
    gov = F.coalesce(F.col("in_cabinet") == 1, F.lit(False))
    n_in, n_out = F.sum(gov.cast("int")).over(side), F.sum((~gov).cast("int")).over(side)
    zero = F.lit(0.0)
    if mode == "bloc":
        credit = F.when(gov, F.col("n_gov") / F.nullif(n_in, F.lit(0))).otherwise(F.col("n_opp") / F.nullif(n_out, F.lit(0)))
    elif mode == "pm_only":
        credit = F.when(F.col("is_pm") == 1, F.col("n_gov").cast("double")).otherwise(zero)
    else:
        credit = zero
    p = p.withColumn("acc_collective", F.coalesce(credit, zero))
    return p.withColumn("acc_received", F.bround(F.col("acc_individual") + F.col("acc_named") + F.col("acc_collective"), 0).cast("bigint")).withColumn("acc_collective", F.round("acc_collective", 6))


def dyads(events: DataFrame, a: str = "a", b: str = "b", by: Sequence[str] = ()) -> DataFrame:
    """Directed pairs of different actors with their counts."""
    return events.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))


def reciprocal(pairs: DataFrame, least: int = 2, a: str = "a", b: str = "b", by: Sequence[str] = ()) -> DataFrame:
    """Pairs whose reverse exists too, both at least ``least`` times; one row per unordered pair."""
    back = pairs.select(*by, F.col(a).alias(b), F.col(b).alias(a), F.col("n").alias("n_back"))
    return pairs.join(back, [*by, a, b]).filter((F.col(a) < F.col(b)) & (F.col("n") >= least) & (F.col("n_back") >= least))


def switch_gaps(events: DataFrame, at: str, tie: str, a: str = "a", b: str = "b", by: Sequence[str] = ()) -> DataFrame:
    """Days between consecutive events of an unordered pair whose direction differs."""
    e = events.filter(F.col(a) != F.col(b)).withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b)})
    w = W.partitionBy(*by, "lo", "hi").orderBy(at, tie)
    e = e.withColumns({"__pa": F.lag(a).over(w), "__pt": F.lag(at).over(w)})
    return e.filter(F.col("__pa").isNotNull() & (F.col("__pa") != F.col(a))).select(*by, "lo", "hi", F.col(tie), F.datediff(at, "__pt").cast("bigint").alias("gap_days"))


def draw(*parts: Column) -> Column:
    """A reproducible pseudo-random integer of whole-number columns that other engines can compute as well."""
    acc = F.lit(12345).cast("bigint")
    for p in parts:
        acc = (acc * 1103 + p.cast("bigint") * 7919 + 101) % 1000003
    return acc


def choice_sets(events: DataFrame, window_days: int = 30, controls: int = 10) -> DataFrame:
    """Of each event (``obs, a, b, at``; actors are whole numbers): the chosen target and up to ``controls`` drawn other targets of the
    same actor, each with ``provoked``: whether it accused the actor within ``window_days`` before (strictly before the day itself).
    Actors with one target have no set.

    An actor's targets are numbered in a drawn order; an event takes the ones that follow a place drawn for it, leaving its own out. So an event
    meets as many rows as it takes, however many targets its actor has.
    """
    t = events.select("a", F.col("b").alias("cand")).distinct()
    t = t.withColumn("pos", F.row_number().over(W.partitionBy("a").orderBy(draw(F.col("a"), F.col("cand")), "cand")) - 1)  # distinct targets, not events
    k = t.groupBy("a").agg(F.count(F.lit(1)).cast("int").alias("k")).filter("k >= 2")
    e = events.join(k, "a").join(t.select("a", F.col("cand").alias("b"), F.col("pos").alias("own")), ["a", "b"])
    begin = F.pmod(draw(F.col("obs")), F.col("k") - 1)
    step = F.explode(F.sequence(F.lit(0), F.least(F.lit(controls), F.col("k") - 1) - 1))
    rest = e.withColumn("j", step).withColumn("o", F.pmod(begin + F.col("j"), F.col("k") - 1)).withColumn("pos", (F.col("o") + (F.col("o") >= F.col("own")).cast("int")).cast("int"))
    rest = rest.join(t, ["a", "pos"]).select("obs", "a", "b", "at", "cand", F.lit(0).alias("chosen"))
    sets = e.select("obs", "a", "b", "at", F.col("b").alias("cand"), F.lit(1).alias("chosen")).unionByName(rest)
    past = events.select(F.col("a").alias("cand"), F.col("b").alias("a"), F.col("at").alias("then"))
    hit = sets.join(past, ["cand", "a"]).filter((F.col("then") < F.col("at")) & (F.col("then") >= F.date_sub("at", window_days))).select("obs", "cand").distinct().withColumn("provoked", F.lit(1))
    return sets.join(hit, ["obs", "cand"], "left").select("obs", "a", "cand", "chosen", F.coalesce("provoked", F.lit(0)).alias("provoked"))


def informative(sets: DataFrame) -> DataFrame:
    w = W.partitionBy("obs")
    return sets.withColumns({"__lo": F.min("provoked").over(w), "__hi": F.max("provoked").over(w)}).filter("__lo <> __hi").drop("__lo", "__hi")
