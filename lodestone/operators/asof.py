"""As-of joins and histories: a history becomes intervals once (``lead``), cut at the years they span; a lookup is then an equi-join on keys and year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def intervals(history: DataFrame, keys: Sequence[str], start: str, tie: Sequence[Column] = (), open_first: bool = False) -> DataFrame:
    """One row per (keys, start), the last by ``tie``, with ``valid_from`` and ``valid_to`` (null: still valid).

    ``open_first`` opens the first interval to the past, so that earlier dates find the first record.
    """
    w = W.partitionBy(*keys, start).orderBy(*[t.desc() for t in tie] or [F.lit(1)])
    h = history.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    k = W.partitionBy(*keys).orderBy(start)
    h = h.withColumns({"valid_to": F.lead(start).over(k), "__first": F.row_number().over(k)})
    begin = F.when(F.col("__first") == 1, F.lit(None)).otherwise(F.col(start)) if open_first else F.col(start)
    return h.withColumn("valid_from", begin).drop("__first")


def _year(df: DataFrame, column: str) -> Column:
    """The year of a date, timestamp or ISO text; of a number, a step of five."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.year(column)
    return F.substring(column, 1, 4).try_cast("int") if kind == "string" else F.floor(F.col(column) / 5).cast("int")


def asof_join(facts: DataFrame, history: DataFrame, keys: Sequence[str], at: str, start: str, values: Sequence[str], tie: Sequence[Column] = (), or_first: bool = False) -> DataFrame:
    """Each fact with the latest record of its keys that began at or before ``at`` (or, with ``or_first``, the first one if none did).

    Facts meet only the records in force in their year, not the whole history of their keys, and a hot key is spread over its years.
    """
    ends = facts.agg(F.min(_year(facts, at)).alias("__lo"), F.max(_year(facts, at)).alias("__hi"))
    h = intervals(history, keys, start, tie, or_first).join(F.broadcast(ends))  # one row
    # open ends reach as far as the facts do; an interval without a year among the facts' is left out
    first = F.greatest(F.when(F.col("valid_from").isNotNull(), _year(h, start)), F.col("__lo"))
    last = F.least(_year(h, "valid_to"), F.col("__hi"))
    whole = F.col("valid_from").isNull() & F.col("valid_to").isNull()
    years = F.when(first <= last, F.sequence(first, last)).when(whole, F.array("__lo"))
    h = h.withColumn("__year", F.explode(years)).select(*[F.col(k).alias(f"__{k}") for k in keys], "__year", "valid_from", "valid_to", *values)
    f = facts.join(F.broadcast(ends)).withColumn("__at", F.coalesce(_year(facts, at), "__lo")).drop("__lo", "__hi")
    cond = F.col("__at") == F.col("__year")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__{k}"))
    cond = cond & (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col(at))) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))
    return f.join(h, cond, "left").drop("valid_from", "valid_to", "__at", "__year", *[f"__{k}" for k in keys])


def running_history(history: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Per record: last value, mean of all and of the last three so far, and change on the one before."""
    w = W.partitionBy(key).orderBy(*order)
    v = F.col(value)
    return history.withColumns(
        {
            "last": v,
            "avg_all": F.avg(v).over(w.rowsBetween(W.unboundedPreceding, 0)),
            "avg_3": F.avg(v).over(w.rowsBetween(-2, 0)),
            "delta": v - F.lag(v).over(w),
        }
    )


def years_since_active(grid: DataFrame, unit: str, member: str, start: str, active: str) -> DataFrame:
    """On a grid of (unit, start, member): whether active, and the start of the period after the last active one (``exited``)."""
    w = W.partitionBy(unit, member).orderBy(start)
    g = grid.withColumn("__next", F.lead(start).over(w))
    seen = F.last(F.when(F.col(active) == 1, F.col("__next")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    return g.withColumn("exited", F.when(F.col(active) == 0, seen)).drop("__next")


def timeline_pick(facts: DataFrame, timeline: DataFrame, key: str, at: str) -> DataFrame:
    """The entry of a person's timeline (``pos, start_year, end_year, party``) that covers ``at``: of several the latest begun, first
    listed among equals; if none covers it, the first listed. Facts without a timeline keep null; equal facts stay as many.

    A person's entries become one array, so facts are joined once and neither multiplied nor grouped again."""
    t = timeline.groupBy(F.col(key).alias("__k")).agg(F.collect_list(F.struct("pos", "start_year", "end_year", "party")).alias("__t"))  # a person's entries
    j = facts.join(t, F.col(key) == F.col("__k"), "left")
    covers = lambda e: F.coalesce((e["start_year"].isNull() | (e["start_year"] <= F.col(at))) & (e["end_year"].isNull() | (e["end_year"] >= F.col(at))), F.lit(False))
    inside = F.array_max(F.transform(F.filter("__t", covers), lambda e: F.struct(F.coalesce(e["start_year"], F.lit(-9999)).alias("y"), (-e["pos"]).alias("p"), e["party"].alias("party"))))
    listed = F.array_min(F.transform("__t", lambda e: F.struct(e["pos"].alias("p"), e["party"].alias("party"))))
    return j.withColumns({"party": F.coalesce(F.when(inside.isNotNull(), inside["party"]), F.when(inside.isNull(), listed["party"])), "covered": inside.isNotNull()}).drop("__k", "__t")
