"""Per-key results from work spread evenly (problem 5), with the flagship rate query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.skew import salted_aggregate


def p5_by_country(spark, d):
    return salted_aggregate(spark.read.parquet(f"{d}/accusations.parquet"), "country", "lie_score", "speaker")


def p5_by_source(spark, d):
    return salted_aggregate(spark.read.parquet(f"{d}/accusations.parquet"), "source_dataset", "lie_score", "speaker")


def _sql(key: str) -> str:
    ok = "lie_score IS NOT NULL AND NOT isnan(lie_score)"
    return f"""SELECT {key}, count(*) n_rows, count(*) FILTER ({ok}) n_scored,
        round(CAST(sum(CAST(CASE WHEN {ok} THEN lie_score END AS DECIMAL(28, 12))) AS DOUBLE) / nullif(count(*) FILTER ({ok}), 0), 6) mean_score,
        count(DISTINCT speaker) n_distinct FROM accusations GROUP BY {key}"""


QUERIES = {"p5_by_country": p5_by_country, "p5_by_source": p5_by_source}
ORACLES = {"p5_by_country": _sql("country"), "p5_by_source": _sql("source_dataset")}
