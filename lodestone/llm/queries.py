"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boilerplate, cutoff, encoding, mixing, names, packing, residue, tokens


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _mentions(spark, d):
    acc, no = _read(spark, d, "accusations"), F.lit(False)
    one = _read(spark, d, "speakers").select("country", F.col("name_cleaned").alias("name"), no.alias("is_party"))
    two = acc.select("country", F.explode(F.array(F.struct(F.col("speaker").alias("name"), no.alias("is_party")), F.struct(F.col("target_text").alias("name"), (F.col("target_type") == "political_party").alias("is_party")))).alias("x")).select("country", "x.*")
    return one.unionByName(two)


def p1_found(spark, d):
    return names.variant_pairs(names.resolve(_mentions(spark, d)))


def p1_entities(spark, d):
    return names.resolve(_mentions(spark, d))


def _pages(spark, d):
    """Pages with the name of the speaker they were found for."""
    names = _read(spark, d, "speakers").groupBy("speaker_id").agg(F.max("name_cleaned").alias("name"))
    return _read(spark, d, "speaker_urls").select("id", "speaker_id", "url", "cleaned_text").join(names, "speaker_id", "left").drop("speaker_id")


def p2_found(spark, d):
    return residue.residue_pages(_pages(spark, d))


def _bodies(spark, d):
    """Pages without those of p2_found, and the labeller."""
    pages = _pages(spark, d)
    net = boilerplate.train(pages)
    return pages.join(residue.residue_pages(pages, net), "id", "left_anti"), net


def p3_found(spark, d):
    pages, net = _bodies(spark, d)
    return boilerplate.furniture_lines(pages, net).filter("furniture").select("id", "line_no").distinct()


def p3_bodies(spark, d):
    return boilerplate.main_bodies(*_bodies(spark, d))


def p4_found(spark, d):
    acc = _read(spark, d, "accusations").select("id", "source_dataset", "lie_score")
    return cutoff.keep(acc, cutoff.cutoffs(acc, _read(spark, d, "cutoff_targets"))).select("id")


def p4_cutoffs(spark, d):
    return cutoff.cutoffs(_read(spark, d, "accusations"), _read(spark, d, "cutoff_targets"))


def _sized(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", "source", "text")
    # copies: equal texts up to white space, by a 64-bit hash and the length; blank texts are copies of nothing
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    cluster = F.when(flat != "", F.xxhash64(flat, F.length(flat)))
    return docs.select("doc_id", "source", tokens.token_count(F.col("text")).alias("n_tokens"), cluster.alias("cluster"))


def p6_packing(spark, d):
    return packing.pack(_sized(spark, d), _read(spark, d, "containers"))


def p6_report(spark, d):
    c = _read(spark, d, "containers")
    return packing.report(packing.pack(_sized(spark, d), c), c)


def p7_mix(spark, d):
    return mixing.mix(_sized(spark, d).select("doc_id", "source", "n_tokens"), _read(spark, d, "mix_targets"))[0]


def p7_shares(spark, d):
    return mixing.mix(_sized(spark, d).select("doc_id", "source", "n_tokens"), _read(spark, d, "mix_targets"))[1]


def p8_found(spark, d):
    return encoding.restore(_read(spark, d, "documents")).select("doc_id").distinct()


def p8_restored(spark, d):
    return encoding.restore(_read(spark, d, "documents")).select("doc_id", "restored")


def queries():
    return {f.__name__: f for f in (p1_found, p1_entities, p2_found, p3_found, p3_bodies, p4_found, p4_cutoffs, p6_packing, p6_report, p7_mix, p7_shares, p8_found, p8_restored)}


_SCORED = """scored AS (SELECT a.id, a.source_dataset, a.lie_score, t.keep_pct,
  rank() OVER (PARTITION BY a.source_dataset ORDER BY a.lie_score DESC) r, count(*) OVER (PARTITION BY a.source_dataset) n,
  count(*) OVER (PARTITION BY a.source_dataset ORDER BY a.lie_score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) up
  FROM accusations a JOIN cutoff_targets t USING (source_dataset) WHERE a.lie_score IS NOT NULL AND NOT isnan(a.lie_score)),
cuts AS (SELECT source_dataset, max(lie_score) FILTER (up * 100 >= n * keep_pct) cutoff, max(n) n FROM scored GROUP BY 1)"""


def oracle_sql():
    return {
        "p4_found": f"WITH {_SCORED} SELECT s.id FROM scored s JOIN cuts USING (source_dataset) WHERE s.lie_score >= cutoff",
        "p4_cutoffs": f"""WITH {_SCORED}, kept AS (SELECT source_dataset, count(*) k FROM scored JOIN cuts USING (source_dataset) WHERE lie_score >= cutoff GROUP BY 1)
            SELECT source_dataset, CAST(keep_pct AS BIGINT) keep_pct, coalesce(n, 0) n_scored, cutoff, coalesce(k, 0) n_kept, round(coalesce(k, 0) / n, 6) kept_share
            FROM cutoff_targets LEFT JOIN cuts USING (source_dataset) LEFT JOIN kept USING (source_dataset)""",
    }
