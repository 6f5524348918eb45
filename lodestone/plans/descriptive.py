"""Rates, summaries, distributions and samples."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..operators import rates as R
from .tables import SENT, YEAR, dated, read, register, sentences

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)
EXCLUDED = ("IS", "BA", "GR", "LV", "EE", "RS")
RATE = "round(k * 10000.0 / n, 6)"


@query(f"""WITH {SENT}, e AS (SELECT country, year, count(*) n FROM sent GROUP BY 1, 2), a AS (SELECT country, year, count(*) k FROM sent WHERE label GROUP BY 1, 2)
SELECT country, year, n n_sentences, coalesce(k, 0) n_accusations, round(coalesce(k, 0) * 10000.0 / n, 6) rate_10k FROM e LEFT JOIN a USING (country, year)""")
def country_year_rate(spark, d):
    s = sentences(spark, d)
    return R.labelled_rates(s, ["country", "year"], F.col("label"))


@query(f"""WITH {SENT}, m AS (SELECT ym, count(*) n, CAST(sum(CASE WHEN label THEN 1 ELSE 0 END) AS BIGINT) k FROM sent GROUP BY 1)
SELECT ym, n n_sentences, k n_accusations, {RATE} rate_10k, CASE WHEN count(*) OVER w = 12 THEN round(sum(k) OVER w * 10000.0 / sum(n) OVER w, 6) END smooth_10k FROM m
WINDOW w AS (ORDER BY ym ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)""")
def month_rate_smooth(spark, d):
    return R.rolling_ratio(R.labelled_rates(sentences(spark, d), ["ym"], F.col("label")), "ym", "n_accusations", "n_sentences")


@query(f"""WITH {SENT} SELECT source_dataset, country, year, count(*) n_sentences, count(*) FILTER (label) n_accusations, round(count(*) FILTER (label) * 10000.0 / count(*), 6) rate_10k
FROM sent WHERE year BETWEEN 1996 AND 2000 GROUP BY ALL HAVING count(*) >= 50""")
def source_country_year(spark, d):
    s = sentences(spark, d).filter(F.col("year").between(1996, 2000))
    return R.labelled_rates(s, ["source_dataset", "country", "year"], F.col("label")).filter("n_sentences >= 50")


@query(f"""WITH {SENT} SELECT country, count(*) n, count(*) FILTER (score > 0.02) over_02, count(*) FILTER (score > 0.05) over_05, count(*) FILTER (score > 0.08) over_08,
count(*) FILTER (label AND score > 0.05) labelled_05 FROM sent GROUP BY 1""")
def threshold_rates(spark, d):
    s = F.col("score")
    return sentences(spark, d).groupBy("country").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(s > t).alias(f"over_{int(t * 100):02d}") for t in (0.02, 0.05, 0.08)], F.count_if(F.col("label") & (s > 0.05)).alias("labelled_05"))


@query("""SELECT count(*) n, count(DISTINCT speaker) speakers, count(DISTINCT country) countries, count(DISTINCT source_dataset) datasets, count(DISTINCT CASE WHEN target_type = 'person' THEN target_text END) person_targets,
min(CASE WHEN length(date) = 10 THEN date END) first_date, max(CASE WHEN length(date) = 10 THEN date END) last_date FROM accusations""")
def global_summary(spark, d):
    a = read(spark, d, "accusations", "speaker", "country", "source_dataset", "target_type", "target_text", "date")
    full = F.when(F.length("date") == 10, F.col("date"))
    return a.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(x) for c, x in (("speaker", "speakers"), ("country", "countries"), ("source_dataset", "datasets"))], F.count_distinct(F.when(F.col("target_type") == "person", F.col("target_text"))).alias("person_targets"), F.min(full).alias("first_date"), F.max(full).alias("last_date"))


@query(f"""WITH {SENT}, y AS (SELECT country, year, count(*) n FROM sent GROUP BY 1, 2)
SELECT country, count(*) n_years, count(*) FILTER (n >= 100) usable_years, min(year) first_year, max(year) last_year, CAST(sum(n) AS BIGINT) n_sentences,
CASE WHEN count(*) FILTER (n >= 100) >= 7 THEN 'keep' WHEN count(*) FILTER (n >= 100) >= 3 THEN 'thin' ELSE 'drop' END verdict FROM y GROUP BY 1""")
def country_verdict(spark, d):
    y = sentences(spark, d).groupBy("country", "year").agg(F.count(F.lit(1)).alias("n"))
    usable = F.count_if(F.col("n") >= 100)
    g = y.groupBy("country").agg(F.count(F.lit(1)).alias("n_years"), usable.alias("usable_years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum("n").alias("n_sentences"))
    return g.withColumn("verdict", F.when(F.col("usable_years") >= 7, "keep").when(F.col("usable_years") >= 3, "thin").otherwise("drop"))


_COV = ("lang", "source", "country", "speaker", "doc_date", "doc_kind")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) non_null, round(count({c}) * 100.0 / count(*), 1) pct FROM documents" for c in _COV))
def coverage_by_column(spark, d):
    return R.coverage(read(spark, d, "documents", *_COV), _COV)


@query("SELECT target_type, count(*) n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) pct FROM accusations WHERE target_type IS NOT NULL GROUP BY 1")
def share_of_total(spark, d):
    g = read(spark, d, "accusations", "target_type").filter("target_type IS NOT NULL").groupBy("target_type").agg(F.count(F.lit(1)).alias("n"))
    return R.with_share(g, "n")


@query("SELECT country, source, n FROM (SELECT country, source, count(*) n, count(*) OVER (PARTITION BY country) k FROM documents WHERE country IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2) WHERE k > 1")
def multi_source_countries(spark, d):
    g = read(spark, d, "documents", "country", "source").na.drop().groupBy("country", "source").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("k", F.count(F.lit(1)).over(W.partitionBy("country"))).filter("k > 1").drop("k")


@query("""SELECT count(x) n, round(avg(x), 6) mean, round(stddev_samp(x), 6) std, min(x) min, max(x) max, round(quantile_cont(x, 0.05), 6) p05, round(quantile_cont(x, 0.25), 6) p25,
round(quantile_cont(x, 0.5), 6) p50, round(quantile_cont(x, 0.75), 6) p75, round(quantile_cont(x, 0.95), 6) p95 FROM (SELECT CASE WHEN NOT isnan(lie_score) THEN lie_score END x FROM accusations)""")
def describe_scores(spark, d):
    return R.describe(read(spark, d, "accusations", "lie_score"), "lie_score")


_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{a}' a, '{b}' b, round(corr({a}, {b}), 6) r FROM lineitem" for i, a in enumerate(_CORR) for b in _CORR[i:]))
def corr_matrix(spark, d):
    return R.correlations(read(spark, d, "lineitem", *_CORR), _CORR)


@query(f"""WITH a AS (SELECT country, {YEAR} y, CASE WHEN NOT isnan(lie_score) THEN lie_score END s FROM accusations)
SELECT country, count(*) FILTER (y // 10 = 199) "1990s", count(*) FILTER (y // 10 = 200) "2000s", count(*) FILTER (y // 10 = 201) "2010s", count(*) FILTER (y // 10 = 202) "2020s" FROM a WHERE country IS NOT NULL AND y BETWEEN 1990 AND 2029 GROUP BY 1""")
def pivot_decade(spark, d):
    a = dated(spark, d, "country").filter("country IS NOT NULL AND year BETWEEN 1990 AND 2029").withColumn("decade", F.concat((F.floor(F.col("year") / 10) * 10).cast("string"), F.lit("s")))
    return a.groupBy("country").pivot("decade", ["1990s", "2000s", "2010s", "2020s"]).count().na.fill(0)


@query("SELECT id, lie_score, speaker, sentence FROM accusations WHERE lie_score IS NOT NULL AND NOT isnan(lie_score) ORDER BY lie_score DESC, id LIMIT 50")
def top_n_scored(spark, d):
    a = read(spark, d, "accusations", "id", "lie_score", "speaker", "sentence").filter("lie_score IS NOT NULL AND NOT isnan(lie_score)")
    return R.top_n(a, 50, F.desc("lie_score"), F.asc("id"))


_PARTY_N = "SELECT country, target_text, count(*) n FROM accusations WHERE target_type = 'political_party' AND country IS NOT NULL AND target_text IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3"


@query(f"WITH p AS ({_PARTY_N}) (SELECT 'low' side, * FROM p ORDER BY n, country, target_text LIMIT 20) UNION ALL (SELECT 'high' side, * FROM p ORDER BY n DESC, country, target_text LIMIT 20)")
def low_high_parties(spark, d):
    p = read(spark, d, "accusations", "country", "target_text", "target_type").filter("target_type = 'political_party'").drop("target_type").na.drop().groupBy("country", "target_text").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    low, high = R.top_n(p, 20, F.asc("n"), F.asc("country"), F.asc("target_text")), R.top_n(p, 20, F.desc("n"), F.asc("country"), F.asc("target_text"))
    return low.withColumn("side", F.lit("low")).unionByName(high.withColumn("side", F.lit("high")))


@query("""WITH e AS (SELECT quantile_cont(c_acctbal, 0.25) a, quantile_cont(c_acctbal, 0.5) b, quantile_cont(c_acctbal, 0.75) c FROM customer)
SELECT CASE WHEN c_acctbal <= a THEN 0 WHEN c_acctbal <= b THEN 1 WHEN c_acctbal <= c THEN 2 ELSE 3 END bin, count(*) n, round(avg(c_acctbal), 4) mean FROM customer, e GROUP BY 1""")
def qcut_rates(spark, d):
    return R.qcut(read(spark, d, "customer", "c_acctbal"), "c_acctbal").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("""WITH m AS (SELECT median(l_quantity) q, median(l_extendedprice) p FROM lineitem)
SELECT CASE WHEN l_quantity > q THEN 'high' ELSE 'low' END || '-' || CASE WHEN l_extendedprice > p THEN 'high' ELSE 'low' END cell, count(*) n FROM lineitem, m GROUP BY 1""")
def median_split_2x2(spark, d):
    line = read(spark, d, "lineitem", "l_quantity", "l_extendedprice")
    m = R.quantiles(line, "l_quantity", [0.5]).select(F.col("q")[0].alias("q")).join(F.broadcast(R.quantiles(line, "l_extendedprice", [0.5]).select(F.col("q")[0].alias("p"))))
    side = lambda c, e: F.when(F.col(c) > F.col(e), "high").otherwise("low")
    return line.join(F.broadcast(m)).groupBy(F.concat_ws("-", side("l_quantity", "q"), side("l_extendedprice", "p")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))  # one row


@query(f"""WITH a AS (SELECT country, source_dataset, {YEAR} AS year FROM accusations WHERE country IS NOT NULL AND source_dataset IS NOT NULL),
b AS (SELECT * FROM a WHERE country IN (SELECT country FROM a GROUP BY 1 HAVING count(*) >= 30)),
c AS (SELECT * FROM b WHERE source_dataset IN (SELECT source_dataset FROM b GROUP BY 1 HAVING count(*) >= 30)),
e AS (SELECT * FROM c WHERE year IN (SELECT year FROM c WHERE year IS NOT NULL GROUP BY 1 HAVING count(*) >= 30))
SELECT country, source_dataset, year, count(*) n FROM e GROUP BY ALL""")
def thin_cell_prune(spark, d):
    a = dated(spark, d, "country", "source_dataset").select("country", "source_dataset", "year").filter("country IS NOT NULL AND source_dataset IS NOT NULL")
    return R.prune_thin(a, ["country", "source_dataset", "year"], 30).groupBy("country", "source_dataset", "year").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH a AS (SELECT country, {YEAR} AS year FROM accusations), ok AS (SELECT country FROM a GROUP BY 1 HAVING count(DISTINCT year) >= 15)
SELECT country, year, count(*) n FROM a WHERE country IN (SELECT country FROM ok WHERE country IS NOT NULL) GROUP BY ALL""")
def balanced_panel(spark, d):
    a = dated(spark, d, "country").select("country", "year").filter("country IS NOT NULL")
    return R.keep_with_distinct(a, "country", "year", 15).groupBy("country", "year").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT country, source_dataset, count(*) n FROM accusations WHERE source_dataset IN (SELECT source_dataset FROM accusations WHERE target_type = 'person' GROUP BY 1
HAVING avg(CASE WHEN resolved_speaker_id IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.02) GROUP BY ALL""")
def resolved_rate_filter(spark, d):
    a = read(spark, d, "accusations", "country", "source_dataset", "target_type", "resolved_speaker_id")
    ok = a.filter("target_type = 'person'").groupBy("source_dataset").agg(F.avg(F.col("resolved_speaker_id").isNotNull().cast("double")).alias("share")).filter("share >= 0.02")
    return a.join(ok, "source_dataset", "left_semi").groupBy("country", "source_dataset").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(least(floor((lie_score - 0.5) / 0.01), 49) AS INTEGER) bin, count(*) n FROM accusations WHERE lie_score BETWEEN 0.5 AND 1.0 AND NOT isnan(lie_score) GROUP BY 1")
def score_histogram(spark, d):
    return R.histogram(read(spark, d, "accusations", "lie_score"), "lie_score", 0.5, 1.0, 50)


@query("SELECT c_custkey, c_acctbal, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 6) ecdf FROM customer")
def ecdf_by_group(spark, d):
    return R.ecdf(read(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", "c_acctbal").select("c_custkey", "c_acctbal", F.round("ecdf", 6).alias("ecdf"))


@query(f"SELECT country, source_dataset, count(*) n FROM accusations WHERE country NOT IN {EXCLUDED} GROUP BY ALL")
def exclude_countries(spark, d):
    from ..sources.readers import parquet

    return parquet(spark, f"{d}/accusations.parquet", ["country", "source_dataset"], EXCLUDED).groupBy("country", "source_dataset").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT country, target_type, count(*) n FROM accusations WHERE country IS NOT NULL AND target_type IS NOT NULL GROUP BY ALL")
def crosstab_targets(spark, d):
    return read(spark, d, "accusations", "country", "target_type").na.drop().groupBy("country", "target_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT country, ym, sum(words) n_words, count(*) n_docs, count(speaker) n_with_speaker FROM (SELECT country, CASE WHEN length(doc_date) >= 7 THEN substr(doc_date, 1, 7) END ym, speaker,
CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END words FROM documents) GROUP BY ALL""".replace("sum(words)", "CAST(sum(words) AS BIGINT)"))
def monthly_words(spark, d):
    x = read(spark, d, "documents", "country", "doc_date", "speaker", "text")
    return x.groupBy("country", T.month_of(F.col("doc_date")).alias("ym")).agg(F.sum(T.word_count(F.col("text"))).alias("n_words"), F.count(F.lit(1)).alias("n_docs"), F.count("speaker").alias("n_with_speaker"))


@query(f"""WITH {SENT} SELECT year, CAST(sum(n) AS BIGINT) n, CAST(sum(k) AS BIGINT) k, count(*) n_countries, round(sum(k) * 10000.0 / sum(n), 6) pooled_10k FROM
(SELECT country, year, count(*) n, count(*) FILTER (label) k FROM sent GROUP BY 1, 2) GROUP BY 1""")
def pooled_year(spark, d):
    g = R.labelled_rates(sentences(spark, d), ["country", "year"], F.col("label"), "n", "k")
    return g.groupBy("year").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("n_countries"), F.round(F.sum("k") * 10000.0 / F.sum("n"), 6).alias("pooled_10k"))


@query(f"""WITH {SENT}, g AS (SELECT country, year, count(*) FILTER (label) * 10000.0 / count(*) r FROM sent GROUP BY 1, 2)
SELECT country, round(regr_slope(r, year), 6) slope, round(regr_intercept(r, year), 3) intercept, count(*) n FROM g GROUP BY 1 HAVING count(*) >= 3""")
def ols_by_country(spark, d):
    g = sentences(spark, d).groupBy("country", "year").agg((F.count_if("label") * 10000.0 / F.count(F.lit(1))).alias("r"))
    return g.groupBy("country").agg(F.round(F.regr_slope("r", "year"), 6).alias("slope"), F.round(F.regr_intercept("r", "year"), 3).alias("intercept"), F.count(F.lit(1)).alias("n")).filter("n >= 3")


@query("""WITH z AS (SELECT l_orderkey, l_linenumber, (l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER () a, -(l_discount - avg(l_discount) OVER ()) / stddev_samp(l_discount) OVER () b,
CASE WHEN l_returnflag <> 'N' THEN (l_tax - avg(l_tax) OVER ()) / stddev_samp(l_tax) OVER () END c FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN (CASE WHEN c IS NULL THEN 2 ELSE 3 END) >= 3 THEN round((a + b + c) / 3, 6) END idx FROM z""")
def zscore_index(spark, d):
    """Row mean of z-scores, one negated, where at least three items are present."""
    line = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    cols = ("l_quantity", "l_discount", "l_tax")
    st = line.agg(*[f(c).alias(f"{p}{c}") for c in cols for p, f in (("m_", F.avg), ("s_", F.stddev_samp))])
    z = {c: (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in cols}
    items = F.array_compact(F.array(z["l_quantity"], -z["l_discount"], F.when(F.col("l_returnflag") != "N", z["l_tax"])))
    mean = F.aggregate(items, F.lit(0.0), lambda a, b: a + b) / F.size(items)
    return line.join(F.broadcast(st)).select("l_orderkey", "l_linenumber", F.when(F.size(items) >= 3, F.round(mean, 6)).alias("idx"))  # one row


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 7919 + 101) % 1000003, doc_id) r FROM documents WHERE source IS NOT NULL) WHERE r <= 3")
def sample_per_source(spark, d):
    """A reproducible sample of three documents a source."""
    x = read(spark, d, "documents", "doc_id", "source").filter("source IS NOT NULL")
    return R.top_per_group(x, ["source"], 3, (F.col("doc_id") * 7919 + 101) % 1000003, F.asc("doc_id"))


@query("""SELECT max(length(sentence)) longest, round(avg(length(sentence)), 4) mean_len, count(*) FILTER (contains(context, chr(10))) multi_line, CAST(sum(length(sentence) - length(replace(sentence, ',', ''))) AS BIGINT) commas,
count(*) FILTER (regexp_matches(sentence, '[!?]$')) marked FROM accusations""")
def text_statistics(spark, d):
    a = read(spark, d, "accusations", "sentence", "context")
    n = F.length("sentence")
    return a.agg(F.max(n).cast("bigint").alias("longest"), F.round(F.avg(n), 4).alias("mean_len"), F.count_if(F.contains("context", F.lit("\n"))).alias("multi_line"), F.sum(n - F.length(F.replace("sentence", F.lit(","), F.lit("")))).cast("bigint").alias("commas"), F.count_if(F.col("sentence").rlike("[!?]$")).alias("marked"))


@query("SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*) n, round(sum(value), 4) total FROM events GROUP BY ALL")
def daily_events(spark, d):
    return read(spark, d, "events", "event_type", "ts", "value").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
