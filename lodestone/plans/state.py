"""Pipeline state: queues, roll-ups, upserts, retries; models over aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel, stages
from ..stats import glm
from .people import _events
from .tables import SENT, read, register, sentences

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)
_S = stages.STAGES


@query("WITH x AS (" + " UNION ALL ".join(f"SELECT '{s}' stage, coalesce({s}_status, 'none') status FROM speakers" for s in _S) + ") SELECT stage, status, count(*) n, CAST(floor(count(*) * 100 / sum(count(*)) OVER (PARTITION BY stage)) AS BIGINT) pct FROM x GROUP BY 1, 2")
def status_counts(spark, d):
    return stages.status_counts(read(spark, d, "speakers", *[f"{s}_status" for s in _S]))


_READY = {"query": None, "fetch": "query", "url_synth": "fetch", "cv_synth": "url_synth", **{f"annotate_{g}": "cv_synth" for g in "abcd"}}


_SKIP = {"cv_synth": ", 'skipped'"}


@query(" UNION ALL ".join(f"SELECT '{s}' stage, count(*) FILTER ({s}_status = 'pending'" + (f" AND {p}_status IN ('success'{_SKIP.get(s, '')})" if p else "") + ") ready FROM speakers" for s, p in _READY.items()))
def stage_readiness(spark, d):
    return stages.readiness(read(spark, d, "speakers"))


@query("WITH r AS (" + " UNION ALL ".join(f"SELECT {i} pos, '{s}' stage, count(*) FILTER ({s}_status = 'pending' AND {p}_status IN ('success'{_SKIP.get(s, '')})) ready FROM speakers" for i, (s, p) in enumerate(_READY.items()) if p and s != "fetch") + ") SELECT stage, ready FROM r WHERE ready > 0 ORDER BY ready DESC, pos LIMIT 1")
def next_stage(spark, d):
    return stages.next_stage(stages.readiness(read(spark, d, "speakers")))


@query("""WITH c AS (SELECT speaker_id, count(*) FILTER (fetch_status = 'success') s, count(*) FILTER (fetch_status = 'pending') p, count(*) FILTER (fetch_status = 'failed') f, count(*) n FROM speaker_urls GROUP BY 1)
SELECT speaker_id, CASE WHEN s > 0 THEN 'success' WHEN p > 0 THEN 'pending' WHEN f > 0 THEN 'failed' ELSE 'failed' END status, coalesce(s, 0) n_success, coalesce(f, 0) n_failed, coalesce(n, 0) n_children FROM speakers LEFT JOIN c USING (speaker_id)""")
def status_rollup(spark, d):
    return stages.roll_up(read(spark, d, "speaker_urls", "speaker_id", "fetch_status"), read(spark, d, "speakers", "speaker_id"), "speaker_id", "fetch_status")


@query("""WITH b AS (SELECT user_id, event_type, ts, event_id, min(ts) OVER (PARTITION BY user_id, event_type) created, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) r FROM events)
SELECT user_id, event_type, event_id, ts, created FROM b WHERE r = 1""")
def upsert_latest(spark, d):
    """Odd events as the table, even ones as the delta: the latest version per key, the first creation kept."""
    e = read(spark, d, "events", "user_id", "event_type", "event_id", "ts").withColumn("created", F.col("ts"))
    return stages.upsert(e.filter("event_id % 2 = 1"), e.filter("event_id % 2 = 0"), ["user_id", "event_type"], "event_id", "created")


@query("""WITH t AS (SELECT DISTINCT speaker_id, url FROM speaker_urls WHERE id % 3 = 0), f AS (SELECT speaker_id, url, id, row_number() OVER (PARTITION BY speaker_id, url ORDER BY id) r FROM speaker_urls WHERE id % 3 <> 0)
SELECT speaker_id, url FROM t UNION ALL SELECT speaker_id, url FROM f WHERE r = 1 AND (speaker_id, url) NOT IN (SELECT (speaker_id, url) FROM t)""")
def insert_ignore(spark, d):
    u = read(spark, d, "speaker_urls", "speaker_id", "url", "id")
    have = u.filter("id % 3 = 0").select("speaker_id", "url").distinct()
    new = u.filter("id % 3 <> 0")
    return stages.insert_ignore(have, stages.keep_first(new, ["speaker_id", "url"], F.asc("id")).select("speaker_id", "url"), ["speaker_id", "url"], F.col("url"))


@query("SELECT speaker_id, url, max(id) id FROM speaker_urls GROUP BY 1, 2")
def dedupe_last(spark, d):
    return stages.keep_first(read(spark, d, "speaker_urls", "speaker_id", "url", "id"), ["speaker_id", "url"], F.desc("id"))


@query("SELECT speaker_id, name_cleaned FROM speakers WHERE fetch_status = 'success' AND speaker_id NOT IN (SELECT speaker_id FROM speaker_annotations WHERE group_name = 'A')")
def anti_todo(spark, d):
    s = read(spark, d, "speakers", "speaker_id", "name_cleaned", "fetch_status").filter("fetch_status = 'success'")
    done = read(spark, d, "speaker_annotations", "speaker_id", "group_name").filter("group_name = 'A'")
    return s.join(done, "speaker_id", "left_anti").select("speaker_id", "name_cleaned")


@query("SELECT s.speaker_id, s.name_cleaned, a.annotation_json FROM speakers s JOIN speaker_annotations a USING (speaker_id) WHERE a.group_name = 'C' AND a.status = 'success' AND s.annotate_c_status = 'success' ORDER BY speaker_id LIMIT 200")
def work_queue(spark, d):
    """A bounded work queue in a fixed order."""
    a = read(spark, d, "speaker_annotations", "speaker_id", "group_name", "status", "annotation_json").filter("group_name = 'C' AND status = 'success'")
    s = read(spark, d, "speakers", "speaker_id", "name_cleaned", "annotate_c_status").filter("annotate_c_status = 'success'")
    return s.join(a, "speaker_id").orderBy("speaker_id").limit(200).select("speaker_id", "name_cleaned", "annotation_json")


@query("""WITH ids AS (SELECT speaker_id FROM speakers WHERE fetch_status = 'failed') SELECT speaker_id, CASE WHEN speaker_id IN (SELECT speaker_id FROM ids) THEN 'pending' ELSE fetch_status END fetch_status FROM speakers""")
def retry_activation(spark, d):
    """The failed set as a batch's JSON list, set back to pending."""
    s = read(spark, d, "speakers", "speaker_id", "fetch_status")
    batch = s.filter("fetch_status = 'failed'").groupBy(F.substring("speaker_id", 1, 2).alias("part")).agg(F.to_json(F.collect_list("speaker_id")).alias("speaker_ids"))
    return stages.activate_retries(s, batch, "fetch")


@query("SELECT id, CASE WHEN fetch_http_status >= 500 THEN 'pending' ELSE fetch_status END fetch_status FROM speaker_urls")
def update_rows(spark, d):
    u = read(spark, d, "speaker_urls", "id", "fetch_status", "fetch_http_status")
    delta = u.filter("fetch_http_status >= 500").select("id", F.lit("pending").alias("fetch_status"))
    return stages.update_by_id(u.select("id", "fetch_status"), delta, "id", ["fetch_status"])


def _table(spark, fit):
    return spark.createDataFrame(fit.table().round(9))


def _country_years(spark, d):
    g = sentences(spark, d).groupBy("country", "year").agg(F.count(F.lit(1)).alias("n"), F.count_if("label").alias("k"))
    return g.withColumn("year_c", F.col("year") - 1998)


@query()
def poisson_fe(spark, d):
    """Poisson rates with country effects and standard errors clustered by country."""
    return _table(spark, glm.fit_counts(_country_years(spark, d), "k", ["year_c"], ["country"], "n", cluster="country"))


@query()
def nb_fe(spark, d):
    return _table(spark, glm.fit_counts(_country_years(spark, d), "k", ["year_c"], ["country"], "n", family="nb", robust=True))


@query(f"WITH {SENT} SELECT source_dataset, round(ln(count(*) FILTER (label) / count(*)), 6) log_rate FROM sent GROUP BY 1")
def poisson_saturated(spark, d):
    """A Poisson model with one effect per group is the groups' log rates: fitted here, closed form in SQL."""
    g = sentences(spark, d).groupBy("source_dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if("label").alias("k"))
    fit = glm.fit_counts(g, "k", factors=["source_dataset"], exposure="n")
    b = dict(zip(fit.names, fit.beta))
    levels = [r[0] for r in g.select("source_dataset").orderBy("source_dataset").collect()]
    rows = [(v, round(float(b["Intercept"] + b.get(f"source_dataset[{v}]", 0.0)), 6)) for v in levels]
    return spark.createDataFrame(rows, "source_dataset string, log_rate double")


@query()
def cond_logit(spark, d):
    r = glm.conditional_logit(panel.choice_sets(_events(spark, d)))
    return spark.createDataFrame([tuple(r.values())], ", ".join(f"{k} double" for k in r))


@query()
def trend_by_country(spark, d):
    """A negative-binomial trend per country from its yearly counts, with HC1 errors and a verdict by its interval."""
    return glm.trends(_country_years(spark, d), "country", "year", "k", "n", 5)


@query()
def design_rank(spark, d):
    r, k, flat = glm.design_rank(_country_years(spark, d), ["n", "year_c", "year"], ["country"])
    return spark.createDataFrame([(r, k, ",".join(flat))], "rank int, columns int, without_variance string")
