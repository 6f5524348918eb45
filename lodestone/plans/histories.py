"""As-of joins, histories and covariates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import asof, enrich, panel, stages
from .tables import YEAR, dated, read, register

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)


def _orders(spark, d):
    return read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus").withColumn("day", F.to_date("o_orderdate"))


def _ships(spark, d):
    """Line items dated by their shipping, each to be looked up in its customer's order history."""
    line = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate")
    o = read(spark, d, "orders", "o_orderkey", "o_custkey")
    return line.join(o, line.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", F.col("o_custkey").alias("cust"), F.date_sub(F.to_date("l_shipdate"), 60).alias("at"))


_H = """h AS (SELECT o_custkey c, CAST(o_orderdate AS DATE) AS day, max_by(o_totalprice, o_orderkey) price FROM orders GROUP BY 1, 2),
f AS (SELECT l_orderkey, l_linenumber, o_custkey c, CAST(l_shipdate AS DATE) - 60 AS "at" FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"WITH {_H} SELECT l_orderkey, l_linenumber, price FROM f ASOF LEFT JOIN h ON f.c = h.c AND f.\"at\" >= h.day")
def asof_latest(spark, d):
    h = _orders(spark, d).select(F.col("o_custkey").alias("cust"), "day", F.col("o_totalprice").alias("price"), "o_orderkey")
    return asof.asof_join(_ships(spark, d), h, ["cust"], "at", "day", ["price"], [F.col("o_orderkey")]).select("l_orderkey", "l_linenumber", "price")


@query(f"WITH {_H}, first AS (SELECT c, min_by(price, day) p FROM h GROUP BY 1) SELECT l_orderkey, l_linenumber, coalesce(price, p) price FROM f ASOF LEFT JOIN h ON f.c = h.c AND f.\"at\" >= h.day JOIN first ON f.c = first.c")
def asof_or_first(spark, d):
    h = _orders(spark, d).select(F.col("o_custkey").alias("cust"), "day", F.col("o_totalprice").alias("price"), "o_orderkey")
    return asof.asof_join(_ships(spark, d), h, ["cust"], "at", "day", ["price"], [F.col("o_orderkey")], or_first=True).select("l_orderkey", "l_linenumber", "price")


@query("""SELECT o_orderkey, round(o_totalprice, 7) AS last, round(avg(o_totalprice) OVER w, 7) avg_all, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 7) avg_3,
round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 7) AS delta FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def history_vars(spark, d):
    h = asof.running_history(_orders(spark, d), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")
    return h.select("o_orderkey", *[F.round(c, 7).alias(c) for c in ("last", "avg_all", "avg_3", "delta")])


@query("""WITH g AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END act, lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) nxt,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) rn FROM orders)
SELECT g.o_orderkey, g.act, CASE WHEN g.act = 0 THEN round((g.day - (SELECT max_by(b.nxt, b.rn) FROM g b WHERE b.o_custkey = g.o_custkey AND b.rn < g.rn AND b.act = 1)) / 365.25, 2) END AS years FROM g""")
def last_active_gap(spark, d):
    """Years since the end of the last active period, null if active or never active before."""
    g = _orders(spark, d).select(F.lit(0).alias("unit"), "o_custkey", "o_orderkey", "day", F.struct("o_orderdate", "o_orderkey").alias("start"), (F.col("o_orderstatus") == "F").cast("int").alias("act"))
    y = asof.years_since_active(g, "unit", "o_custkey", "start", "act")
    return y.select("o_orderkey", "act", F.round(F.datediff("day", F.to_date("exited.o_orderdate")) / 365.25, 2).alias("years"))


def _engine_sql(keys: str, by_id: bool = False) -> str:
    """CTEs ending in ``dim``: covariates of the distinct keys of a query."""
    ids = "ids AS (SELECT DISTINCT speaker_id, date FROM kk WHERE speaker_id IS NOT NULL)"
    covers = "(t.sy IS NULL OR t.sy <= ids_y.year) AND (t.ey IS NULL OR t.ey >= ids_y.year)"
    js = lambda g, f: f"max(CASE WHEN group_name = '{g}' THEN json_extract_string(annotation_json, '$.{f}') END)"
    return f"""keys AS ({keys}),
sp AS (SELECT name_cleaned speaker, country, source_dataset, max_by(speaker_id, struct_pack(n := coalesce(n_sentences, 0), s := speaker_id)) speaker_id FROM speakers GROUP BY 1, 2, 3),
kk AS ({"SELECT * FROM keys" if by_id else "SELECT keys.*, sp.speaker_id FROM keys LEFT JOIN sp USING (speaker, country, source_dataset)"}), {ids},
ids_y AS (SELECT *, {YEAR} AS year FROM ids),
ok AS (SELECT * FROM speaker_annotations WHERE status = 'success' AND annotation_json IS NOT NULL),
person AS (SELECT speaker_id, lower({js("A", "gender")}) gender, TRY_CAST({js("A", "birth_year")} AS INTEGER) birth_year FROM ok GROUP BY 1),
tl AS (SELECT speaker_id, unnest(CAST(json_extract(annotation_json, '$.parties[*]') AS JSON[])) p, unnest(range(CAST(json_array_length(annotation_json, '$.parties') AS BIGINT))) pos FROM ok WHERE group_name = 'B'),
t AS (SELECT speaker_id, pos, TRY_CAST(json_extract_string(p, '$.start_year') AS INTEGER) sy, TRY_CAST(json_extract_string(p, '$.end_year') AS INTEGER) ey, TRY_CAST(json_extract_string(p, '$.partyfacts_id') AS BIGINT) pid, json_extract_string(p, '$.partyfacts_name') pname FROM tl),
pick AS (SELECT ids_y.speaker_id, ids_y.date, t.pid, t.pname, row_number() OVER (PARTITION BY ids_y.speaker_id, ids_y.date ORDER BY coalesce({covers}, false) DESC, CASE WHEN coalesce({covers}, false) THEN coalesce(t.sy, -9999) ELSE 0 END DESC, pos) r
 FROM ids_y JOIN t ON ids_y.speaker_id = t.speaker_id WHERE ids_y.year IS NOT NULL),
dim AS (SELECT kk.*, gender, birth_year, CASE WHEN birth_year > 0 THEN year - birth_year END age, pid partyfacts_id, CASE WHEN pid IS NOT NULL THEN pname END party_name, CASE WHEN kk.speaker_id IS NULL THEN 'no_speaker' WHEN pid IS NULL THEN 'no_party' ELSE 'resolved' END AS match,
 kk.speaker_id IN (SELECT speaker_id FROM t) has_parties
 FROM kk LEFT JOIN person ON kk.speaker_id = person.speaker_id LEFT JOIN ids_y ON kk.speaker_id = ids_y.speaker_id AND kk.date IS NOT DISTINCT FROM ids_y.date LEFT JOIN pick ON kk.speaker_id = pick.speaker_id AND kk.date IS NOT DISTINCT FROM pick.date AND r = 1)"""


_NAMED = _engine_sql("SELECT DISTINCT speaker, country, source_dataset, date FROM accusations")
_FIELDS = ["speaker_id", "match", "gender", "birth_year", "age", "partyfacts_id", "party_name"]
_KEY = ["speaker", "country", "source_dataset", "date"]


def _covariates(spark, d):
    return enrich.covariates(dated(spark, d, "speaker", "country", "source_dataset").select(*_KEY), read(spark, d, "speakers"), read(spark, d, "speaker_annotations"))


@query(f"WITH {_NAMED} SELECT speaker, country, source_dataset, date, {', '.join(_FIELDS)} FROM dim")
def covariate_engine(spark, d):
    return _covariates(spark, d).select(*_KEY, *_FIELDS)


@query(f"""WITH {_NAMED}, s AS (SELECT *, CASE WHEN speaker_id IS NULL OR NOT has_parties THEN 'no_speaker' WHEN partyfacts_id IS NULL THEN 'no_party' ELSE 'resolved' END st FROM dim)
SELECT a.id, s.partyfacts_id, s.st status, CASE WHEN s.partyfacts_id IN (SELECT partyfacts_id FROM partyfacts_core) THEN 1 ELSE 0 END has_party_record FROM accusations a LEFT JOIN s
ON a.speaker IS NOT DISTINCT FROM s.speaker AND a.country IS NOT DISTINCT FROM s.country AND a.source_dataset IS NOT DISTINCT FROM s.source_dataset AND a.date IS NOT DISTINCT FROM s.date""")
def party_variables(spark, d):
    """Each accusation's party, the status of its resolution and whether the party's record is known."""
    dim = enrich.party_status(_covariates(spark, d)).select(*_KEY, "partyfacts_id", "status")
    a = enrich.join_back(read(spark, d, "accusations", "id", *_KEY), dim, _KEY, "")
    core = read(spark, d, "partyfacts_core").select(F.col("partyfacts_id").cast("bigint").alias("partyfacts_id"), F.lit(1).alias("has"))
    return a.join(core, "partyfacts_id", "left").select("id", "partyfacts_id", "status", F.coalesce("has", F.lit(0)).alias("has_party_record"))


_ACCUSER = "CASE WHEN is_interjection = 1 AND accuser_speaker IS NOT NULL THEN accuser_speaker ELSE speaker END"
_BOTH_A = _engine_sql(f"SELECT DISTINCT {_ACCUSER} speaker, country, source_dataset, date FROM accusations").replace("dim AS (", "dim_a AS (")
_BOTH_T = _engine_sql("SELECT DISTINCT resolved_speaker_id speaker_id, date FROM accusations WHERE resolved_speaker_id IS NOT NULL", by_id=True)


@query(f"""WITH acc AS (SELECT * FROM (WITH {_BOTH_A} SELECT * FROM dim_a)), tgt AS (SELECT * FROM (WITH {_BOTH_T} SELECT * FROM dim)), a AS (SELECT *, {_ACCUSER} who FROM accusations)
SELECT a.id, {', '.join(f'acc.{c} accuser_{c}' for c in _FIELDS)}, tgt.gender target_gender, tgt.birth_year target_birth_year, tgt.age target_age, tgt.partyfacts_id target_partyfacts_id, tgt.party_name target_party_name,
CASE WHEN tgt.speaker_id IS NOT NULL THEN CASE WHEN tgt.partyfacts_id IS NULL THEN 'no_party' ELSE 'resolved' END END target_match
FROM a LEFT JOIN acc ON a.who IS NOT DISTINCT FROM acc.speaker AND a.country IS NOT DISTINCT FROM acc.country AND a.source_dataset IS NOT DISTINCT FROM acc.source_dataset AND a.date IS NOT DISTINCT FROM acc.date
LEFT JOIN tgt ON a.resolved_speaker_id = tgt.speaker_id AND a.date IS NOT DISTINCT FROM tgt.date""")
def accusation_dataset(spark, d):
    """Accusations with their accuser's and target's covariates at their date; the accuser of an interjection is who interjected."""
    a = read(spark, d, "accusations", "id", *_KEY, "is_interjection", "accuser_speaker", "resolved_speaker_id")
    a = a.withColumn("speaker", F.when((F.col("is_interjection") == 1) & F.col("accuser_speaker").isNotNull(), F.col("accuser_speaker")).otherwise(F.col("speaker")))
    ann = read(spark, d, "speaker_annotations")
    dim = enrich.covariates(a, read(spark, d, "speakers"), ann).select(*_KEY, *_FIELDS)
    out = enrich.join_back(a, dim, _KEY, "accuser_")
    side = ["gender", "birth_year", "age", "partyfacts_id", "party_name"]
    tgt = enrich.covariates_by_id(a.filter("resolved_speaker_id IS NOT NULL").select(F.col("resolved_speaker_id").alias("speaker_id"), "date"), ann)
    tgt = tgt.select(F.col("speaker_id").alias("resolved_speaker_id"), "date", *side, F.when(F.col("partyfacts_id").isNull(), "no_party").otherwise("resolved").alias("match"))
    out = enrich.join_back(out, tgt, ["resolved_speaker_id", "date"], "target_")
    return out.select("id", *[f"accuser_{c}" for c in _FIELDS], *[f"target_{c}" for c in (*side, "match")])


_CORPUS = _engine_sql("SELECT DISTINCT speaker, country, source source_dataset, doc_date date FROM documents WHERE speaker IS NOT NULL")


@query(f"""WITH {_CORPUS} SELECT doc_id, {', '.join(f'dim.{c} speaker_{c}' for c in _FIELDS)} FROM documents d LEFT JOIN dim ON d.speaker IS NOT DISTINCT FROM dim.speaker AND d.country IS NOT DISTINCT FROM dim.country
AND d.source IS NOT DISTINCT FROM dim.source_dataset AND d.doc_date IS NOT DISTINCT FROM dim.date""")
def full_corpus(spark, d):
    """The whole corpus with its speakers' covariates: distinct keys, the engine over them, joined back null-safely."""
    docs = read(spark, d, "documents", "doc_id", "speaker", "country", F.col("source").alias("source_dataset"), F.col("doc_date").alias("date"))
    dim = enrich.covariates(docs.filter("speaker IS NOT NULL"), read(spark, d, "speakers"), read(spark, d, "speaker_annotations")).select(*_KEY, *_FIELDS)
    return enrich.join_back(docs, dim, _KEY, "speaker_").select("doc_id", *[f"speaker_{c}" for c in _FIELDS])


_COV = ("gender", "birth_year", "partyfacts_id", "party_name")


@query(f"""WITH {_NAMED}, j AS (SELECT a.id, dim.*, {YEAR.replace("date", "a.date")} AS year FROM accusations a JOIN dim ON a.speaker = dim.speaker AND a.country = dim.country AND a.source_dataset = dim.source_dataset AND a.date = dim.date WHERE dim.speaker_id IS NOT NULL)
SELECT speaker_id, country, source_dataset, year, count(*) n_sentences, {', '.join(f'min_by({c}, id) FILTER ({c} IS NOT NULL) {c}' for c in _COV)} FROM j WHERE year IS NOT NULL GROUP BY 1, 2, 3, 4""")
def speaker_year_covariates(spark, d):
    """Speaker-years with each covariate's first value that isn't null."""
    a = enrich.join_back(read(spark, d, "accusations", "id", *_KEY), _covariates(spark, d).select(*_KEY, "speaker_id", *_COV), _KEY, "").withColumn("year", T.year_of(F.col("date")))
    a = a.filter("speaker_id IS NOT NULL AND year IS NOT NULL AND country IS NOT NULL AND source_dataset IS NOT NULL")
    none = a.filter("false")
    return panel.speaker_year_panel(a, none, none, covariates=_COV, order="id").drop("acc_made", "acc_received")


_MEAS = """e AS (SELECT o_custkey % 20 party, CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice), 0) share FROM orders GROUP BY 1, 2),
h AS (SELECT party, day, share vote_share_last, avg(share) OVER w vote_share_avg, avg(share) OVER (PARTITION BY party ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) vote_share_avg_last3, share - lag(share) OVER (PARTITION BY party ORDER BY day) vote_share_delta FROM e
 WINDOW w AS (PARTITION BY party ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT o_custkey % 4 country, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS day, o_custkey % 20 party, CAST(max(CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END) AS INTEGER) in_cabinet, CAST(max(CASE WHEN o_custkey % 35 = 0 THEN 1 ELSE 0 END) AS INTEGER) is_pm FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2, 3),
g0 AS (SELECT m.country, m.party, s.day, coalesce(c.in_cabinet, 0) in_cabinet, coalesce(c.is_pm, 0) is_pm FROM (SELECT DISTINCT country, party FROM c) m JOIN (SELECT DISTINCT country, day FROM c) s ON m.country = s.country LEFT JOIN c ON c.country = m.country AND c.party = m.party AND c.day = s.day),
g1 AS (SELECT *, lead(day) OVER (PARTITION BY country, party ORDER BY day) nxt FROM g0),
g AS (SELECT *, CASE WHEN in_cabinet = 0 THEN last_value(CASE WHEN in_cabinet = 1 THEN nxt END IGNORE NULLS) OVER (PARTITION BY country, party ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END exited FROM g1),
v AS (SELECT o_custkey % 20 party, CAST(date_trunc('year', o_orderdate) AS DATE) AS day, round(avg(o_totalprice), 4) populism FROM orders WHERE o_orderdate >= DATE '1994-01-01' GROUP BY 1, 2),
v1 AS (SELECT party, min_by(populism, day) p FROM v GROUP BY 1),
k AS (SELECT DISTINCT l_suppkey % 20 party, CAST(l_shipdate AS DATE) AS date FROM lineitem)"""


@query(f"""WITH {_MEAS} SELECT k.party, k.date, round(vote_share_last, 8) vote_share_last, round(vote_share_avg, 8) vote_share_avg, round(vote_share_avg_last3, 8) vote_share_avg_last3, round(vote_share_delta, 8) vote_share_delta, in_cabinet, is_pm,
CASE WHEN in_cabinet = 1 THEN 0.0 ELSE round((k.date - exited) / 365.25, 2) END years_since_government, coalesce(v.populism, v1.p) populism
FROM k ASOF LEFT JOIN h ON k.party = h.party AND k.date >= h.day ASOF LEFT JOIN g ON k.party = g.party AND k.date >= g.day ASOF LEFT JOIN v ON k.party = v.party AND k.date >= v.day LEFT JOIN v1 ON k.party = v1.party""")
def party_measures(spark, d):
    """A party's vote shares, government record and expert scores as of each date, from order histories in the roles of elections and cabinets."""
    o = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").withColumn("party", F.col("o_custkey") % 20)
    elections = o.groupBy("party", F.to_date("o_orderdate").alias("day")).agg(F.round(F.avg("o_totalprice"), 0).alias("vote_share"))
    held = lambda m, n: F.max((F.col("o_custkey") % m == 0).cast("int")).alias(n)
    cabinets = o.filter("o_orderkey % 3 = 0").groupBy((F.col("o_custkey") % 4).alias("country"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("day"), "party").agg(held(7, "in_cabinet"), held(35, "is_pm")).withColumn("cabinet", F.col("day"))
    scores = o.filter("o_orderdate >= DATE '1994-01-01'").groupBy("party", F.to_date(F.date_trunc("year", "o_orderdate")).alias("day")).agg(F.round(F.avg("o_totalprice"), 4).alias("populism"))
    keys = read(spark, d, "lineitem", (F.col("l_suppkey") % 20).alias("party"), F.to_date("l_shipdate").alias("date"))
    m = enrich.party_measures(keys, elections, cabinets, scores, ["populism"])
    shares = [f"vote_share_{c}" for c in ("last", "avg", "avg_last3", "delta")]
    return m.select("party", "date", *[F.round(c, 8).alias(c) for c in shares], "in_cabinet", "is_pm", "years_since_government", "populism")


@query("""WITH e AS (SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 50 END k, event_type, value FROM events), dim AS (SELECT k, event_type, count(*) n, round(sum(value), 4) total FROM e GROUP BY 1, 2)
SELECT event_id, n dim_n, total dim_total FROM e LEFT JOIN dim ON e.k IS NOT DISTINCT FROM dim.k AND e.event_type = dim.event_type""")
def keyed_backfill(spark, d):
    e = read(spark, d, "events", "event_id", "user_id", "event_type", "value").withColumn("k", F.when(F.col("user_id") % 5 == 0, None).otherwise(F.col("user_id") % 50))
    dim = e.groupBy("k", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return enrich.join_back(e.select("event_id", "k", "event_type"), dim, ["k", "event_type"], "dim_").select("event_id", "dim_n", "dim_total")


@query("SELECT speaker, country, source_dataset, source_dataset_type, min(coalesce(date, '')) min_date, max(coalesce(date, '')) max_date, count(*) n FROM accusations WHERE speaker IS NOT NULL AND country IS NOT NULL AND source_dataset IS NOT NULL AND source_dataset_type IS NOT NULL GROUP BY ALL")
def speaker_dimension(spark, d):
    keys = ["speaker", "country", "source_dataset", "source_dataset_type"]
    a = read(spark, d, "accusations", *keys, "date").na.drop(subset=keys).withColumn("date", F.coalesce("date", F.lit("")))
    return a.groupBy(*keys).agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"), F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT DISTINCT trim(speaker) nm, country, source_dataset FROM accusations WHERE speaker IS NOT NULL AND country IS NOT NULL AND source_dataset IS NOT NULL AND trim(speaker) NOT IN ('', 'nan', '[unknown]')),
i AS (SELECT sha1(concat_ws('|', nm, country, source_dataset)) speaker_id, nm name_cleaned, country, source_dataset FROM p)
SELECT speaker_id, name_cleaned, country, source_dataset FROM speakers UNION ALL SELECT * FROM i WHERE speaker_id NOT IN (SELECT speaker_id FROM speakers)""")
def import_speakers(spark, d):
    """Insert-or-ignore of the persons among the speakers under their hashed id."""
    c = ["speaker_id", "name_cleaned", "country", "source_dataset"]
    a = read(spark, d, "accusations", "speaker", "country", "source_dataset").withColumn("name_cleaned", F.trim("speaker")).na.drop().filter("name_cleaned NOT IN ('', 'nan', '[unknown]')")
    new = a.withColumn("speaker_id", T.person_id(F.col("name_cleaned"), F.col("country"), F.col("source_dataset"))).select(*c)
    return stages.insert_ignore(read(spark, d, "speakers", *c), new, ["speaker_id"], F.col("name_cleaned"))
