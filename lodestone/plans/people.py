"""Entity resolution, context windows, panels and choice sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import infer
from ..functions import text as T
from ..operators import context, entity, panel
from .tables import SENT, YEAR, dated, read, register, sentences

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)


@query("""SELECT id, target_text, CASE WHEN r THEN 'government' ELSE target_type END target_type, CASE WHEN r THEN 'not_applicable' ELSE resolve_status END resolve_status, CASE WHEN NOT r THEN resolved_speaker_id END resolved_speaker_id,
CASE WHEN NOT r THEN resolved_name END resolved_name FROM (SELECT *, coalesce(target_status = 'success' AND target_type = 'person' AND coalesce(regexp_matches(target_text, '(?i)(minister|chancellor|kanzler|staatssekret|secretary of state|state secretary)'), false), false) r FROM accusations)""")
def recode_roles(spark, d):
    r = entity.recode_roles(read(spark, d, "accusations"))
    return r.select("id", "target_text", "target_type", "resolve_status", "resolved_speaker_id", "resolved_name")


_TITLE = r"^(?i:(?:the\s+)?(?:federal\s+)?(?:minister|bundesminister(?:in)?|staatssekretär(?:in)?|präsident(?:in)?|abg\.?|mag\.?|dr\.?|dipl\.?-?\s?ing\.?|prof\.?|mr|mrs|ms|miss|hon\.?)\s+)+"


def _surname(c: str) -> str:
    n = f"trim(coalesce({c}, ''))"
    n = f"CASE WHEN contains({n}, ',') THEN trim(string_split({n}, ',')[1]) ELSE trim(regexp_replace({n}, '{_TITLE}', '')) END"
    return rf"replace(lower(regexp_split_to_array(trim(regexp_replace({n}, '^[.,;:]+|[.,;:]+$', '', 'g')), '\s+')[-1]), 'ß', 'ss')"


_PERIOD = """(q."at" IS NULL OR q."at" = '' OR min_date IS NULL OR min_date = '' OR max_date IS NULL OR max_date = '' OR (substr(min_date, 1, 10) <= q."at" AND q."at" <= substr(max_date, 1, 10)))"""


def _spoken(spark, d):
    """Accusations with the interjector's name before the sentence, as in the minutes."""
    a = read(spark, d, "accusations", "id", "sentence", "speaker", "country", "source_dataset", "date", "interjector_raw")
    return a.withColumn("sentence", F.when(F.col("interjector_raw").isNotNull(), F.concat_ws(": ", "interjector_raw", F.coalesce("sentence", F.lit("")))).otherwise(F.col("sentence"))).drop("interjector_raw")


_SPOKEN = r"""h AS (SELECT id, country, source_dataset, speaker, CASE WHEN date IS NOT NULL THEN substr(date, 1, 10) END "at",
regexp_extract(CASE WHEN interjector_raw IS NOT NULL THEN interjector_raw || ': ' || coalesce(sentence, '') ELSE coalesce(sentence, '') END, '^([A-ZÄÖÜ][A-Za-zÄÖÜäöüß.''\-]*(?:\s+(?:[A-ZÄÖÜ][A-Za-zÄÖÜäöüß.''\-]*|von|van|de|der|den|zu|di|da)){0,4}):\s', 1) i FROM accusations)"""


@query(f"WITH {_SPOKEN} SELECT id, i interjector, speaker target_text FROM h WHERE i <> ''")
def interjection_prefix(spark, d):
    a = _spoken(spark, d).withColumn("interjector", F.regexp_extract("sentence", entity.INTERJECTION, 1))
    return a.filter("interjector <> ''").select("id", "interjector", F.col("speaker").alias("target_text"))


@query(f"""WITH {_SPOKEN}, q AS (SELECT *, {_surname("i")} s FROM h WHERE i <> ''), p AS (SELECT speaker_id, name_cleaned, country, source_dataset, {_surname("name_cleaned")} s, min_date, max_date FROM speakers),
e AS (SELECT q.id, count(*) n, min(speaker_id) sid, min_by(name_cleaned, speaker_id) nm FROM q JOIN p ON q.country = p.country AND q.source_dataset = p.source_dataset AND q.s = p.s WHERE q.s <> '' AND {_PERIOD} GROUP BY 1)
SELECT q.id, i interjector, speaker target_text, CASE WHEN q.s = '' THEN 'no_surname' WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END status, CASE WHEN n = 1 THEN sid END speaker_id, CASE WHEN n = 1 THEN nm END AS name FROM q LEFT JOIN e USING (id)""")
def interjections_exact(spark, d):
    """Interjections attributed by surname and period alone."""
    return entity.attribute_interjections(_spoken(spark, d), read(spark, d, "speakers"), fuzzy=False).select("id", "interjector", "target_text", "status", "speaker_id", "name")


@query()
def interjections(spark, d):
    """Interjections with the speaker they are attributed to (exact, else by similarity)."""
    return entity.attribute_interjections(_spoken(spark, d), read(spark, d, "speakers"))



@query(f"""WITH q AS (SELECT id, country, source_dataset, {_surname("target_text")} s, CASE WHEN date IS NOT NULL THEN substr(date, 1, 10) END "at" FROM accusations
 WHERE target_type = 'person' AND target_status = 'success' AND coalesce(is_interjection, 0) = 0 AND resolve_status = 'pending'),
p AS (SELECT speaker_id, name_cleaned, country, source_dataset, {_surname("name_cleaned")} s, min_date, max_date FROM speakers),
e AS (SELECT q.id, count(*) n, min(speaker_id) sid, min_by(name_cleaned, speaker_id) nm FROM q JOIN p ON q.country = p.country AND q.source_dataset = p.source_dataset AND q.s = p.s WHERE q.s <> '' AND {_PERIOD} GROUP BY 1)
SELECT q.id, CASE WHEN q.s = '' THEN 'no_surname' WHEN n = 1 THEN 'resolved' ELSE 'unresolved' END resolve_status, CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'llm_ambiguous' END resolve_method,
CASE WHEN n = 1 THEN sid END resolved_speaker_id, CASE WHEN n = 1 THEN nm END resolved_name, coalesce(n, 0) n_candidates FROM q LEFT JOIN e USING (id)""")
def surname_period_join(spark, d):
    """Person targets matched by surname and period alone."""
    return entity.resolve_targets(read(spark, d, "accusations"), read(spark, d, "speakers"), fuzzy=False)


@query()
def resolve_targets(spark, d):
    """The same with similarity where no surname is equal."""
    return entity.resolve_targets(read(spark, d, "accusations"), read(spark, d, "speakers"))


@query()
def resolve_parties(spark, d):
    return entity.resolve_parties(read(spark, d, "accusations"), read(spark, d, "partyfacts_core"))


_ISO = ", ".join(f"('{a}', '{b}')" for a, b in entity.ISO3.items())


@query(rf"""WITH iso(c, iso3) AS (VALUES {_ISO}), a AS (SELECT id, iso3, target_text t, {YEAR} y FROM accusations LEFT JOIN iso ON country = c WHERE target_type = 'political_party' AND target_status = 'success' AND target_text IS NOT NULL),
n AS (SELECT partyfacts_id pid, country iso3, year_first f, year_last l, trim(regexp_replace(regexp_replace(lower(strip_accents(x)), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) k FROM (SELECT *, unnest([name_english, name, name_short]) x FROM partyfacts_core) WHERE x IS NOT NULL),
q AS (SELECT id, iso3, y, trim(regexp_replace(regexp_replace(lower(strip_accents(t)), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) k FROM a)
SELECT q.id, count(DISTINCT n.pid) n_parties, CAST(min(n.pid) AS BIGINT) first_party FROM q JOIN n ON q.iso3 = n.iso3 AND q.k = n.k AND length(n.k) >= 3 AND (y IS NULL OR ((f IS NULL OR y >= f - 1) AND (l IS NULL OR y <= l + 2))) GROUP BY 1""")
def party_exact(spark, d):
    """The equal-name tier of party resolution on whole normalised names."""
    a = dated(spark, d, "country", "target_text", "target_type", "target_status").filter("target_type = 'political_party' AND target_status = 'success' AND target_text IS NOT NULL")
    q = a.select("id", entity.iso3(F.col("country")).alias("iso3"), "year", T.normal_form("target_text").alias("k"))
    p = read(spark, d, "partyfacts_core").select(F.col("partyfacts_id").alias("pid"), F.col("country").alias("iso3"), F.col("year_first").alias("f"), F.col("year_last").alias("l"), F.explode(F.array_compact(F.array("name_english", "name", "name_short"))).alias("x")).withColumn("k", T.normal_form("x")).filter("length(k) >= 3")
    j = q.join(p, ["iso3", "k"]).filter(entity.active(F.col("year"), F.col("f"), F.col("l")))
    return j.groupBy("id").agg(F.count_distinct("pid").alias("n_parties"), F.min("pid").cast("bigint").alias("first_party"))


@query()
def fuzzy_block_match(spark, d):
    """Similar surnames within a country and dataset, best and runner-up."""
    p = entity.people_of(read(spark, d, "speakers"))
    q = p.select(F.col("speaker_id").alias("qid"), "country", "source_dataset", F.concat("surname", F.lit("s")).alias("surname"), F.lit(None).cast("string").alias("at")).distinct()
    return entity.match_surnames(q, p)


@query(r"""WITH o AS (SELECT id, source_file, coalesce(nullif(trim(speaker), ''), 'unknown') who, trim(coalesce(sentence, '')) line, lie_score, row_number() OVER (ORDER BY id) - 1 seq FROM accusations),
h AS (SELECT id, seq, source_file f FROM o WHERE lie_score >= 0.9 AND NOT isnan(lie_score)),
x AS (SELECT h.id, h.seq hit, o.seq pos, who, line, o.source_file IS NOT DISTINCT FROM h.f same FROM h JOIN o ON o.seq BETWEEN h.seq - 8 AND h.seq),
r AS (SELECT *, max(CASE WHEN NOT same THEN pos ELSE -1 END) OVER (PARTITION BY id) brk FROM x), k AS (SELECT *, lag(who) OVER (PARTITION BY id ORDER BY pos) prev FROM r WHERE pos > brk)
SELECT id, string_agg(CASE WHEN who IS DISTINCT FROM prev THEN '[' || who || ']' || chr(10) ELSE '' END || CASE WHEN pos = hit THEN '>>> ' ELSE '' END || line, chr(10) ORDER BY pos) context FROM k GROUP BY 1""")
def context_window(spark, d):
    """Confident accusations with the eight rows before them in ingestion order, within the unbroken run of their file."""
    a = read(spark, d, "accusations", "id", "source_file", "speaker", "sentence", "lie_score")
    rows = context.dense_index(a, "id")
    hits = rows.filter("lie_score >= 0.9 AND NOT isnan(lie_score)")
    return context.preceding_context(rows, hits).join(hits.select("seq", "id"), "seq").select("id", "context")


@query(f"""WITH {SENT}, e AS (SELECT speaker_id, country, source_dataset, year, count(*) n_sentences, min(quantity) q FROM sent GROUP BY 1, 2, 3, 4),
m AS (SELECT speaker_id, country, source_dataset, year, count(*) k FROM sent WHERE label GROUP BY 1, 2, 3, 4), r AS (SELECT speaker_id, country, source_dataset, year, count(*) k FROM sent WHERE score >= 0.09 GROUP BY 1, 2, 3, 4)
SELECT speaker_id, country, source_dataset, year, n_sentences, coalesce(m.k, 0) acc_made, coalesce(r.k, 0) acc_received, round(ln(n_sentences), 6) log_exposure, concat_ws('_', country, CAST(year AS VARCHAR)) country_year
FROM e LEFT JOIN m USING (speaker_id, country, source_dataset, year) LEFT JOIN r USING (speaker_id, country, source_dataset, year)""")
def speaker_year_panel(spark, d):
    s = sentences(spark, d)
    return panel.derive(panel.speaker_year_panel(s, s.filter("label"), s.filter("score >= 0.09")))


_PANEL = f"""{SENT}, sp AS (SELECT country, source_dataset, l_suppkey % 7 party, year, speaker_id, count(*) n_sentences, count(*) FILTER (label) acc_made, count(*) FILTER (score >= 0.09) acc_received FROM sent GROUP BY ALL),
p AS (SELECT country, source_dataset, party, year, CAST(sum(n_sentences) AS BIGINT) n_sentences, CAST(sum(acc_made) AS BIGINT) acc_made, CAST(sum(acc_received) AS BIGINT) acc_individual, count(*) n_speakers,
 CASE WHEN party = 6 THEN NULL WHEN party <= 2 THEN 1 ELSE 0 END in_cabinet, CASE WHEN party = 0 THEN 1 ELSE 0 END is_pm FROM sp GROUP BY 1, 2, 3, 4),
nm AS (SELECT country, source_dataset, l_suppkey % 7 party, year, count(*) n FROM sent WHERE label AND score >= 0.05 GROUP BY ALL), co AS (SELECT country, source_dataset, year, count(*) FILTER (quantity > 40) n_gov, count(*) FILTER (quantity < 10) n_opp FROM sent GROUP BY ALL),
j AS (SELECT p.*, coalesce(nm.n, 0) acc_named, coalesce(n_gov, 0) n_gov, coalesce(n_opp, 0) n_opp, CAST(sum(CASE WHEN coalesce(in_cabinet = 1, false) THEN 1 ELSE 0 END) OVER w AS BIGINT) n_in, CAST(sum(CASE WHEN coalesce(in_cabinet = 1, false) THEN 0 ELSE 1 END) OVER w AS BIGINT) n_out
 FROM p LEFT JOIN nm USING (country, source_dataset, party, year) LEFT JOIN co USING (country, source_dataset, year) WINDOW w AS (PARTITION BY country, source_dataset, year))"""
_CREDIT = {"bloc": "coalesce(CASE WHEN coalesce(in_cabinet = 1, false) THEN n_gov / nullif(n_in, 0) ELSE n_opp / nullif(n_out, 0) END, 0)", "pm_only": "CASE WHEN is_pm = 1 THEN CAST(n_gov AS DOUBLE) ELSE 0.0 END", "none": "0.0"}


def _party_year(mode):
    def run(spark, d):
        s = sentences(spark, d).withColumn("party", F.col("l_suppkey") % 7)
        k = ["country", "source_dataset", "party", "year"]
        sp = s.groupBy(*k, "speaker_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.count_if("label").alias("acc_made"), F.count_if(F.col("score") >= 0.09).alias("acc_received"))
        sp = sp.withColumns({"in_cabinet": F.when(F.col("party") == 6, None).otherwise((F.col("party") <= 2).cast("int")), "is_pm": (F.col("party") == 0).cast("int")})
        named = s.filter("label AND score >= 0.05").groupBy(*k).agg(F.count(F.lit(1)).alias("n"))
        coll = s.groupBy("country", "source_dataset", "year").agg(F.count_if(F.col("quantity") > 40).alias("n_gov"), F.count_if(F.col("quantity") < 10).alias("n_opp"))
        return panel.party_year_panel(sp, named, coll, mode).select(*k, "n_sentences", "acc_made", "acc_individual", "acc_named", "acc_collective", "acc_received", "n_speakers")

    return run


for _m, _c in _CREDIT.items():
    QUERIES[f"party_year_panel_{_m}"] = _party_year(_m)
    ORACLES[f"party_year_panel_{_m}"] = f"""WITH {_PANEL} SELECT country, source_dataset, party, year, n_sentences, acc_made, acc_individual, acc_named, round(CAST({_c} AS DOUBLE), 6) acc_collective,
CAST(round_even(acc_individual + acc_named + CAST({_c} AS DOUBLE), 0) AS BIGINT) acc_received, n_speakers FROM j"""


_EV = f"""{SENT}, ev AS (SELECT row_number() OVER (ORDER BY o_orderkey, l_linenumber, l_suppkey, score, quantity) obs, speaker_id % 40 a, l_suppkey % 40 b, "at" FROM sent WHERE label AND score >= 0.08)"""


def _events(spark, d):
    """Directed events between numbered actors, numbered in a total order."""
    s = sentences(spark, d).filter("label AND score >= 0.08").select((F.col("speaker_id") % 40).alias("a"), (F.col("l_suppkey") % 40).alias("b"), "at", F.struct("o_orderkey", "l_linenumber", "l_suppkey", "score", "quantity").alias("key"))
    return context.dense_index(s, "key", "obs").withColumn("obs", F.col("obs") + 1).select("obs", "a", "b", "at")


@query(f"WITH {_EV} SELECT a, b, count(*) n FROM ev WHERE a <> b GROUP BY 1, 2")
def dyads(spark, d):
    return panel.dyads(_events(spark, d))


@query(f"WITH {_EV}, p AS (SELECT a, b, count(*) n FROM ev WHERE a <> b GROUP BY 1, 2) SELECT x.a, x.b, x.n, y.n n_back FROM p x JOIN p y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.n >= 2 AND y.n >= 2")
def reciprocal_dyads(spark, d):
    return panel.reciprocal(panel.dyads(_events(spark, d)))


@query(f"""WITH {_EV}, w AS (SELECT obs, least(a, b) lo, greatest(a, b) hi, a, "at", lag(a) OVER p pa, lag("at") OVER p pt FROM ev WHERE a <> b WINDOW p AS (PARTITION BY least(a, b), greatest(a, b) ORDER BY "at", obs))
SELECT lo, hi, obs, CAST("at" - pt AS BIGINT) gap_days FROM w WHERE pa IS NOT NULL AND pa <> a""")
def switch_gaps(spark, d):
    return panel.switch_gaps(_events(spark, d), "at", "obs")


@query(f"""WITH {_EV}, w AS (SELECT obs, least(a, b) lo, greatest(a, b) hi, a, "at", lag(a) OVER p pa, lag("at") OVER p pt FROM ev WHERE a <> b WINDOW p AS (PARTITION BY least(a, b), greatest(a, b) ORDER BY "at", obs)),
g AS (SELECT CAST("at" - pt AS BIGINT) gap FROM w WHERE pa IS NOT NULL AND pa <> a)
SELECT count(*) n, median(gap) median_gap, round(avg(CASE WHEN gap <= 30 THEN 1.0 ELSE 0.0 END), 6) within_30, round(avg(CASE WHEN gap <= 90 THEN 1.0 ELSE 0.0 END), 6) within_90, round(avg(CASE WHEN gap <= 365 THEN 1.0 ELSE 0.0 END), 6) within_365,
CASE WHEN count(*) >= 1000 THEN 'STRONG' WHEN count(*) >= 200 THEN 'MODERATE' ELSE 'WEAK' END verdict FROM g""")
def retaliation_feasibility(spark, d):
    g = panel.switch_gaps(_events(spark, d), "at", "obs")
    n = F.count(F.lit(1))
    share = lambda w: F.round(F.avg((F.col("gap_days") <= w).cast("double")), 6).alias(f"within_{w}")
    return g.agg(n.alias("n"), F.median("gap_days").alias("median_gap"), share(30), share(90), share(365), F.when(n >= 1000, "STRONG").when(n >= 200, "MODERATE").otherwise("WEAK").alias("verdict"))


_SETS = f"""{_EV}, t AS (SELECT a, cand, row_number() OVER (PARTITION BY a ORDER BY (((12345 * 1103 + a * 7919 + 101) % 1000003) * 1103 + cand * 7919 + 101) % 1000003, cand) - 1 pos, count(*) OVER (PARTITION BY a) k FROM (SELECT DISTINCT a, b cand FROM ev)),
e AS (SELECT ev.*, t.pos own, k FROM ev JOIN t ON ev.a = t.a AND ev.b = t.cand WHERE k >= 2),
x AS (SELECT e.*, (((12345 * 1103 + obs * 7919 + 101) % 1000003) % (k - 1) + j) % (k - 1) o FROM e, range(10) r(j) WHERE j < least(10, k - 1)),
s AS (SELECT obs, a, b cand, "at", 1 chosen FROM e UNION ALL SELECT x.obs, x.a, t.cand, x."at", 0 FROM x JOIN t ON x.a = t.a AND t.pos = x.o + CASE WHEN x.o >= x.own THEN 1 ELSE 0 END),
cs AS (SELECT obs, a, cand, chosen, CASE WHEN EXISTS (SELECT 1 FROM ev x WHERE x.a = s.cand AND x.b = s.a AND x."at" < s."at" AND x."at" >= s."at" - 30) THEN 1 ELSE 0 END provoked FROM s)"""


@query(f"WITH {_SETS} SELECT * FROM cs")
def choice_sets(spark, d):
    return panel.choice_sets(_events(spark, d))


@query(f"WITH {_SETS} SELECT obs, a, cand, chosen, provoked FROM (SELECT *, min(provoked) OVER (PARTITION BY obs) lo, max(provoked) OVER (PARTITION BY obs) hi FROM cs) WHERE lo <> hi")
def informative_strata(spark, d):
    return panel.informative(panel.choice_sets(_events(spark, d)))


@query(f"WITH {_SETS} SELECT chosen, count(*) n, round(avg(provoked), 6) share FROM cs GROUP BY 1")
def choice_descriptive(spark, d):
    return panel.choice_sets(_events(spark, d)).groupBy("chosen").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("provoked"), 6).alias("share"))


@query("""SELECT id, CASE WHEN target_type IN ('person','political_party','government','administration','public_institution','media','social_group','international_org','foreign_country_or_govt','other') THEN target_type ELSE 'unclear_or_none' END target_type,
CASE WHEN target_type IN ('person','political_party','government','administration','public_institution','media','social_group','international_org','foreign_country_or_govt','other') THEN substr(coalesce(target_text, ''), 1, 300) ELSE '' END target_text FROM accusations""")
def validate_targets(spark, d):
    return infer.validate_targets(read(spark, d, "accusations", "id", "target_type", "target_text"))


@query("SELECT id, CASE WHEN regexp_matches(lower(coalesce(sentence, '')), 'lie|lying|liar|untrue|half-truths') THEN 'LABEL_1' ELSE 'LABEL_0' END lie_label FROM accusations")
def classify_sentences(spark, d):
    """The sentence-classifier stage with its stand-in model."""
    return infer.run_stage(read(spark, d, "accusations", "id", "sentence"), infer.stub_classifier("sentence"), "lie_label string, lie_score double").select("id", "lie_label")


@query("""SELECT source_dataset, id, date FROM accusations WHERE source_dataset IN ('FloorRec-DE', 'HouseRoll-GB') AND regexp_matches(date, '^[0-9]{4}') AND CAST(substr(date, 1, 4) AS INTEGER) < CASE source_dataset WHEN 'FloorRec-DE' THEN 2010 ELSE 2005 END
UNION ALL SELECT source_dataset, id, date FROM accusations WHERE source_dataset NOT IN ('FloorRec-DE', 'HouseRoll-GB')""")
def union_overlap_cutoff(spark, d):
    """Two sources end where another corpus takes over; the others stay whole."""
    from ..sources.readers import before_cutoffs

    cut = spark.createDataFrame([("FloorRec-DE", 2010), ("HouseRoll-GB", 2005)], "source_dataset string, cutoff_year int")
    return before_cutoffs(read(spark, d, "accusations", "source_dataset", "id", "date").filter("source_dataset IS NOT NULL"), cut)


@query("""SELECT source_dataset, count(*) n, round(avg(CASE WHEN resolved_speaker_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) rate FROM accusations WHERE target_type = 'person' GROUP BY 1""")
def resolution_rate(spark, d):
    a = read(spark, d, "accusations", "source_dataset", "target_type", "resolved_speaker_id").filter("target_type = 'person'")
    return a.groupBy("source_dataset").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("resolved_speaker_id").isNotNull().cast("double")), 6).alias("rate"))


@query("""WITH p AS (SELECT DISTINCT id, speaker, country, is_interjection, accuser_speaker FROM accusations) SELECT id, CASE WHEN is_interjection = 1 AND accuser_speaker IS NOT NULL AND accuser_speaker <> '' THEN accuser_speaker ELSE speaker END accuser FROM p""")
def accuser_identity(spark, d):
    a = read(spark, d, "accusations", "id", "speaker", "is_interjection", "accuser_speaker")
    hit = (F.col("is_interjection") == 1) & (F.coalesce("accuser_speaker", F.lit("")) != "")
    return a.select("id", F.when(hit, F.col("accuser_speaker")).otherwise(F.col("speaker")).alias("accuser"))


