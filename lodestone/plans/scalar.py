"""Scalar functions, parsing and validation over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import enrich
from .tables import read, register

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)


@query("SELECT id, trim(regexp_replace(sentence, '\\s+', ' ', 'g')) clean, regexp_replace(sentence, '[\\x00-\\x08\\x0a-\\x1f]', '', 'g') stripped FROM accusations")
def collapse_whitespace(spark, d):
    a = read(spark, d, "accusations", "id", "sentence")
    return a.select("id", T.collapse_ws(F.col("sentence")).alias("clean"), T.strip_controls(F.col("sentence")).alias("stripped"))


@query("""WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: len(string_split(s, ' ')) >= 3)) s FROM documents)
SELECT doc_id, count(*) n_sentences, CAST(sum(length(s)) AS BIGINT) n_chars FROM p GROUP BY 1""")
def sentence_split(spark, d):
    x = read(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("s")).alias("n_chars"))


@query("""SELECT source_file, CASE WHEN contains(source_file, '_') THEN string_split(source_file, '_')[1] ELSE source_file END prefix, regexp_extract(source_file, '\\.([a-z]+)$', 1) ext, count(*) n FROM accusations WHERE source_file IS NOT NULL GROUP BY 1""")
def file_parts(spark, d):
    g = read(spark, d, "accusations", "source_file").filter("source_file IS NOT NULL").groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
    return g.select("source_file", F.split("source_file", "_", 2)[0].alias("prefix"), F.regexp_extract("source_file", r"\.([a-z]+)$", 1).alias("ext"), "n")


@query("SELECT speaker_id, sha1(concat_ws('|', name_cleaned, country, source_dataset)) AS computed_id FROM speakers")
def person_ids(spark, d):
    s = read(spark, d, "speakers", "speaker_id", "name_cleaned", "country", "source_dataset")
    return s.select("speaker_id", T.person_id(F.col("name_cleaned"), F.col("country"), F.col("source_dataset")).alias("computed_id"))


@query("""WITH u AS (SELECT id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host FROM speaker_urls)
SELECT id, host, host = 'members-lens.gov.example' OR ends_with(host, '.members-lens.gov.example') AS blocked FROM u""")
def url_hosts(spark, d):
    u = read(spark, d, "speaker_urls", "id", "url")
    return u.select("id", T.host(F.col("url")).alias("host"), T.blacklisted(F.col("url"), ("members-lens.gov.example",)).alias("blocked"))


@query("""SELECT id, target_text, regexp_matches(target_text, '(?i)(minister|chancellor|kanzler|staatssekret|secretary of state|state secretary)') AS is_role,
CASE WHEN regexp_matches(target_text, '(?i)\\b(the )?opposition\\b|those opposite|\\bother side\\b|opposite benches?') THEN 'opposition' WHEN regexp_matches(target_text, '(?i)\\b(the )?government\\b|treasury benches?|\\bcabinet\\b') THEN 'government'
WHEN regexp_matches(target_text, '(?i)\\bthe left\\b|\\bleft wing\\b|\\bleftists?\\b') THEN 'left' WHEN regexp_matches(target_text, '(?i)\\bthe right\\b|\\bright wing\\b|\\brightists?\\b') THEN 'right' END AS bloc FROM accusations WHERE target_text IS NOT NULL""")
def bloc_and_role(spark, d):
    a = read(spark, d, "accusations", "id", "target_text").filter("target_text IS NOT NULL")
    return a.select("id", "target_text", F.col("target_text").rlike(T.GOVERNMENT_ROLES).alias("is_role"), T.bloc(F.col("target_text")).alias("bloc"))


@query("""WITH n AS (SELECT partyfacts_id, trim(regexp_replace(regexp_replace(lower(strip_accents(name_english)), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) norm FROM partyfacts_core WHERE name_english IS NOT NULL)
SELECT partyfacts_id, norm, array_to_string(list_transform(list_filter(string_split(norm, ' '), lambda w: w NOT IN ('the', 'party', 'parties', 'of', 'and', 'for', 'a', 'an') AND w <> ''),
lambda w: CASE WHEN length(w) > 4 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN w[1:length(w) - 1] ELSE w END), ' ') AS content_key FROM n""")
def party_name_keys(spark, d):
    p = read(spark, d, "partyfacts_core", "partyfacts_id", "name_english").filter("name_english IS NOT NULL").withColumn("norm", T.normal_form("name_english"))
    return p.select("partyfacts_id", "norm", T.content_key(F.col("norm")).alias("content_key"))


@query("""WITH j AS (SELECT speaker_id, group_name, annotation_json FROM speaker_annotations WHERE status = 'success' AND annotation_json IS NOT NULL)
SELECT speaker_id, lower(max(CASE WHEN group_name = 'A' THEN json_extract_string(annotation_json, '$.gender') END)) gender, max(CASE WHEN group_name = 'A' THEN TRY_CAST(json_extract_string(annotation_json, '$.birth_year') AS INTEGER) END) birth_year,
max(CASE WHEN group_name = 'B' THEN CAST(json_array_length(annotation_json, '$.parties') AS INTEGER) END) n_parties,
max(CASE WHEN group_name = 'C' THEN list_max(list_filter(list_transform(CAST(json_extract(annotation_json, '$.education[*].isced_level') AS VARCHAR[]), lambda x: TRY_CAST(x AS INTEGER)), lambda x: x BETWEEN 5 AND 8)) END) highest_isced,
coalesce(max(CASE WHEN group_name = 'D' THEN array_to_string(list_sort(list_distinct(list_filter(list_transform(CAST(json_extract(annotation_json, '$.sectors') AS VARCHAR[]), lambda x: TRY_CAST(x AS INTEGER)), lambda x: x BETWEEN 1 AND 8))), ',') END), '') career_sectors
FROM j GROUP BY 1""")
def json_extract_validate(spark, d):
    a = enrich.annotations(read(spark, d, "speaker_annotations", "speaker_id", "group_name", "annotation_json", "status"))
    return a.select("speaker_id", "gender", "birth_year", F.size("parties").alias("n_parties"), "highest_isced", F.coalesce("career_sectors", F.lit("")).alias("career_sectors")).withColumn("n_parties", F.when(F.col("n_parties") >= 0, F.col("n_parties")))


@query("""SELECT id, date, CASE WHEN regexp_matches(date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN TRY_CAST(date AS DATE) WHEN regexp_matches(date, '^[0-9]{8}$') THEN TRY_CAST(substr(date, 1, 4) || '-' || substr(date, 5, 2) || '-' || substr(date, 7, 2) AS DATE)
WHEN regexp_matches(date, '^[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}$') THEN TRY_CAST(substr(date, 7, 4) || '-' || substr(date, 4, 2) || '-' || substr(date, 1, 2) AS DATE) END AS day FROM accusations""")
def parse_dates(spark, d):
    a, c = read(spark, d, "accusations", "id", "date"), F.col("date")
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date")).when(c.rlike(r"^\d{8}$"), F.to_date(F.try_to_timestamp(c, F.lit("yyyyMMdd")))).when(c.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), F.to_date(F.try_to_timestamp(c, F.lit("dd.MM.yyyy"))))
    return a.select("id", "date", iso.alias("day"))


@query("""WITH p AS (SELECT country, partyfacts_id, year_first, year_last, coalesce(name_english, name) AS label, coalesce(name_short, '') AS short FROM partyfacts_core WHERE coalesce(technical, false) = false AND (year_last IS NULL OR year_last >= 1990))
SELECT country, count(*) n_parties, string_agg(partyfacts_id || ': ' || label || CASE WHEN short <> '' THEN ' (' || short || ')' ELSE '' END || ' [' || coalesce(CAST(CAST(year_first AS INTEGER) AS VARCHAR), '?') || '–' || coalesce(CAST(CAST(year_last AS INTEGER) AS VARCHAR), '') || ']', chr(10) ORDER BY coalesce(year_first, 9999), partyfacts_id) AS prompt_block FROM p GROUP BY 1""")
def party_prompt_blocks(spark, d):
    p = read(spark, d, "partyfacts_core").filter("coalesce(technical, false) = false AND (year_last IS NULL OR year_last >= 1990)")
    short = F.coalesce("name_short", F.lit(""))
    line = F.concat(F.col("partyfacts_id").cast("string"), F.lit(": "), F.coalesce("name_english", "name"), F.when(short != "", F.concat(F.lit(" ("), short, F.lit(")"))).otherwise(""), F.lit(" ["), F.coalesce(F.col("year_first").cast("int").cast("string"), F.lit("?")), F.lit("–"), F.coalesce(F.col("year_last").cast("int").cast("string"), F.lit("")), F.lit("]"))
    order = F.struct(F.coalesce("year_first", F.lit(9999.0)).alias("y"), F.col("partyfacts_id").alias("i"), line.alias("line"))
    return p.groupBy("country").agg(F.count(F.lit(1)).alias("n_parties"), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["line"]), "\n").alias("prompt_block"))


@query("""SELECT id, CASE WHEN speaker = upper(speaker) AND length(speaker) > 1 THEN 1 ELSE 0 END all_caps, array_to_string(list_transform(string_split(trim(regexp_replace(speaker, '\\s+', ' ', 'g')), ' '),
lambda w: CASE WHEN length(w) > 1 AND w = upper(w) THEN upper(w[1]) || lower(w[2:]) ELSE w END), ' ') AS titled FROM accusations WHERE speaker IS NOT NULL""")
def titlecase_names(spark, d):
    a, c = read(spark, d, "accusations", "id", "speaker").filter("speaker IS NOT NULL"), F.col("speaker")
    return a.select("id", F.when((c == F.upper(c)) & (F.length(c) > 1), 1).otherwise(0).alias("all_caps"), T.titlecase_caps(c).alias("titled"))


@query()
def text_budgets(spark, d):
    """Texts cut to a UTF-8 byte budget at a character."""
    x = read(spark, d, "documents", "doc_id", "text")
    return x.select("doc_id", T.utf8_budget(F.col("text"), 4000).alias("text"))


@query()
def json_in_prose(spark, d):
    return read(spark, d, "speaker_annotations", "id", "annotation_json").select("id", T.first_json(F.concat(F.lit("Here it is:\n```json\n"), "annotation_json", F.lit("\n```"))).alias("json"))


@query("SELECT speaker_id, url, search_rank, fetch_status FROM speaker_urls WHERE lower(url) LIKE '%members-lens%' OR lower(query_string) LIKE '%members-lens%' ORDER BY id LIMIT 100")
def like_search(spark, d):
    u = read(spark, d, "speaker_urls")
    hit = F.col("url").ilike("%members-lens%") | F.coalesce(F.col("query_string").ilike("%members-lens%"), F.lit(False))
    return u.filter(hit).orderBy("id").limit(100).select("speaker_id", "url", "search_rank", "fetch_status")


@query("""WITH o AS (SELECT id, speaker_id, octet_length(encode(synthesis_text)) b, search_rank, synthesis_text FROM speaker_urls WHERE synthesis_text IS NOT NULL),
r AS (SELECT speaker_id, id, b, sum(b) OVER (PARTITION BY speaker_id ORDER BY coalesce(search_rank, 999), id) run, row_number() OVER (PARTITION BY speaker_id ORDER BY coalesce(search_rank, 999), id) rn FROM o)
SELECT speaker_id, count(*) n_kept, CAST(sum(b) AS BIGINT) bytes FROM r WHERE rn = 1 OR run <= 1500 GROUP BY 1""")
def snippet_packing(spark, d):
    """Snippets in rank order while a byte budget lasts, the first always."""
    from pyspark.sql import Window as W

    u = read(spark, d, "speaker_urls", "id", "speaker_id", "search_rank", "synthesis_text").filter("synthesis_text IS NOT NULL").withColumn("b", F.octet_length("synthesis_text"))
    w = W.partitionBy("speaker_id").orderBy(F.coalesce("search_rank", F.lit(999)), "id")
    u = u.withColumns({"run": F.sum("b").over(w.rowsBetween(W.unboundedPreceding, 0)), "rn": F.row_number().over(w)}).filter("rn = 1 OR run <= 1500")
    return u.groupBy("speaker_id").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("b").alias("bytes"))


@query()
def translation_pieces(spark, d):
    """Documents cut into pieces for translation."""
    x = read(spark, d, "documents", "doc_id", "text", "lang")
    return x.select("doc_id", F.posexplode(T.split_chain("text", F.substring("lang", 1, 2))).alias("pos", "piece"))


@query()
def html_to_text(spark, d):
    """Page texts wrapped as HTML with navigation and read back: the navigation goes, the lines stay."""
    u = read(spark, d, "speaker_urls", "id", "cleaned_text").filter("cleaned_text IS NOT NULL")
    esc = F.replace(F.replace("cleaned_text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<html><body><nav>Home</nav><div class='cookie-banner'>OK</div><main>"), F.array_join(F.transform(F.split(esc, "\n"), lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), ""), F.lit("</main></body></html>"))
    return u.select("id", T.html_text(html).alias("text"))
