"""Readers, writers, names, labels, samples and model checks as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codebooks
from ..functions import text as T
from ..operators import entity, rates, views
from ..session import work_dir
from ..sources import readers, writers
from ..streaming import context as stream
from .tables import read, register

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)


@query("""SELECT speaker_id, CASE WHEN contains(name_cleaned, ',') THEN trim(split_part(name_cleaned, ',', 1)) ELSE trim(name_cleaned) END AS last,
CASE WHEN contains(name_cleaned, ',') THEN trim(substr(name_cleaned, strpos(name_cleaned, ',') + 1)) || ' ' || trim(split_part(name_cleaned, ',', 1)) ELSE trim(name_cleaned) END AS full_name FROM speakers""")
def flip_names(spark, d):
    """"Last, First" turned round."""
    x = T.flip_name(F.col("name_cleaned"))
    return read(spark, d, "speakers").select("speaker_id", x["last"].alias("last"), x["full"].alias("full_name"))


@query("SELECT id, sha1(url) || '.html' file FROM speaker_urls")
def page_files(spark, d):
    return read(spark, d, "speaker_urls", "id", "url").select("id", T.page_file(F.col("url")).alias("file"))


_WIKI = "CASE WHEN id % 2 = 0 THEN 'https://' || CASE WHEN id % 4 = 0 THEN 'de' ELSE 'commons' END || '.wikipedia.org/wiki/' || url_encode(coalesce(query_string, '')) || '?x=1' ELSE url END"


@query(f"""WITH u AS (SELECT id, {_WIKI} w, query_string q FROM speaker_urls) SELECT id, CASE WHEN id % 4 = 0 THEN 'de' END lang, CASE WHEN id % 4 = 0 THEN coalesce(q, '') END title FROM u""")
def wikipedia_pages(spark, d):
    """Language and decoded title of addresses that are Wikipedia articles."""
    u = read(spark, d, "speaker_urls", "id", "url", "query_string")
    lang = F.when(F.col("id") % 4 == 0, "de").otherwise("commons")
    enc = F.replace(F.url_encode(F.coalesce("query_string", F.lit(""))), F.lit("+"), F.lit("%20"))
    url = F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/wiki/"), enc, F.lit("?x=1"))).otherwise(F.col("url"))
    w = T.wikipedia(url)
    return u.select("id", w["lang"].alias("lang"), w["title"].alias("title"))


_SECTOR = ", ".join(f"({k}, '{v}')" for k, v in codebooks.SECTOR.items())


@query(f"""WITH lab(code, label) AS (VALUES {_SECTOR}), x AS (SELECT speaker_id, unnest(CAST(json_extract(annotation_json, '$.sectors[*]') AS JSON[])) s FROM speaker_annotations WHERE group_name = 'D' AND status = 'success' AND annotation_json IS NOT NULL)
SELECT speaker_id, label FROM (SELECT DISTINCT speaker_id, TRY_CAST(json_extract_string(s, '$') AS INTEGER) code FROM x) JOIN lab USING (code)""")
def sector_labels(spark, d):
    """Career sectors spelled out, one row per speaker and sector."""
    from ..operators.enrich import annotations

    a = annotations(read(spark, d, "speaker_annotations")).select("speaker_id", F.explode(codebooks.sectors_to_labels(F.col("career_sectors"))).alias("label"))
    return a


@query("SELECT id, source_dataset FROM accusations ORDER BY ((id % 1000003) * 7919 + 42 * 1103 + 101) % 1000003, id LIMIT 500")
def seeded_sample(spark, d):
    """500 rows of the whole table, the same on every run."""
    return rates.sample_rows(read(spark, d, "accusations", "id", "source_dataset"), "id", 500)


@query(f"SELECT source_dataset, count(*) n, count(DISTINCT speaker) n_speakers FROM accusations WHERE country NOT IN {codebooks.EXCLUDED_COUNTRIES} GROUP BY 1")
def sql_session(spark, d):
    """A query in SQL text over the session's filtered views."""
    s = views.session({"accusations": read(spark, d, "accusations"), "corpus": read(spark, d, "documents")}, codebooks.EXCLUDED_COUNTRIES)
    return s.sql("SELECT source_dataset, count(*) AS n, count(DISTINCT speaker) AS n_speakers FROM {accusations} GROUP BY 1")


@query("SELECT speaker_id, name_cleaned, country, CAST(n_sentences AS VARCHAR) n_sentences FROM speakers")
def csv_round_trip(spark, d):
    """Speakers written as CSV once, read back as text under their aliases."""
    path = f"{work_dir(spark)}/speakers.csv"
    out = read(spark, d, "speakers", "speaker_id", F.col("name_cleaned").alias("Speaker Name"), "country", "n_sentences")
    for _ in range(2):  # the second write finds the first
        writers.write_once(out, path, fmt="csv")
    back = readers.csv_strings(spark, path, readers.header(spark, path))
    return readers.resolve_aliases(back, {"speaker_id": (), "name_cleaned": ("speaker name",), "country": (), "n_sentences": ()})


@query("SELECT country, count(*) n, CAST(sum(n_sentences) AS BIGINT) n_sentences FROM speakers WHERE country IS NOT NULL GROUP BY 1")
def swapped_table(spark, d):
    """Speakers written as a table, replaced by a newer version, read back with the filter pushed down and summed up."""
    path = f"{work_dir(spark)}/speakers"
    s = read(spark, d, "speakers", "country", "n_sentences")
    writers.replace(s.limit(1), path)
    writers.replace(s, path)
    return readers.parquet(spark, path).filter("country IS NOT NULL").groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.sum("n_sentences").cast("bigint").alias("n_sentences"))


@query("SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) row_seq, id FROM accusations")
def rows_in_order(spark, d):
    """Rows numbered in the order they are read."""
    return readers.row_index(read(spark, d, "accusations", "id")).select("row_seq", "id")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) window_start, event_type, count(*) n FROM events GROUP BY 1, 2")
def stream_rates(spark, d):
    """Events read as a stream, counted by day and kind."""
    path, out = work_dir(spark), work_dir(spark)
    schema = read(spark, d, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = stream.rates_by_window(rows)
    counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""WITH q AS (SELECT speaker_id, upper(split_part(name_cleaned, ',', 1)) AS last, country AS state, coalesce(TRY_CAST(substr(min_date, 1, 4) AS INTEGER), 1900) y0, coalesce(TRY_CAST(substr(max_date, 1, 4) AS INTEGER), 2100) y1 FROM speakers WHERE contains(name_cleaned, ',')),
j AS (SELECT q.speaker_id qid, m.speaker_id member_id, CASE WHEN q.state = m.state AND m.y0 <= q.y1 AND m.y1 >= q.y0 THEN 0 WHEN q.state = m.state THEN 1 WHEN m.y0 <= q.y1 AND m.y1 >= q.y0 THEN 2 ELSE 3 END tier FROM q JOIN q m ON q.last = m.last WHERE q.state IS NOT NULL AND m.state IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, member_id) rk, sum(CASE WHEN tier = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid) top FROM j)
SELECT qid, member_id, CAST(rk AS INTEGER) AS rank, CAST(tier AS INTEGER) tier, top = 1 AND tier = 0 confident FROM r WHERE rk <= 3""")
def member_candidates(spark, d):
    """Members of the same last name, by state and years, then state, then years."""
    y = lambda c, e: F.coalesce(F.substring(c, 1, 4).try_cast("int"), F.lit(e))
    s = read(spark, d, "speakers").filter("name_cleaned LIKE '%,%' AND country IS NOT NULL").select("speaker_id", F.upper(F.split("name_cleaned", ",")[0]).alias("last"), F.col("country").alias("state"), y("min_date", 1900).alias("y0"), y("max_date", 2100).alias("y1"))
    q = s.select(F.col("speaker_id").alias("qid"), "last", "state", F.col("y0").alias("y_min"), F.col("y1").alias("y_max"))
    m = s.select(F.col("speaker_id").alias("member_id"), "last", "state", F.col("y0").alias("served_from"), F.col("y1").alias("served_until"))
    return entity.match_members(q, m)


@query("""SELECT round(avg(lie_score) FILTER (regexp_matches(target_text, '(?i)left|socialis')), 6) left_mean, round(avg(lie_score) FILTER (regexp_matches(target_text, '(?i)right|conservative')), 6) right_mean
FROM accusations WHERE lie_score IS NOT NULL AND NOT isnan(lie_score)""")
def polarity(spark, d):
    """Mean score of names that tell a side, to check a scale's direction."""
    a = read(spark, d, "accusations", "target_text", "lie_score").filter("lie_score IS NOT NULL AND NOT isnan(lie_score)")
    side = lambda p, n: F.round(F.avg(F.when(F.col("target_text").rlike(p), F.col("lie_score"))), 6).alias(n)
    return a.agg(side("(?i)left|socialis", "left_mean"), side("(?i)right|conservative", "right_mean"))


@query("SELECT id, CASE WHEN source_dataset_type = 'tei' THEN coalesce(accuser_name, speaker) ELSE trim(regexp_replace(speaker, '\\s+', ' ', 'g')) END display FROM accusations")
def display_names(spark, d):
    a = read(spark, d, "accusations", "id", "speaker", "accuser_name", "source_dataset_type")
    return a.select("id", T.clean_name(F.col("speaker"), F.coalesce("source_dataset_type", F.lit("")), F.col("accuser_name")).alias("display"))
