"""Blocked entity resolution of typed names: exact, in period, contained, fuzzy, with margins; distinct keys first, joined back after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T

#: The prefix of an interjection, a name of up to five words before a colon; the first must be a name, particles may follow.
INTERJECTION = r"^([A-ZÄÖÜ][A-Za-zÄÖÜäöüß.'\-]*(?:\s+(?:[A-ZÄÖÜ][A-Za-zÄÖÜäöüß.'\-]*|von|van|de|der|den|zu|di|da)){0,4}):\s"
#: Least similarities and leads on the next.
PERSON_RATIO, PERSON_MARGIN = 0.82, 0.05
PARTY_RATIO, PARTY_MARGIN, CONTAINS_MARGIN = 0.88, 0.04, 0.15
#: Fixed value: similar persons that a chooser is given at most.
MAX_CANDIDATES = 6


def in_period(at: Column, low: Column, high: Column) -> Column:
    """Whether a date lies in a period; it counts as inside if the date or either bound is missing or empty."""
    gone = lambda c: c.isNull() | (c == "")
    return gone(at) | gone(low) | gone(high) | ((F.substring(low, 1, 10) <= at) & (at <= F.substring(high, 1, 10)))


#: Letters by how rare they are in European texts, rarest first; others are rarer still. Any order gives the same pairs.
_RARE = "zqxjkvbpygfwmucldrhsnioate"


def _bag(w: Column) -> Column:
    """A word's letters numbered by their repetitions, the rarest first."""
    letters = F.array_sort(F.split(w, ""))
    numbered = F.transform(letters, lambda c, i: F.concat(c, (i - F.array_position(letters, c) + 1).cast("string")))
    rank = lambda t: F.instr(F.lit(_RARE), F.substring(t, 1, 1))
    return F.transform(F.array_sort(F.transform(numbered, lambda t: F.struct(rank(t).alias("r"), t.alias("t")))), lambda x: x["t"])


def similar_pairs(left: DataFrame, right: DataFrame, block: list[str], a: str, b: str, least: float) -> DataFrame:
    """Distinct pairs of words of a block with a similarity of ``least`` or more, and their ``score``.

    A similarity of s takes s/2 of both words' letters together in common. So of the letters in one fixed order, rare ones first, pairs share
    one among the first few of each: an equi-join on these finds all pairs without meeting every word of the block with every other.
    """
    # with t common letters of n, one lies among the first n - t + 1; the partner has at least n * least / (2 - least) letters
    first = lambda n: n - F.ceil(F.lit(least / 2) * (n + F.ceil(n * F.lit(least / (2 - least)) - 1e-9)) - 1e-9) + 1
    keyed = lambda d, c: d.select(*block, c).filter(F.col(c) != "").distinct().withColumn("__k", F.explode(F.slice(_bag(F.col(c)), F.lit(1), F.greatest(F.lit(1), first(F.length(c))).cast("int"))))
    pairs = keyed(left, a).join(keyed(right, b), [*block, "__k"]).filter((F.col(a) != F.col(b)) & (T.ratio_bound(F.col(a), F.col(b)) >= least)).select(*block, a, b).distinct()
    common = F.size(F.array_intersect(_bag(F.col(a)), _bag(F.col(b))))
    pairs = pairs.filter(2.0 * common >= F.lit(least) * (F.length(a) + F.length(b)) - 1e-9)
    return pairs.withColumn("score", T.ratio(a, b)).filter(F.col("score") >= least)


def match_surnames(queries: DataFrame, people: DataFrame, fuzzy: bool = True) -> DataFrame:
    """``qid, status, method, speaker_id, name, n_candidates`` of each query (``qid, country, source_dataset, surname, at``).

    ``people``: ``speaker_id, name, country, source_dataset, surname, min_date, max_date``. Same surname in the same country and dataset
    and in period: one is ``resolved/exact``, several ``ambiguous/exact``. Without any, the best similarity of 0.82 or more that
    leads the next person by 0.05 is ``resolved/fuzzy``, else ``ambiguous/fuzzy``; none is ``unresolved``, no surname ``no_surname``.
    """
    block = ["country", "source_dataset"]
    exact = queries.join(people, [*block, "surname"]).filter((F.col("surname") != "") & in_period(F.col("at"), F.col("min_date"), F.col("max_date")))
    exact = exact.groupBy("qid").agg(F.count(F.lit(1)).alias("n_exact"), F.min(F.struct("speaker_id", "name")).alias("e"))
    out = queries.join(exact, "qid", "left")
    if fuzzy:
        lost = out.filter(F.col("n_exact").isNull() & (F.col("surname") != "")).select("qid", *block, F.col("surname").alias("q"), "at")
        pairs = similar_pairs(lost, people, block, "q", "surname", PERSON_RATIO)
        cand = lost.join(pairs, [*block, "q"]).join(people, [*block, "surname"]).filter(in_period(F.col("at"), F.col("min_date"), F.col("max_date")))
        # the best two are enough: the lead is on the next person
        best = cand.groupBy("qid").agg(F.max_by(F.struct("speaker_id", "name"), F.struct("score", F.col("speaker_id"))).alias("f"), F.max("score").alias("s1"), F.count(F.lit(1)).alias("n_fuzzy"))
        rival = cand.join(best.select("qid", F.col("f.speaker_id").alias("__b")), "qid").filter(F.col("speaker_id") != F.col("__b")).groupBy("qid").agg(F.max("score").alias("s2"))
        best = best.join(rival, "qid", "left").select("qid", "n_fuzzy", (F.col("s2").isNull() | (F.col("s1") - F.col("s2") >= PERSON_MARGIN)).alias("clear"), "f")
        out = out.join(best, "qid", "left")
    else:
        out = out.withColumns({"n_fuzzy": F.lit(None).cast("bigint"), "clear": F.lit(False), "f": F.col("e")})
    status = (
        F.when(F.col("surname") == "", "no_surname").when(F.col("n_exact") == 1, "resolved").when(F.col("n_exact") > 1, "ambiguous")
        .when(F.col("clear"), "resolved").when(F.col("n_fuzzy") > 0, "ambiguous").otherwise("unresolved")
    )
    method = F.when(F.col("n_exact") > 0, "exact").when(F.col("n_fuzzy") > 0, "fuzzy")
    who = F.when(F.col("n_exact") == 1, F.col("e")).when(F.col("n_exact").isNull() & F.col("clear"), F.col("f"))
    return out.select("qid", status.alias("status"), method.alias("method"), who["speaker_id"].alias("speaker_id"), who["name"].alias("name"), F.coalesce("n_exact", "n_fuzzy", F.lit(0)).cast("bigint").alias("n_candidates"))


def people_of(speakers: DataFrame) -> DataFrame:
    return speakers.select("speaker_id", F.col("name_cleaned").alias("name"), "country", "source_dataset", T.surname(F.col("name_cleaned")).alias("surname"), "min_date", "max_date")


def attribute_interjections(accusations: DataFrame, speakers: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Accusations that begin with ``Name: ``: the interjector, the resolution of who that is, and the host speaker as the target."""
    hits = accusations.withColumn("interjector", F.regexp_extract("sentence", INTERJECTION, 1)).filter("interjector <> ''")
    q = hits.select(F.col("id").alias("qid"), "country", "source_dataset", T.surname(F.col("interjector")).alias("surname"), F.substring("date", 1, 10).alias("at"))
    m = match_surnames(q, people_of(speakers), fuzzy).withColumnRenamed("qid", "id")
    return hits.select("id", "interjector", F.col("speaker").alias("target_text")).join(m, "id").withColumns({"target_type": F.lit("person"), "target_status": F.lit("success")})


def recode_roles(accusations: DataFrame) -> DataFrame:
    """Person-typed targets that are a government office become a government target without resolution."""
    role = (F.col("target_status") == "success") & (F.col("target_type") == "person") & F.coalesce(F.col("target_text").rlike(T.GOVERNMENT_ROLES), F.lit(False))
    keep = lambda c: F.when(role, F.lit(None)).otherwise(F.col(c)).alias(c)
    return accusations.select("id", "target_text", F.when(role, "government").otherwise(F.col("target_type")).alias("target_type"), F.when(role, "not_applicable").otherwise(F.col("resolve_status")).alias("resolve_status"), keep("resolved_speaker_id"), keep("resolved_name"))


def resolve_targets(accusations: DataFrame, speakers: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Pending person targets that aren't interjections, matched to speakers by surname and period; several of the name, and those only similar (the
    best MAX_CANDIDATES), are left to a chooser stage."""
    todo = accusations.filter("target_type = 'person' AND target_status = 'success' AND coalesce(is_interjection, 0) = 0 AND resolve_status = 'pending'")
    q = todo.select(F.col("id").alias("qid"), "country", "source_dataset", T.surname(F.col("target_text")).alias("surname"), F.substring("date", 1, 10).alias("at"))
    m = match_surnames(q, people_of(speakers), fuzzy)
    similar, sole = F.col("method") == "fuzzy", F.col("status") == "resolved"
    done = sole & ~F.coalesce(similar, F.lit(False))
    method = F.when(similar, "llm_fuzzy").when(F.col("status") == "ambiguous", "llm_ambiguous").otherwise(F.col("method"))
    status = F.when(done | (F.col("status") == "no_surname"), F.col("status")).otherwise("unresolved")
    n = F.when(similar, F.least("n_candidates", F.lit(MAX_CANDIDATES))).otherwise(F.col("n_candidates")).cast("bigint")
    return m.select(F.col("qid").alias("id"), status.alias("resolve_status"), method.alias("resolve_method"), F.when(done, F.col("speaker_id")).alias("resolved_speaker_id"), F.when(done, F.col("name")).alias("resolved_name"), n.alias("n_candidates"))


#: Two-letter and three-letter codes of the countries.
ISO3 = {
    "AT": "AUT", "AU": "AUS", "BA": "BIH", "BE": "BEL", "BG": "BGR", "CA": "CAN", "CZ": "CZE", "DE": "DEU", "DK": "DNK", "ES": "ESP", "FI": "FIN", "FR": "FRA", "GB": "GBR", "GR": "GRC", "HR": "HRV",
    "HU": "HUN", "IS": "ISL", "IT": "ITA", "LT": "LTU", "LV": "LVA", "NL": "NLD", "NO": "NOR", "NZ": "NZL", "PL": "POL", "PT": "PRT", "RO": "ROU", "RS": "SRB", "SE": "SWE", "SI": "SVN", "SK": "SVK",
    "TR": "TUR", "UA": "UKR", "US": "USA",
}


def iso3(country: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in ISO3.items() for x in pair])[country]


def active(year: Column, first: Column, last: Column) -> Column:
    return year.isNull() | ((first.isNull() | (year >= first - 1)) & (last.isNull() | (year <= last + 2)))


def party_keys(parties: DataFrame) -> DataFrame:
    """``pid, iso3, name, first, last, key`` for every name form of a party, normalised and without stop words, of three letters or more."""
    p = parties.select(F.col("partyfacts_id").alias("pid"), F.col("country").alias("iso3"), F.coalesce("name_english", "name").alias("name"), F.col("year_first").alias("first"), F.col("year_last").alias("last"), F.explode(F.array_distinct(F.array_compact(F.array("name_english", "name", "name_short")))).alias("form"))
    p = p.withColumn("norm", T.normal_form("form"))
    return p.select("pid", "iso3", "name", "first", "last", F.explode(F.array_distinct(F.array("norm", T.content_key(F.col("norm"))))).alias("key")).filter("length(key) >= 3").distinct()


def resolve_parties(accusations: DataFrame, parties: DataFrame) -> DataFrame:
    """``id, target_partyfacts_id, matched_name, match_method, target_bloc`` of each party target.

    Distinct (country, text, year) are matched to the keys of the country's active parties: equal key, else whole-word containment either way
    (score: ratio of lengths), else similarity of 0.88 with a lead of 0.04 on any other party; then joined back.
    """
    acc = accusations.filter("target_type = 'political_party' AND target_status = 'success' AND target_text IS NOT NULL").select("id", iso3(F.col("country")).alias("iso3"), F.col("target_text").alias("text"), T.year_of(F.col("date")).alias("year"))
    q = acc.select("iso3", "text", "year").distinct().withColumn("qid", F.xxhash64("iso3", "text", "year"))
    q = q.withColumn("norm", T.normal_form("text")).withColumn("ck", T.content_key(F.col("norm")))
    keys = party_keys(parties)
    cand = q.join(keys, "iso3")
    live = cand.filter(active(F.col("year"), F.col("first"), F.col("last")))
    ex = live.filter((F.col("key") == F.col("ck")) | (F.col("key") == F.col("norm"))).groupBy("qid").agg(F.count_distinct("pid").alias("n"), F.min(F.struct("pid", "name")).alias("p"))
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    inside = (F.length("key") >= 4) & (F.length("ck") >= 4) & (F.contains(pad(F.col("ck")), pad(F.col("key"))) | F.contains(pad(F.col("key")), pad(F.col("ck"))))
    sc = F.least(F.length("key"), F.length("ck")) / F.greatest(F.length("key"), F.length("ck"))
    co = live.join(ex.select("qid"), "qid", "left_anti").filter(inside).groupBy("qid", "pid", "name").agg(F.max(sc).alias("s"))
    w = W.partitionBy("qid").orderBy(F.desc("s"), F.desc("pid"), F.desc("name"))
    co = co.withColumns({"r": F.row_number().over(w), "next": F.lead("s").over(w)}).filter("r = 1").select("qid", (F.col("next").isNull() | (F.col("s") - F.col("next") >= CONTAINS_MARGIN)).alias("clear"), F.struct("pid", "name").alias("p"))
    fz = live.join(ex.select("qid"), "qid", "left_anti").join(co.select("qid"), "qid", "left_anti").filter((F.length("key") >= 4) & (F.length("ck") >= 4) & (T.ratio_bound(F.col("ck"), F.col("key")) >= PARTY_RATIO - PARTY_MARGIN))
    # rivals below the least similarity count too, as far as the lead reaches
    fz = fz.withColumn("s", T.ratio("ck", "key")).filter(F.col("s") > PARTY_RATIO - PARTY_MARGIN).groupBy("qid", "pid", "name").agg(F.max("s").alias("s"))
    fz = fz.withColumns({"r": F.row_number().over(w), "next": F.lead("s").over(w)}).filter(f"r = 1 AND s >= {PARTY_RATIO}").select("qid", (F.col("next").isNull() | (F.col("s") - F.col("next") >= PARTY_MARGIN)).alias("clear"), F.struct("pid", "name").alias("p"))
    res = (
        q.select("qid", "iso3", "text", "year")
        .join(ex.select("qid", F.col("n").alias("ne"), F.col("p").alias("pe")), "qid", "left")
        .join(co.select("qid", F.col("clear").alias("cc"), F.col("p").alias("pc")), "qid", "left")
        .join(fz.select("qid", F.col("clear").alias("cf"), F.col("p").alias("pf")), "qid", "left")
        .join(cand.groupBy("qid").agg(F.max(active(F.col("year"), F.col("first"), F.col("last"))).alias("any_live")), "qid", "left")
    )
    method = (
        F.when(F.col("any_live").isNull(), "no_candidates").when(~F.col("any_live"), "no_active_party").when(F.col("ne") == 1, "exact").when(F.col("ne") > 1, "ambiguous_exact")
        .when(F.col("cc"), "contains").when(F.col("cc").isNotNull(), "ambiguous_contains").when(F.col("cf"), "fuzzy").when(F.col("cf").isNotNull(), "ambiguous_fuzzy").otherwise("unresolved")
    )
    res = res.withColumn("match_method", method).withColumn("p", F.when(F.col("match_method") == "exact", F.col("pe")).when(F.col("match_method") == "contains", F.col("pc")).when(F.col("match_method") == "fuzzy", F.col("pf")))
    res = res.select(F.col("iso3").alias("i"), F.col("text").alias("t"), F.col("year").alias("y"), F.col("p.pid").alias("target_partyfacts_id"), F.col("p.name").alias("matched_name"), "match_method")
    joined = acc.join(res, F.col("iso3").eqNullSafe(F.col("i")) & (F.col("text") == F.col("t")) & F.col("year").eqNullSafe(F.col("y")))
    return joined.select("id", F.col("target_partyfacts_id").cast("bigint").alias("target_partyfacts_id"), "matched_name", "match_method", F.when(F.col("target_partyfacts_id").isNull(), T.bloc(F.col("text"))).alias("target_bloc"))


def parse_member(c: Column, states: Column) -> Column:
    """``last, state`` of a US transcript speaker: inside of brackets, titles off (a space or dot must follow), ``of STATE`` by a map of names."""
    inner = F.when(F.regexp_extract(c, r"\(([^)]+)\)", 1) != "", F.regexp_extract(c, r"\(([^)]+)\)", 1)).otherwise(c)
    t = F.trim(F.regexp_replace(inner, r"^(?i:the\s+)?(?i:mr|mrs|ms|miss|dr|hon|senator|representative)[.\s]+", ""))
    st = F.upper(F.regexp_extract(t, r"(?i)\sof\s+(.+?)\.?$", 1))
    last = F.upper(F.element_at(F.split(F.regexp_replace(t, r"(?i)\sof\s+.+$", ""), r"\s+"), -1))
    last = F.regexp_replace(last, r"[^A-ZÀ-Þ'-]", "")
    return F.struct(F.when(F.length(last) >= 2, last).alias("last"), F.coalesce(states[st], F.substring(st, 1, 2)).alias("state"))


def match_members(queries: DataFrame, members: DataFrame, k: int = 3) -> DataFrame:
    """Up to k members per query (``qid, last, state, y_min, y_max``): by state and years, state, years, then all; ``confident`` if exactly
    one agrees in state and years."""
    c = queries.join(members.withColumnRenamed("state", "m_state"), "last")
    in_state = (F.col("state") != "") & (F.col("state") == F.col("m_state"))
    in_years = (F.col("served_from") <= F.col("y_max")) & (F.col("served_until") >= F.col("y_min"))
    c = c.withColumn("tier", F.when(in_state & in_years, 0).when(in_state, 1).when(in_years, 2).otherwise(3))
    w = W.partitionBy("qid")
    c = c.withColumns({"rank": F.row_number().over(w.orderBy("tier", "member_id")), "top": F.sum((F.col("tier") == 0).cast("int")).over(w)})
    return c.filter(F.col("rank") <= k).select("qid", "member_id", "rank", "tier", ((F.col("top") == 1) & (F.col("tier") == 0)).alias("confident"))
