"""Micro-cases of the core operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import infer
from lodestone.functions import text as T
from lodestone.operators import asof, context, entity, panel, rates, skew, stages
from lodestone.sources import readers, writers
from lodestone.stats import glm
from lodestone.streaming import context as stream


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expr.alias("x")).first().x


# -- context windows ------------------------------------------------------------------------------------------------


def ctx(spark, data, size=8):
    df = spark.createDataFrame(data, "seq bigint, source_file string, speaker string, sentence string, hit boolean")
    return dict(rows(context.preceding_context(df, df.filter("hit"), size=size), "seq", "context"))


def test_context_headers_and_reset(spark):
    d = [(0, "f1", "A", "One two three.", False), (1, "f1", "A", "Four five six.", False), (2, "f1", "B", "That is a lie.", True), (3, "f2", "", "x", True)]
    got = ctx(spark, d)
    assert got[2] == "[A]\nOne two three.\nFour five six.\n[B]\n>>> That is a lie."
    assert got[3] == "[unknown]\n>>> x"


def test_context_same_speaker_and_limit(spark):
    got = ctx(spark, [(0, "f", "A", "One two three.", False), (1, "f", "A", "You lie again.", True)])
    assert got[1] == "[A]\nOne two three.\n>>> You lie again."
    got = ctx(spark, [(i, "f", "A", f"r{i}", i == 9) for i in range(10)])
    assert got[9].split("\n")[1:] == [f"r{i}" for i in range(1, 9)] + [">>> r9"]


def test_context_is_by_run_not_by_file(spark):
    got = ctx(spark, [(0, "f", "A", "old", False), (1, "g", "A", "other", False), (2, "f", "A", "new", True)])
    assert got[2] == "[A]\n>>> new"


def test_dense_index(spark):
    df = spark.createDataFrame([(v,) for v in (50, 7, 1000, 3, 999)], "k bigint")
    assert rows(context.dense_index(df, "k"), "k", "seq") == [(1000, 4), (3, 0), (50, 2), (7, 1), (999, 3)]


# -- text -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name,want", [("Abbott, Tony", "abbott"), ("Federal Minister Dr. Fassleven", "fassleven"), ("the Minister", "minister"), ("Weiß", "weiss"), ("", ""), (None, "")])
def test_surname(spark, name, want):
    assert one(spark, T.surname(F.col("n")), n=name) == want


@pytest.mark.parametrize("text,want", [("the opposition", "opposition"), ("those opposite", "opposition"), ("the cabinet", "government"), ("the left", "left"), ("nobody", None)])
def test_bloc(spark, text, want):
    assert one(spark, T.bloc(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [("Dr. Fekter: That's not true!", "Dr. Fekter"), ("Tichy-Schreder: No!", "Tichy-Schreder"), ("Ursula von der Leyen: Wrong", "Ursula von der Leyen"), ("He wrote: no", ""), ("Mrs Reitsamer said: x", ""), ("Question: is it true?", "Question")])
def test_interjection_prefix(spark, text, want):
    assert one(spark, F.regexp_extract("t", entity.INTERJECTION, 1), t=text) == want


def test_similarity(spark):
    assert round(one(spark, T.ratio("a", "b"), a="novotny", b="nowotny"), 4) == 0.8571
    assert round(one(spark, T.ratio("a", "b"), a="applebeck", b="apfelbeck"), 4) == 0.7778


def test_person_id(spark):
    assert one(spark, T.person_id(F.col("a"), F.col("b"), F.col("c")), a="Maria Fekter", b="AT", c="ParlaMint-AT") == "18f4385c9e58d0c063080423b335c66f670f7b4f"


def test_content_key_and_codes(spark):
    assert one(spark, T.content_key(T.normal_form("n")), n="the People's Party") == "people s"
    assert one(spark, T.valid_codes(F.split("c", ","), 1, 8), c="4,9,4,x,1") == [1, 4]


def test_sentences_and_json(spark):
    assert one(spark, T.sentences(F.col("t")), t="That's a lie! No. He knows it well.") == ["That's a lie!", "He knows it well."]
    assert one(spark, T.first_json("t"), t='Sure:\n```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.first_json("t"), t="so [1, 2] it is") == "[1, 2]"
    assert one(spark, T.first_json("t"), t="") is None


def test_blacklist(spark):
    assert one(spark, T.blacklisted(F.col("u")), u="https://m.facebook.com/x") is True
    assert one(spark, T.blacklisted(F.col("u")), u="https://notfacebook.com/x") is False


def test_titlecase_budget(spark):
    assert one(spark, T.titlecase_caps(F.col("n")), n="ANNA B  Smith") == "Anna B Smith"
    assert one(spark, T.utf8_budget(F.col("n"), 3), n="aéé") == "aé"


def test_member_names(spark):
    states = F.create_map(F.lit("MICHIGAN"), F.lit("MI"))
    assert tuple(one(spark, entity.parse_member(F.col("n"), states), n="Mr. COLLINS of Michigan")) == ("COLLINS", "MI")
    assert tuple(one(spark, entity.parse_member(F.col("n"), states), n="The SPEAKER pro tempore (Mr. Hastert)")) == ("HASTERT", "")
    assert tuple(one(spark, entity.parse_member(F.col("n"), states), n="Mr. DREIER")) == ("DREIER", "")


def test_member_match(spark):
    m = spark.createDataFrame([("a", "LEE", "CA", 1990, 2000), ("b", "LEE", "NY", 1990, 2000), ("c", "LEE", "CA", 1950, 1960)], "member_id string, last string, state string, served_from int, served_until int")
    q = spark.createDataFrame([(1, "LEE", "CA", 1995, 1996)], "qid int, last string, state string, y_min int, y_max int")
    assert rows(entity.match_members(q, m), "rank", "member_id", "confident") == [(1, "a", True), (2, "c", False), (3, "b", False)]


# -- entities -------------------------------------------------------------------------------------------------------


def people(spark, data):
    return spark.createDataFrame(data, "speaker_id string, name string, country string, source_dataset string, surname string, min_date string, max_date string")


def match(spark, surname, at, data):
    q = spark.createDataFrame([(1, "AT", "d", surname, at)], "qid int, country string, source_dataset string, surname string, at string")
    r = entity.match_surnames(q, people(spark, data)).first()
    return r.status, r.method, r.speaker_id


def test_period_and_ambiguity(spark):
    two = [("1", "A Maier", "AT", "d", "maier", "1990-01-01", "1995-01-01"), ("2", "B Maier", "AT", "d", "maier", "2000-01-01", "2005-01-01")]
    assert match(spark, "maier", "2001-01-01", two) == ("resolved", "exact", "2")
    assert match(spark, "maier", None, two)[:2] == ("ambiguous", "exact")
    assert match(spark, "maier", "1980-01-01", [(*two[0][:5], "", "1995-01-01")]) == ("resolved", "exact", "1")
    assert match(spark, "", "2001-01-01", two)[0] == "no_surname"


def test_fuzzy_margin(spark):
    assert match(spark, "nowotny", None, [("1", "A", "AT", "d", "novotny", "", "")]) == ("resolved", "fuzzy", "1")
    assert match(spark, "nowotny", None, [("1", "A", "AT", "d", "novotny", "", ""), ("2", "B", "AT", "d", "novotny", "", "")])[:2] == ("ambiguous", "fuzzy")
    assert match(spark, "applebeck", None, [("1", "A", "AT", "d", "apfelbeck", "", "")])[0] == "unresolved"


def test_party_tiers(spark):
    p = spark.createDataFrame([(1, "AUT", "Oevp", "Austrian People's Party", "OVP", 1945.0, None, False), (2, "AUT", "Neos", "New Forum", "NEO", 2012.0, 2020.0, False)], "partyfacts_id int, country string, name string, name_english string, name_short string, year_first double, year_last double, technical boolean")
    a = spark.createDataFrame([(1, "AT", "Austrian People's Party", "2000-01-01"), (2, "AT", "the People's Party", "2000-01-01"), (3, "AT", "those opposite", "2000-01-01"), (4, "AT", "New Forum", "2000-01-01"), (5, "GR", "x y", "2000-01-01"), (6, "AT", "Neww Forum", "2013-01-01")], "id int, country string, target_text string, date string")
    a = a.withColumns({"target_type": F.lit("political_party"), "target_status": F.lit("success")})
    got = {r.id: (r.match_method, r.target_partyfacts_id, r.target_bloc) for r in entity.resolve_parties(a, p).collect()}
    assert got[1][:2] == ("exact", 1) and got[2][:2] == ("contains", 1) and got[3] == ("unresolved", None, "opposition")
    assert got[4][0] == "unresolved" and got[5][0] == "no_candidates" and got[6][:2] == ("fuzzy", 2)


@pytest.mark.parametrize("year,want", [(1999, True), (2012, True), (1998, False), (2013, False), (None, True)])
def test_active_years(spark, year, want):
    df = spark.createDataFrame([(year, 2000.0, 2010.0)], "y int, f double, l double")
    assert df.select(entity.active(F.col("y"), F.col("f"), F.col("l")).alias("x")).first().x is want


# -- histories ------------------------------------------------------------------------------------------------------


def test_timeline_pick(spark):
    t = spark.createDataFrame([("s", 0, 1990, 2000, "A"), ("s", 1, 2000, None, "B"), ("s", 2, None, None, "C"), ("u", 0, 1990, 2000, "A")], "speaker_id string, pos int, start_year int, end_year int, party string")
    f = spark.createDataFrame([("s", 2000), ("s", 1985), ("u", 2010), ("v", 2000)], "speaker_id string, year int")
    got = {(r.speaker_id, r.year): r.party for r in asof.timeline_pick(f, t, "speaker_id", "year").collect()}
    assert got == {("s", 2000): "B", ("s", 1985): "C", ("u", 2010): "A", ("v", 2000): None}


def test_cabinet_history(spark):
    c = [("2000-01-01", "10", 1), ("2000-01-01", "20", 1), ("2000-01-01", "30", 0), ("2004-01-01", "10", 0), ("2004-01-01", "30", 1), ("2008-01-01", "10", 0), ("2008-01-01", "30", 1), ("2008-01-01", "40", 1), ("2000-01-01", "40", 0), ("2004-01-01", "40", 0)]
    g = asof.years_since_active(spark.createDataFrame(c, "start string, pid string, act int").withColumn("u", F.lit(1)), "u", "pid", "start", "act")
    f = spark.createDataFrame([("10", "2009-01-01"), ("30", "2004-01-01"), ("40", "2005-01-01"), ("10", "1999-01-01")], "pid string, at string")
    j = asof.asof_join(f, g.select("pid", "start", "act", "exited"), ["pid"], "at", "start", ["act", "exited"])
    got = {(r.pid, r.at): (r.act, None if r.exited is None else round((dt.date.fromisoformat(r.at) - dt.date.fromisoformat(r.exited)).days / 365.25, 2)) for r in j.collect()}
    assert got == {("10", "2009-01-01"): (0, 5.0), ("30", "2004-01-01"): (1, None), ("40", "2005-01-01"): (0, None), ("10", "1999-01-01"): (None, None)}


def test_election_history(spark):
    e = spark.createDataFrame([("p", "1999", 20.0), ("p", "2003", 30.0), ("p", "2007", 25.0), ("p", "2011", 40.0)], "party string, day string, share double")
    h = asof.running_history(e, "party", ["day"], "share")
    r = asof.asof_join(spark.createDataFrame([("p", "2008")], "party string, at string"), h, ["party"], "at", "day", ["last", "avg_all", "avg_3", "delta"]).first()
    assert (r["last"], r.avg_all, r.avg_3, r.delta) == (25.0, 25.0, 25.0, -5.0)


def test_asof_or_first(spark):
    h = spark.createDataFrame([("p", "2000", 0.1), ("p", "2004", 0.3)], "k string, day string, v double")
    f = spark.createDataFrame([("p", "1999"), ("p", "2004")], "k string, at string")
    assert rows(asof.asof_join(f, h, ["k"], "at", "day", ["v"], or_first=True), "at", "v") == [("1999", 0.1), ("2004", 0.3)]


def test_party_measures(spark):
    from lodestone.operators import enrich

    keys = spark.createDataFrame([("10", "2009-01-01"), ("30", "2004-01-01"), ("10", "1999-01-01")], "party string, date string")
    el = spark.createDataFrame([("10", "1999-06-01", 20.0), ("10", "2003-01-01", 30.0), ("10", "2007-01-01", 25.0), ("10", "2008-01-01", float("nan"))], "party string, day string, vote_share double")
    cab = spark.createDataFrame([("c", 1, "2000-01-01", "10", 1, 1), ("c", 2, "2004-01-01", "30", 1, 1), ("c", 3, "2008-01-01", "30", 1, 1)], "country string, cabinet int, day string, party string, in_cabinet int, is_pm int")
    sc = spark.createDataFrame([("10", "2000-01-01", 0.1), ("10", "2004-01-01", 0.3)], "party string, day string, populism double")
    got = {(r.party, r.date): (r.vote_share_last, r.vote_share_avg, r.vote_share_delta, r.in_cabinet, r.is_pm, r.years_since_government, r.populism) for r in enrich.party_measures(keys, el, cab, sc, ["populism"]).collect()}
    assert got[("10", "2009-01-01")] == (25.0, 25.0, -5.0, 0, 0, 5.0, 0.3)
    assert got[("30", "2004-01-01")] == (None, None, None, 1, 1, 0.0, None)
    assert got[("10", "1999-01-01")] == (None, None, None, None, None, None, 0.1)


def test_html_and_pieces(spark):
    body = "A long paragraph about the member of parliament and the many offices held over the years. " * 2
    h = f"<html><nav>Home</nav><div id='cookie-bar'>OK <b>x</b></div><h1>Jo &amp; Co</h1><p>{body}<br>next</p><script>var a;</script></html>"
    assert one(spark, T.html_text("h"), h=h) == "Jo & Co\n\n" + body.strip() + "\nnext"
    assert one(spark, T.html_text("h"), h="<p>short</p>") is None
    assert one(spark, T.split_chain("t", F.lit("cs")), t="První věta tady  druhá věta tam") == ["První věta tady", "druhá věta tam"]
    assert one(spark, T.split_chain("t", F.lit("de")), t="Ein Satz. Noch einer!") == ["Ein Satz.", "Noch einer!"]
    long = one(spark, T.split_chain("t", F.lit("de")), t="wort " * 300)
    assert len(long) > 1 and max(map(len, long)) <= 500 and " ".join(long) == ("wort " * 300).strip()


# -- rates and panels -----------------------------------------------------------------------------------------------


def test_rate_zero_fill(spark):
    e, a = spark.createDataFrame([("A",), ("B",)], "c string"), spark.createDataFrame([("A",)], "c string")
    assert rows(rates.rate_table(e, a, ["c"]), "c", "n_accusations", "rate_10k") == [("A", 1, 10000.0), ("B", 0, 0.0)]


def test_qcut_and_rolling(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 9)], "x double")
    assert [r[1] for r in sorted(rows(rates.qcut(df, "x"), "x", "bin"))] == [0, 0, 1, 1, 2, 2, 3, 3]
    m = spark.createDataFrame([(i, i, 10000) for i in range(30)], "m int, k int, n int")
    got = [(r.m, r.smooth_10k) for r in rates.rolling_ratio(m, "m", "k", "n").orderBy("m").collect() if r.smooth_10k is not None]
    assert got[0] == (6, 66 / 12) and got[-1][0] == 24


def test_thin_cells_count_anew(spark):
    d = [("A", "x")] * 3 + [("B", "y")] + [("A", "y")]
    got = rates.prune_thin(spark.createDataFrame(d, "a string, b string"), ["a", "b"], 2)
    assert rows(got, "a", "b") == [("A", "x")] * 3


@pytest.mark.parametrize("mode,want", [("bloc", [1.5, 1.5, 5.0, 5.0]), ("pm_only", [0.0, 0.0, 0.0, 10.0]), ("none", [0.0] * 4)])
def test_bloc_split(spark, mode, want):
    s = spark.createDataFrame([("c", "d", p, 2000, c, pm, 1, 0, 0) for p, c, pm in ((1, 1, 1), (2, 1, 0), (3, 0, 0), (4, None, 0))], "country string, source_dataset string, party int, year int, in_cabinet int, is_pm int, n_sentences int, acc_made int, acc_received int")
    named = spark.createDataFrame([], "country string, source_dataset string, party int, year int, n int")
    coll = spark.createDataFrame([("c", "d", 2000, 10, 3)], "country string, source_dataset string, year int, n_gov int, n_opp int")
    assert sorted(r.acc_collective for r in panel.party_year_panel(s, named, coll, mode).collect()) == want
    with pytest.raises(ValueError):
        panel.party_year_panel(s, named, coll, "other")


def events(spark, data):
    return spark.createDataFrame([(i, a, b, dt.date.fromisoformat(t)) for i, (a, b, t) in enumerate(data)], "obs bigint, a int, b int, at date")


def test_switch_gaps(spark):
    e = events(spark, [(1, 2, "2020-01-01"), (2, 1, "2020-01-04"), (2, 1, "2020-01-06"), (1, 2, "2020-01-10")])
    assert sorted(r.gap_days for r in panel.switch_gaps(e, "at", "obs").collect()) == [3, 4]


def test_choice_sets(spark):
    e = events(spark, [(2, 1, "2020-01-01"), (1, 2, "2020-01-31"), (1, 3, "2020-02-20"), (3, 2, "2020-01-05")])
    got = {(r.obs, r.cand): (r.chosen, r.provoked) for r in panel.choice_sets(e).collect()}
    assert got[(1, 2)] == (1, 1) and got[(1, 3)] == (0, 0) and (0, 1) not in got and (3, 2) not in got
    many = events(spark, [(1, b, "2020-01-01") for b in range(2, 17)])
    assert sorted(panel.choice_sets(many).filter("obs = 0").groupBy("chosen").count().collect()) == [(0, 10), (1, 1)]


def test_salted_aggregate_equals_plain(spark):
    data = [("hot", float(i % 7) / 10, f"s{i % 50}") for i in range(3000)] + [(None, None, None), ("a", float("nan"), "s1"), ("a", 0.5, "s1"), ("b", None, None)]
    df = spark.createDataFrame(data, "k string, score double, who string").withColumn("salt", F.lit("clash"))
    got = {r.k: (r.n_rows, r.n_scored, r.mean_score, r.n_distinct) for r in skew.salted_aggregate(df, "k", "score", "who", salts=4).collect()}
    hot = [s for k, s, _ in data if k == "hot"]
    assert got["hot"] == (3000, 3000, round(sum(hot) / 3000, 6), 50)
    assert got[None] == (1, 0, None, 0) and got["a"] == (2, 1, 0.5, 1) and got["b"] == (1, 0, None, 0)
    assert skew.salted_aggregate(df.filter("false"), "k", "score", "who").count() == 0


# -- stages ---------------------------------------------------------------------------------------------------------


def test_roll_up(spark):
    ch = spark.createDataFrame([("a", "failed"), ("a", "pending"), ("b", "failed"), ("d", "success"), ("d", "failed")], "id string, st string")
    pa = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    assert [r[1] for r in rows(stages.roll_up(ch, pa, "id", "st"), "id", "status")] == ["pending", "failed", "failed", "success"]


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([("k", 1, 10)], "key string, v int, created int")
    d = spark.createDataFrame([("k", 2, 20), ("n", 1, 30)], "key string, v int, created int")
    once = stages.upsert(t, d, ["key"], "v", "created")
    assert rows(once, "key", "v", "created") == [("k", 2, 10), ("n", 1, 30)] == rows(stages.upsert(once, d, ["key"], "v", "created"), "key", "v", "created")


def test_validation_and_stage(spark):
    df = spark.createDataFrame([("Aliens", "x"), ("person", "y" * 400)], "target_type string, target_text string")
    got = rows(infer.validate_targets(df), "target_type", "target_text")
    assert got == [("person", "y" * 300), ("unclear_or_none", "")]
    r = rows(infer.run_stage(spark.createDataFrame([("a lie",), (None,)], "s string"), infer.stub_classifier("s"), "lie_label string, lie_score double"), "s", "lie_label")
    assert r == [("a lie", "LABEL_1"), (None, "LABEL_0")]


# -- models ---------------------------------------------------------------------------------------------------------


def test_poisson_saturated_and_clusters(spark):
    df = spark.createDataFrame([("a", 30, 1000, 0), ("a", 50, 1000, 0), ("b", 20, 500, 1), ("b", 40, 500, 1)], "g string, k int, n int, x int")
    f = glm.fit_counts(df, "k", ["x"], exposure="n")
    assert math.isclose(math.exp(f.beta[1]), (60 / 1000) / (80 / 2000), rel_tol=1e-8)
    c = glm.fit_counts(df, "k", ["x"], exposure="n", cluster="g")
    assert c.n_clusters == 2 and np.allclose(c.beta, f.beta)
    nb = glm.fit_counts(df, "k", ["x"], exposure="n", family="nb", robust=True)
    b, se = glm.fit_small(np.array([[1, 0], [1, 0], [1, 1], [1, 1.0]]), np.array([30, 50, 20, 40.0]), np.log([1000, 1000, 500, 500]), 1.0)
    assert np.allclose(nb.beta, b, atol=1e-7) and np.allclose(nb.se, se, atol=1e-7)


def test_conditional_logit(spark):
    sets = [(i, c, int(c == 0), int((c == 0) == (i % 4 != 0))) for i in range(40) for c in range(2)]
    r = glm.conditional_logit(spark.createDataFrame(sets, "obs int, cand int, chosen int, provoked int"))
    assert math.isclose(r["odds_ratio"], 3.0, rel_tol=1e-9)


def test_rank_polarity_lowess(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0)], "a double, b double, c double")
    assert glm.design_rank(df, ["a", "b", "c"]) == (2, 4, ["c"])
    s = spark.createDataFrame([("Left Party", 1.0), ("Right Party", 2.0)], "n string, v double")
    assert glm.polarity_check(s, "n", "v", "Left", "Right") == (1.0, 2.0)
    with pytest.raises(AssertionError):
        glm.polarity_check(s, "n", "v", "Right", "Left")
    x = np.arange(10.0)
    assert np.allclose(glm.lowess(x, 2 * x + 1, 0.5), 2 * x + 1)


# -- sources, sinks, streams ----------------------------------------------------------------------------------------


def test_tei(spark, tmp_path):
    d = tmp_path / "ParlaMint-AT-en.ana" / "ParlaMint-AT.TEI.ana"
    d.mkdir(parents=True)
    (d / "a.xml").write_text('<TEI xmlns="http://www.tei-c.org/ns/1.0"><setting><date when="2000-01-02"/></setting><u who="#X" xml:id="u1">Hi <s>there</s> you all. No.</u></TEI>')
    (d / "bad.xml").write_text("<TEI")
    (d / "ParlaMint-listPerson.xml").write_text('<l xmlns="http://www.tei-c.org/ns/1.0"><person xml:id="X"><persName><surname>Doe</surname><forename>Jo</forename></persName></person></l>')
    r = readers.tei(spark, str(tmp_path)).filter("text LIKE 'Hi%'").first()
    assert (r.text, r.date, r.speaker, r.country, r.source_speech_id) == ("Hi there you all. No.", "2000-01-02", "X", "AT", "u1")
    assert rows(readers.tei_names(spark, str(tmp_path)), "who", "name") == [("X", "Jo Doe")]
    s = readers.sentence_table(readers.tei(spark, str(tmp_path)).filter("text LIKE 'Hi%'"))
    assert rows(s, "sentence_idx", "sentence") == [(0, "Hi there you all.")]


def test_pipes_json_csv(spark, tmp_path):
    (tmp_path / "s.txt").write_text("speech_id|speech\n1|Hello | there\n2|x\n")
    (tmp_path / "d.txt").write_text("speech_id|chamber|date|first_name|last_name|speaker\n1|H|19990102|Jo|Doe|Mr. DOE\n2|X|19990102|||Y\n")
    r = readers.piped(spark, str(tmp_path / "s.txt"), str(tmp_path / "d.txt")).collect()
    assert [(x.text, x.date, x.speaker) for x in r] == [("Hello | there", "1999-01-02", "Jo Doe")]
    (tmp_path / "CREC-1.json").write_text('{"header": {"year": "1995", "month": "March", "day": "4"}, "id": "d", "content": [{"kind": "speech", "text": "t", "speaker": "None", "itemno": 3}, {"kind": "title", "text": "u"}]}')
    r = readers.record_json(spark, str(tmp_path / "CREC-1.json")).first()
    assert (r.text, r.date, r.speaker, r.source_speech_id) == ("t", "1995-03-04", "", "d-item3")
    (tmp_path / "a.csv").write_text('Date,Name,Body,uniqueID\n2000-01-01,Jo,"said ""x""\nand y",NA\n1980-01-01,Jo,z,7\n')
    c = readers.csv_strings(spark, str(tmp_path / "a.csv"), ["Date", "Name", "Body", "uniqueID"], multi_line=True)
    c = readers.resolve_aliases(c, {"date": ["datum"], "speaker": ["name"], "text": ["body"], "uniqueID": []})
    got = readers.speech_csv(c, "text", "AU", "au", year_from=1990, speech_id=["uniqueID"]).collect()
    assert len(got) == 1 and got[0].text == 'said "x"\nand y' and got[0].source_speech_id not in ("NA", "7")
    with pytest.raises(ValueError):
        readers.resolve_aliases(c, {"missing": []})


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "t")
    writers.write_once(spark.range(3), p)
    writers.write_once(spark.range(5), p)
    assert spark.read.parquet(p).count() == 3
    writers.replace(spark.range(7), p)
    assert spark.read.parquet(p).count() == 7


def test_streams(spark, tmp_path):
    src, data = tmp_path / "in", [("f", i, "A", f"s{i}", i in (2, 12)) for i in range(13)]
    schema = "source_file string, seq bigint, speaker string, sentence string, label boolean"
    for n, part in enumerate((data[:5], data[5:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(src / f"b{n}"))
    rows_ = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(src / "b*"))
    q = stream.stream_context(rows_).writeStream.format("memory").queryName("ctx").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.seq: r.context for r in spark.table("ctx").collect()}
    assert got[2] == "[A]\ns0\ns1\n>>> s2" and got[12] == "[A]\n" + "".join(f"s{i}\n" for i in range(4, 12)) + ">>> s12"  # as the batch operator renders it
    out = str(tmp_path / "out")
    for _ in range(2):
        stream.process_once(spark.readStream.schema(schema).parquet(str(src / "b*")), out, str(tmp_path / "ck2"), lambda d: d.select("seq"), "seq")
    assert spark.read.parquet(out).count() == 13


# -- rules and plans that hold at scale -----------------------------------------------------------------------------


@pytest.mark.parametrize("text,want", [("Staatssekretär Moser", True), ("the State Secretary", True), ("Bundeskanzler X", True), ("the Premier", False), ("nobody", False), (None, None)])
def test_government_roles(spark, text, want):
    assert one(spark, F.col("t").rlike(T.GOVERNMENT_ROLES), t=text) is want


@pytest.mark.parametrize("text,want", [("Labour left office", None), ("the administration", None), ("left wing", "left"), ("the Opposition and the government", "opposition"), ("the treasury benches", "government")])
def test_blocs_know_no_party_names(spark, text, want):
    assert one(spark, T.bloc(F.col("t")), t=text) == want


@pytest.mark.parametrize("at,low,high,want", [("2001-05-01", None, "1995-01-01", True), ("2001-05-01", "2002-01-01", "", True), ("2001-05-01", "2002-01-01", "2003-01-01", False), ("2001-05-01", "2000-01-01", "2001-05-01T10:00", True), (None, "2002-01-01", "2003-01-01", True)])
def test_period(spark, at, low, high, want):
    assert one(spark, entity.in_period(F.col("a"), F.col("l"), F.col("h")), a=at, l=low, h=high) is want


def test_interjection_begins_with_a_name(spark):
    assert one(spark, F.regexp_extract("t", entity.INTERJECTION, 1), t="von Foo: no") == ""


def test_similar_pairs_equal_brute_force(spark):
    import difflib
    import random

    r = random.Random(5)
    words = {"".join(r.choice("abcdeilmnorst") for _ in range(r.randint(2, 11))) for _ in range(120)}
    words |= {w[:i] + r.choice("aexz") + w[i + r.randint(0, 1) :] for w in list(words) for i in [r.randint(0, len(w))]} | {"ä", "aa", "aaa", "aaaa"}
    df = spark.createDataFrame([("b", w) for w in sorted(words)], "block string, w string")
    got = {(x.w, x.v) for x in entity.similar_pairs(df, df.withColumnRenamed("w", "v"), ["block"], "w", "v", 0.82).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and difflib.SequenceMatcher(None, a, b).ratio() >= 0.82}


def test_similar_targets_go_to_the_chooser(spark):
    speakers = spark.createDataFrame([("s1", "Anna Apfelbach", "AT", "d", "", "")], "speaker_id string, name_cleaned string, country string, source_dataset string, min_date string, max_date string")
    acc = spark.createDataFrame([(1, "Anna Apfelbech", "AT", "d", "2001-01-01", "person", "success", 0, "pending"), (2, "Dr. Apfelbach", "AT", "d", None, "person", "success", None, "pending")], "id long, target_text string, country string, source_dataset string, date string, target_type string, target_status string, is_interjection int, resolve_status string")
    got = {r.id: (r.resolve_status, r.resolve_method, r.resolved_speaker_id, r.n_candidates) for r in entity.resolve_targets(acc, speakers).collect()}
    assert got == {1: ("unresolved", "llm_fuzzy", None, 1), 2: ("resolved", "exact", "s1", 1)}


def test_rival_party_below_the_least_counts(spark):
    p = spark.createDataFrame([(1, "AUT", "abcdefghijklmnopqrst", None, None, None, None), (2, "AUT", "abcdefghijklmnopqrsz", None, None, None, None)], "partyfacts_id int, country string, name string, name_english string, name_short string, year_first double, year_last double")
    import difflib

    text = next(t for n in range(3, 12) for t in ["abcdefghijklmnopqrst"[: 20 - 3] + "xy"[: n % 3]] if difflib.SequenceMatcher(None, t, "abcdefghijklmnopqrst").ratio() >= 0.88)
    a = spark.createDataFrame([(1, "AT", text, "2000-01-01", "political_party", "success")], "id long, country string, target_text string, date string, target_type string, target_status string")
    assert entity.resolve_parties(a, p).first().match_method == "ambiguous_fuzzy"


def test_skipped_before_cv(spark):
    from lodestone.operators import stages

    cols = ["query", "fetch", "url_synth", "cv_synth", "annotate_a", "annotate_b", "annotate_c", "annotate_d"]
    df = spark.createDataFrame([("success", "success", "skipped", "pending", *["pending"] * 4), ("skipped", "pending", "pending", "pending", *["pending"] * 4)], ", ".join(f"{c}_status string" for c in cols))
    got = {r.stage: r.ready for r in stages.readiness(df).collect()}
    assert got["cv_synth"] == 1 and got["fetch"] == 0 and got["url_synth"] == 0


def test_timeline_keeps_equal_facts(spark):
    t = spark.createDataFrame([("s", 0, 1990, 2000, "A")], "speaker_id string, pos int, start_year int, end_year int, party string")
    f = spark.createDataFrame([("s", 1995), ("s", 1995), (None, 1995), ("s", None)], "speaker_id string, year int")
    got = asof.timeline_pick(f, t, "speaker_id", "year")
    assert got.count() == 4 and got.filter("party = 'A' AND covered").count() == 2 and got.filter("speaker_id IS NULL AND party IS NULL").count() == 1
    assert asof.timeline_pick(f.filter("false"), t, "speaker_id", "year").count() == 0


def test_asof_equals_brute_force(spark):
    import random

    r = random.Random(3)
    day = lambda: f"{r.randint(1990, 2010)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"
    hist = sorted({(r.choice("ab"), day()): i for i in range(60)}.items())
    facts = [(i, r.choice(["a", "b", "c", None]), day() if r.random() < 0.95 else None) for i in range(200)]
    h = spark.createDataFrame([(k, d, v) for (k, d), v in hist], "k string, day string, v int").withColumn("day", F.to_date("day"))
    f = spark.createDataFrame(facts, "i int, k string, at string").withColumn("at", F.to_date("at"))
    for first in (False, True):
        got = {x.i: x.v for x in asof.asof_join(f, h, ["k"], "at", "day", ["v"], or_first=first).collect()}
        want = {}
        for i, k, at in facts:
            own = [(d, v) for (kk, d), v in hist if kk == k]
            before = [v for d, v in own if at and d <= at]
            want[i] = before[-1] if before else own[0][1] if first and own and at else None
        assert got == want
    assert asof.asof_join(f.filter("false"), h, ["k"], "at", "day", ["v"]).count() == 0


def test_quantiles_and_ecdf(spark):
    import numpy as np

    vals = [1.0, 2.0, 2.0, 5.5, 7.0, None, float("nan"), -3.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = rates.quantiles(df, "x", [0.0, 0.1, 0.5, 0.9, 1.0]).first().q
    assert np.allclose(got, np.quantile([v for v in vals if v is not None and v == v], [0.0, 0.1, 0.5, 0.9, 1.0]))
    assert rates.quantiles(df.filter("false"), "x", [0.5]).first().q == [None]
    e = spark.createDataFrame([("a", 1), ("a", 1), ("a", 3), (None, 2)], "g string, x int")
    assert sorted((r.g or "", r.x, round(r.ecdf, 3)) for r in rates.ecdf(e, "g", "x").collect()) == [("", 2, 1.0), ("a", 1, 0.667), ("a", 1, 0.667), ("a", 3, 1.0)]


def test_first_value_that_is_not_null(spark):
    e = spark.createDataFrame([(1, "s", None), (2, "s", "x"), (3, "s", "y")], "o int, k string, c string")
    assert panel.speaker_year_panel(e, e.filter("false"), e.filter("false"), ["k"], ["c"], "o").first().c == "x"


def test_rows_numbered_as_read(spark, tmp_path):
    (tmp_path / "x.csv").write_text('"Date","Say, what"\n2000,a\n2000,a\n2001,b\n')
    assert readers.header(spark, str(tmp_path / "x.csv")) == ["Date", "Say, what"]
    c = readers.row_index(readers.csv_strings(spark, str(tmp_path / "x.csv"), ["Date", "Say, what"]))
    assert [tuple(r) for r in c.orderBy("row_seq").collect()] == [("2000", "a", 0), ("2000", "a", 1), ("2001", "b", 2)]


def test_html_noise(spark):
    body = "The member spoke at length on the harbour and its dues. " * 3
    h = f"<html><head><title>Site title</title></head><body><figure>Caption</figure><div class='newsletter-box'>Sign up</div><ul class='pagination'><li>2</li></ul><select><option>DE</option></select><p>{body}</p></body></html>"
    assert one(spark, T.html_text("h"), h=h) == body.strip()
