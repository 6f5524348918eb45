"""The training-data operators against brute force, round trips and awkward inputs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import boilerplate, cutoff, encoding, mixing, names, packing, residue, tokens
from lodestone.llm.name_parse import near, parse_party, parse_person
from lodestone.llm.page_lines import Page


# -- 1 names --------------------------------------------------------------------------------------------------------

MENTIONS = "country string, name string, is_party boolean"


def resolved(spark, data, country="GB", party=()):
    df = spark.createDataFrame([(country, n, n in party) for n in data], MENTIONS)
    out: dict = {}
    for r in names.resolve(df.withColumn("entity", F.lit("clash")).withColumn("rid", F.lit(1))).collect():
        out.setdefault(r.entity, set()).add(r.name)
    return sorted(out.values(), key=sorted)


def cluster_of(groups, name):
    return next((g for g in groups if name in g), set())


PEOPLE = ["Edward Grambonley", "Grambonley, Edward", "Mr E. Grambonley", "GRAMBONLEY Edward", "Minister Grambonley", "Edward Gramboneley", 'Edward "Ted" Grambonley', "Ted Grambonley", "Dr Edward Grambonley",
          "Edward Hirbonmore", "Hirbonmore, Edward", "Susan Hirbonmore", "Hirbonmore, Susan", "Mr Hirbonmore", "Susan Cebulerman", "Cebulerman, Susan", "Mrs Cebulerman", "Anthony Hertaterby", "Hertaterby, Anthony",
          "the Minister", "A Member", "farm owners", "nan", "", "  "]


def test_persons(spark):
    g = resolved(spark, PEOPLE)
    assert cluster_of(g, "Edward Grambonley") == {n for n in PEOPLE if "ramb" in n.lower()}
    assert cluster_of(g, "Susan Cebulerman") == {"Susan Cebulerman", "Cebulerman, Susan", "Mrs Cebulerman"}
    assert cluster_of(g, "Mr Hirbonmore") == {"Mr Hirbonmore"}  # two of that name
    assert cluster_of(g, "Susan Hirbonmore") == {"Susan Hirbonmore", "Hirbonmore, Susan"}
    assert not cluster_of(g, "the Minister") and not cluster_of(g, "nan")


def test_parties(spark):
    p = ["Citizens' Rally of the Orchard", "the Citizens' Rally of the Orchard", "Citizens' Rally o. t. Orchard", "CRO", "C.R.O.", "CRO group", "Orchard Rally", "the Orchards", "Citizens' Rally of the Orchard (CRO)", "Progressive Quarry Union", "Quarry Union", "PQU"]
    g = resolved(spark, p, party=p)
    assert cluster_of(g, "CRO") == {x for x in p if "rchard" in x or "R" in x and "O" in x and "Q" not in x}
    assert cluster_of(g, "PQU") == {"Progressive Quarry Union", "Quarry Union", "PQU"}


def test_names_by_country_and_awkward(spark):
    df = spark.createDataFrame([("GB", "Jane Doewater", None), ("FR", "Jane Doewater", None), ("FR", "Doewater, Jane", None), (None, "Jane Doewater", None), ("FR", None, True), ("FR", "x" * 20000, False), ("FR", "?!", None)] * 2, MENTIONS)
    pairs = names.variant_pairs(names.resolve(df)).collect()
    assert [tuple(r) for r in pairs] == [("FR", "Doewater, Jane", "Jane Doewater")]
    assert names.resolve(df.filter("false")).count() == 0


def test_near_and_parse():
    assert near("maier", "mayer") and near("maier", "amier") and near("maier", "maer") and not near("maier", "meyer")
    assert parse_person("Rt Hon Stephen Crolvuvstead")["long"] == ["stephen", "crolvuvstead"]
    assert parse_person("the Minister of Finance") is None and parse_person("[unknown]") is None
    assert parse_party("Prog. Harbour Rally (PHR)")["acr"] == "phr"


# -- 4 cutoffs ------------------------------------------------------------------------------------------------------


def brute(scores, pct):
    s = sorted((x for x in scores if x is not None and not math.isnan(x)), reverse=True)
    if not s or pct is None or pct > 100:
        return None, 0
    c = next(v for v in s if 100 * sum(x >= v for x in s) >= pct * len(s))
    return c, sum(x >= c for x in s)


def test_cutoffs_equal_brute_force(spark):
    r = random.Random(1)
    data = {"a": [r.random() for _ in range(300)], "b": [round(r.random(), 1) for _ in range(300)], "c": [0.5] * 10, "d": [None, float("nan")], "e": [1e-300, -1e300, 1e300, 0.0, -0.0, 3.0], "f": [float(i) for i in range(50)], "g": [1.0, 2.0], "h": [5.0]}
    pct = {"a": 33, "b": 20, "c": 50, "d": 50, "e": 40, "f": 100, "g": 0, "h": 101, "none": 10}
    rec = spark.createDataFrame([(k, v, 1) for k, vs in data.items() for v in vs] + [(None, 0.5, 1)], "source_dataset string, lie_score double, cutoff int")
    tgt = spark.createDataFrame([*pct.items(), (None, 5)], "source_dataset string, keep_pct int")
    for bins in (4, 4096):
        got = {x.source_dataset: (x.cutoff, x.n_kept) for x in cutoff.cutoffs(rec, tgt, bins=bins).collect()}
        assert got == {k: brute(data.get(k, []), p) for k, p in pct.items()}
    kept = cutoff.keep(rec, cutoff.cutoffs(rec, tgt))
    assert kept.columns == rec.columns and kept.filter("source_dataset = 'a'").count() == brute(data["a"], 33)[1]
    assert cutoff.cutoffs(rec.filter("false"), tgt).filter("cutoff IS NOT NULL").count() == 0
    assert cutoff.cutoffs(rec, tgt.filter("false")).count() == 0


# -- 6 packing ------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 3), st.integers(-1, 4)), max_size=40))
def test_best_fit_properties(items):
    sizes, src, cl = ([x[i] for x in items] for i in range(3))
    at = packing.best_fit(sizes, src, cl, 20)
    fill, seen = Counter(), set()
    for s, c, b in zip(sizes, cl, at):
        fill[b] += s
        if c >= 0:
            assert (b, c) not in seen
            seen.add((b, c))
    assert all(v <= 20 for v in fill.values()) and sorted(set(at)) == list(range(len(set(at))))


def test_pack(spark):
    docs = [(i, "s" if i % 3 else None, n, c) for i, (n, c) in enumerate([(250, None), (600, 1), (0, None), (None, 2), (10, 7), (10, 7), (10, 7), (100, None)] * 5)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint, cluster bigint").withColumn("bin", F.lit("clash"))
    caps = spark.createDataFrame([("short", 256), ("none", None), ("bad", 0)], "container string, capacity_tokens int")
    out = packing.pack(df, caps, shard_items=10).collect()
    per, of = Counter(), Counter()
    for r in out:
        per[r.bin] += r.n_tokens
        of[r.doc_id] += r.n_tokens
    assert max(per.values()) <= 256 and {r.container for r in out} == {"short"}
    assert all(of[i] == (n or 0) for i, _, n, _ in docs) and {r.doc_id for r in out} == {d[0] for d in docs}
    assert all(sum(1 for r in out if r.doc_id == i) == 1 for i, _, n, _ in docs if (n or 0) <= 256)
    assert packing.pack(df.filter("false"), caps).count() == 0
    hot = spark.createDataFrame([(i, "s", 10, 1) for i in range(100)], "doc_id bigint, source string, n_tokens bigint, cluster bigint")
    rep = packing.report(packing.pack(hot, spark.createDataFrame([("c", 100)], "container string, capacity_tokens int")), spark.createDataFrame([("c", 100)], "container string, capacity_tokens int")).first()
    assert rep.n_bins == 10 and rep.fill == 1.0


def test_tokens(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",), ("word " * 30000,)], "t string")
    got = [r.n for r in df.select(tokens.token_count(F.col("t")).alias("n")).collect()]
    assert got[0] == 2 and got[1] == got[2] == 0 and got[3] > 1 and got[4] > 30000


# -- 7 mixing -------------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.integers(0, 1000)), min_size=1, max_size=8), st.integers(0, 4000))
def test_water_fill(sources, total):
    w, caps = [x for x, _ in sources], [c for _, c in sources]
    got = mixing.water_fill(w, caps, total)
    assert all(0 <= g <= c for g, c in zip(got, caps)) and sum(got) <= total
    feasible = sum(c for x, c in sources if x > 0)
    assert sum(got) >= min(total, feasible) - len(w)
    free = [(g, x) for g, x, c in zip(got, w, caps) if x > 0 and g < c]
    if free:  # what isn't clamped is in proportion
        k = free[0][0] / free[0][1]
        assert all(abs(g - k * x) <= 1 + x / free[0][1] for g, x in free)


def test_mix(spark):
    docs = [(i, "big", 10 + i % 5) for i in range(2000)] + [(5000 + i, "small", 20) for i in range(50)] + [(9000, None, 5), (9001, "big", None), (9002, "other", 7)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint").withColumn("times", F.lit(9))
    t = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.4, 3), ("m", "gone", 0.1, 2)], "mix string, source string, target_share double, max_repeats int")
    use, shares = mixing.mix(df, t)
    u = {r.doc_id: r.times for r in use.collect()}
    s = {r.source: r for r in shares.collect()}
    assert max(v for k, v in u.items() if k < 5000) == 1 and {v for k, v in u.items() if 5000 <= k < 9000} == {3}
    assert s["small"].clamped and s["small"].used_tokens == 3000 and s["gone"].used_tokens == 0
    size = dict((i, n or 0) for i, _, n in docs)
    got = sum(size[k] * v for k, v in u.items() if k < 5000)
    assert got == s["big"].used_tokens and s["big"].planned_tokens <= got < s["big"].planned_tokens + 15
    again = {r.doc_id: r.times for r in mixing.mix(df.repartition(7), t)[0].collect()}
    assert again == u and 9000 not in u
    assert mixing.mix(df.filter("false"), t)[0].count() == 0


# -- 2 and 3 pages --------------------------------------------------------------------------------------------------

URL = "https://www.town-wire.example/people/ann-quillberg-{}"
MENU = "Home\nAbout us\nMembers\nSearch\nLog in\n"
FOOT = "Back to top\n© 2001 Town Wire. All rights reserved.\nPowered by Marrowick Digital"


def page(i, body):
    return (i, URL.format(i), f"{MENU}\nAnn Quillberg\n{body}\n\n{FOOT}")


def corpus():
    r = random.Random(3)
    s = ["Quillberg studied law in Norwick before entering politics.", "Ann Quillberg was born in 1950 in Havelby and grew up on a farm.", "Quillberg chaired the committee on transport from 1983 until 1994.", "In a speech of 1988 Quillberg called the budget an insult to nurses."]
    pages = [page(i, "Career\n" + " ".join(r.sample(s, 2)) + "\n\nAdvertisement\n\n" + r.choice(s)) for i in range(120)]
    bad = ["Please enable JavaScript to run this app.", "Born {{title}}; member for {{office}}.", "Error establishing a database connection", "Name: undefined"]
    pages += [page(1000 + i, "\n".join(r.sample(bad, 2))) for i in range(24)]
    pages += [page(2000, s[0] + "\nPlease enable JavaScript to run this app."), (3000, None, None), (3001, URL, ""), (3002, None, " \n\t"), (3003, None, "Just one line of text without anything else to say here."), (3004, URL, "Quillberg wrote a very long book about harbours. " * 4000)]
    return pages


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(corpus(), "id bigint, url string, cleaned_text string").withColumns({"row": F.lit(1), "skeleton": F.lit("clash"), "furniture": F.lit(True)}).cache()


def test_residue(spark, pages):
    got = {r.id for r in residue.residue_pages(pages).collect()}
    assert got == set(range(1000, 1024))
    assert residue.residue_pages(pages.filter("false")).count() == 0


def test_boilerplate(spark, pages):
    net = boilerplate.train(pages.filter("id < 100"))
    got = boilerplate.furniture_lines(pages.filter("id BETWEEN 100 AND 119 OR id >= 3000"), net).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.id, []).append((r.line, r.furniture))
    want = set(MENU.split("\n") + FOOT.split("\n") + ["Advertisement"])
    wrong = [(i, line, f) for i, ls in by.items() if i < 3000 for line, f in ls if (line in want) != f]
    assert len(wrong) <= 4, wrong
    assert 3000 not in by and 3001 not in by and len(by[3004]) == 1
    text = {r.id: r.main_text for r in boilerplate.main_bodies(pages.filter("id = 105"), net).collect()}[105]
    assert "Quillberg" in text and "Powered by" not in text


def test_lstm_gradient():
    r = np.random.default_rng(0)
    net = boilerplate.BiLSTM(1)
    pg = [(r.random((4, boilerplate.SHAPE)).astype(np.float32), [[1, 2], [3], [4, 5], [1]]), (r.random((3, boilerplate.SHAPE)).astype(np.float32), [[7], [8, 9], [2]])]
    y, known = np.array([[1, 0], [0, 1], [1, 1], [0, 0]], np.float32), np.array([[1, 1], [1, 1], [1, 1], [1, 0]], np.float32)

    def loss():
        p, *_ = net.forward(pg)
        return float(-((y * np.log(p) + (1 - y) * np.log(1 - p)) * known).sum() / known.sum())

    before, losses = loss(), []
    for _ in range(60):
        losses.append(net.step(pg, y, known, 0.01))
    assert abs(losses[0] - before) < 1e-5 and loss() < 0.3 * before


def test_words_of_a_long_line_all_count():
    head, tail = ["word%d" % i for i in range(80)], ["cookie", "settings"]
    read = lambda toks: boilerplate.read_page(" ".join(toks), None)[2][0]
    a, b = Counter(read(head + tail)), Counter(read(head + tail[::-1]))
    assert len(read(head + tail)) == 82 + 81 + 3 and a != b  # the order of the last two words tells
    assert a != Counter(read(head + ["other", "settings"]))
    net = boilerplate.BiLSTM()
    long = [boilerplate.read_page(" ".join(head * 100 + t), None)[1:3] for t in (["cookie"] * 5000, ["member"] * 5000)]
    p, q = boilerplate.label(net, long)
    assert p[0] != q[0] and np.isfinite(p).all()
    x = net.pad(long)[2]  # repeated words are counted, not dropped
    assert len(x[0]) <= 2 * boilerplate.HASHES and math.isclose(x[2][x[0] == 0].sum(), math.sqrt(len(long[0][1][0])), rel_tol=1e-4)


def test_page_address():
    p = Page("https://m.town-wire.example/people/ann-quillberg-77?id=3")
    assert p.name == ["ann", "quillberg"] and p.site == "townwire" and p.mask("town wire: ann quillberg") == "\x01: \x02 \x02"


# -- 8 encodings ----------------------------------------------------------------------------------------------------

SENTENCES = ["Der zuständige Ausschuss prüft die Förderung für ländliche Kliniken.", "Die Behörde für Gewässer kürzt die Zuschüsse während der Sitzung.", "Unsere Fraktion begrüßt die Erhöhung der Renten seit dem Frühjahr.", "Das Gespräch über die Brücken wäre für alle Bäuerinnen nützlich gewesen.", "Größere Städte müssen die Straßen schließen, wenn möglich."]


def german(n, seed=0):
    r = random.Random(seed)
    return [" ".join(r.choice(SENTENCES) for _ in range(4)) for _ in range(n)]


SWAPS = [("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "mac_roman")]


def test_restore_round_trip(spark):
    clean = german(200)
    docs = [(i, "S", t) for i, t in enumerate(clean)]
    truth = {}
    for k, (right, wrong) in enumerate(SWAPS):
        for j in range(3):
            t = german(1, 100 + 10 * k + j)[0]
            try:
                bad = t.encode(right).decode(wrong)
            except UnicodeDecodeError:
                continue
            truth[1000 + 10 * k + j] = t
            docs.append((1000 + 10 * k + j, "S", bad))
    twice = german(1, 77)[0]
    truth[2000] = twice
    docs.append((2000, "S", twice.encode().decode("latin-1").encode().decode("latin-1")))
    docs += [(3000, "S", None), (3001, None, ""), (3002, None, "plain text"), (3003, "S", "Señor niño, ¿qué? ¡Sí!"), (3004, "S", "Für alle. 林小川 ✔ Ω = 4"), (3005, "S", "Die F�rderung f�r l�ndliche Kliniken.")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumns({"gain": F.lit(1), "restored": F.lit("clash"), "words": F.lit("x")})
    got = {r.doc_id: r.restored for r in encoding.restore(df).collect()}
    assert set(got) == set(truth) | {3005}
    same = sum(got[i] == t for i, t in truth.items())
    assert same >= 0.9 * len(truth), [(got[i], t) for i, t in truth.items() if got[i] != t]
    assert encoding.restore(df.filter("false")).count() == 0


CZECH = ["Ve sněmovně jsou při hlasování tři návrhy a jeden příspěvek.", "Předseda přečetl čtyři zprávy, které výbor připravil.", "Ministr řekl, že rozpočet přinese třikrát více peněz.", "Při jednání přišel čas na řadu otázek a tři odpovědi."]
DANISH = ["Et større beløb går til støtte for miljøet og sundhedsvæsenet.", "Spørgsmålet om børn og skøde løses først i København.", "Vi ønsker grønne løsninger og høje lønninger før året er omme."]


def mixed(n, texts, seed):
    r = random.Random(seed)
    return [" ".join(r.choice(texts) for _ in range(3)) for _ in range(n)]


def test_one_improbable_use_is_doubted(spark):
    clean = mixed(150, CZECH, 1) + mixed(150, DANISH, 2)
    docs = [(i, "S", t) for i, t in enumerate(clean)]
    docs += [(1000, "S", "Poslanci podali tøi návrhy."), (1001, "S", "Vi venter på støtte før mødet.")]  # cp1250 read as cp1252, one letter; proper
    got = {r.doc_id: r.restored for r in encoding.restore(spark.createDataFrame(docs, "doc_id bigint, source string, text string")).collect()}
    assert got == {1000: "Poslanci podali tři návrhy."}


def test_units():
    assert encoding.symbols("Ã¼") == ("Ã¼",) and "ü" in encoding.candidates("Ã¼")
    assert encoding.symbols("Ã\x83Â¼") == ("Ã\x83Â¼",) and "ü" in encoding.candidates("Ã\x83Â¼")
    assert encoding.symbols("ß") == ("ß",) and encoding.candidates("林") == ("林",)
    assert encoding.apply("fÃ¼r ⁿ", {"Ã¼": "ü", "ⁿ": "u"}) == "für u"


FRENCH = ["Le député a présenté une mesure pour la région.", "La séance a été levée après l’intervention du ministre délégué.", "Une enquête préalable était nécessaire à l’évaluation.", "Les élèves préfèrent être reçus à la bibliothèque."]


@pytest.mark.parametrize("page,share", [("cp850", 0.05), ("cp850", 0.25), ("cp850", 1.0), ("mac_roman", 0.25), ("mac_roman", 1.0), ("cp1251", 0.25), ("cp1251", 1.0)])
def test_garbled_share_of_a_source(spark, page, share):
    """A source garbled in part or throughout is found and restored by what the other sources hold; those stay as they are."""
    r = random.Random(9)
    docs = [(i, "A", t) for i, t in enumerate(mixed(60, FRENCH, 3) + german(60, 4))]
    docs += [(200 + i, "B", t) for i, t in enumerate(mixed(40, FRENCH, 5) + german(40, 6))] + [(400 + i, "D", t) for i, t in enumerate(mixed(50, DANISH, 7))]
    truth = {}
    for i, t in enumerate(mixed(50, FRENCH, 8) + german(50, 9)):
        bad = t.encode("cp1252").decode(page, "ignore")
        if r.random() < share:
            truth[1000 + i] = t
        docs.append((1000 + i, "C", bad if 1000 + i in truth else t))
    got = {x.doc_id: x.restored for x in encoding.restore(spark.createDataFrame(docs, "doc_id bigint, source string, text string")).collect()}
    assert not set(got) - set(truth)
    assert len(got) >= 0.9 * len(truth) and sum(got.get(i) == t for i, t in truth.items()) >= 0.9 * len(truth)


def test_turns_give_the_same(spark, monkeypatch):
    docs = [(i, "S" if i % 2 else "T", t) for i, t in enumerate(german(80))] + [(1000 + i, "S", t.encode().decode("cp1252")) for i, t in enumerate(german(5, 1))]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    one = sorted((r.doc_id, r.restored) for r in encoding.restore(df).collect())
    monkeypatch.setattr(encoding, "MAX_ROWS", 200)
    assert one == sorted((r.doc_id, r.restored) for r in encoding.restore(df).collect()) and len(one) == 5


def test_residue_without_addresses(spark, pages):
    """The speaker's record tells the name where the address doesn't; a default, a blank and a sentence of a template are residue."""
    named = pages.withColumns({"url": F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.format_string("https://www.town-wire.example/person/%d", "id")), "name": F.lit("Quillberg, Ann")})
    extra = [page(4000 + i, body) for i, body in enumerate(["Born in Firstname Lastname; member for {{office}}."] * 3 + ["The biography of Ann Quillberg is in preparation."] * 6)]
    extra = spark.createDataFrame([(i, None, t) for i, _, t in extra], "id bigint, url string, cleaned_text string").withColumn("name", F.lit("Dr Ann Quillberg"))
    got = {r.id for r in residue.residue_pages(named.select("id", "url", "cleaned_text", "name").unionByName(extra)).collect()}
    assert got == set(range(1000, 1024)) | set(range(4000, 4009))


def test_template_slots():
    p = Page(None, "Quillberg, Ann")
    assert residue.template("Born in Havelby, 1950; member for Norwick.", p) == ("born in ^ member for ^", ["havelby 0", "norwick"])
    assert residue.template("Born in {{place}}, {{year}}; member for .", p) == ("born in ^ member for ^", ["\x03 \x03", ""])
    assert residue.template("", p) == ("", [])


LANG = {  # name sentences, headings, insertions, menu, footer of made-up languages: no seed knows a word of them
    "a": (["Ann Quillberg vorka tel dom i harbo.", "Quillberg sedda pa benko fra 1980 til 1990.", "Per ar 1988 Quillberg kalla budgeto en skam."], ["Livo", "Arbeto"], "Reklamo sekvas", ["Hejmo", "Pri ni", "Serci"], ["Reen supren", "Kondicoj kaj reguloj"]),
    "b": (["Ann Quillberg nokim ta lesh u varo.", "Quillberg pashim ke konsil ta 1970.", "Ta 1991 Quillberg morim ta elektim dur."], ["Vitum", "Labrum"], "Video levim", ["Domum", "Noim", "Querim"], ["Supra retro", "Regulim ta sitom"]),
}


def test_labeller_needs_no_seed_of_a_language(spark):
    """Held out: pages of hosts that the labeller hasn't seen, in languages of which no seed phrase knows a word."""
    r, rows, want = random.Random(4), [], {}
    for i in range(500):
        told, heads, ad, menu, foot = LANG["ab"[i % 2]]
        body = ["Ann Quillberg"]
        for k in range(r.randint(2, 4)):
            body += [r.choice(heads)] if r.random() < 0.5 else []
            body += [" ".join(r.sample(told, 2))]
            body += [ad] if k < 1 and r.random() < 0.6 else []
        if r.random() < 0.3:
            body = body[1:]
        lines = r.sample(menu, 3) + body + r.sample(foot, 2)
        rows.append((i, f"https://host{i % 25}.example/p/{i}", "Quillberg, Ann", "\n".join(lines)))
        want[i] = {k + 1 for k, x in enumerate(lines) if x in menu or x in foot or x == ad}
    df = spark.createDataFrame(rows, "id bigint, url string, name string, cleaned_text string")
    net = boilerplate.train(df.filter("id % 25 >= 5"))
    got = boilerplate.furniture_lines(df.filter("id % 25 < 5"), net).filter("furniture").collect()
    found = {(x.id, x.line_no) for x in got}
    true = {(i, k) for i, ks in want.items() if i % 25 < 5 for k in ks}
    assert len(found & true) >= 0.9 * len(true) and len(found & true) >= 0.9 * len(found)


def test_long_abbreviations_link(spark):
    p = ["Christopher Wallingford", "Wallingford, Christopher", "Chr. Wallingford", "Christo. Wallingford", "Christop. Wallingford", "Mr Wallingford"]
    assert resolved(spark, p) == [set(p)]


def test_links_beyond_the_hub(spark):
    """Two spellings that are near each other but not to the best supported name of their block."""
    data = [("GB", n, None) for n in ["Ann Hofmann"] * 50 + ["Hofmann, Ann"] * 20 + ["Ann Hoffman"] * 20 + ["Hoffman, Ann"] * 10 + ["Ann Hofwman"]]
    out: dict = {}
    for r in names.resolve(spark.createDataFrame(data, MENTIONS)).collect():
        out.setdefault(r.entity, set()).add(r.name)
    assert cluster_of(out.values(), "Ann Hofwman") == {"Ann Hofwman", "Ann Hoffman", "Hoffman, Ann"}


def test_all_initials_decide(spark):
    p = ["John Paul Smithers", "Smithers, John Paul", "James Robert Smithers", "Smithers, James Robert", "J. P. Smithers", "J. R. Smithers", "J. Smithers"]
    g = resolved(spark, p)
    assert cluster_of(g, "J. P. Smithers") == {"John Paul Smithers", "Smithers, John Paul", "J. P. Smithers"}
    assert cluster_of(g, "J. R. Smithers") == {"James Robert Smithers", "Smithers, James Robert", "J. R. Smithers"} and cluster_of(g, "J. Smithers") == {"J. Smithers"}


def test_merged_profiles_are_matched_again(spark):
    """The typo of a family name comes in by a record without given name and makes a second profile's spelling its own."""
    p = ["Edward Grambonley", "Grambonley, Edward", "Mr Gramboneley", "Mr E. Gramboneley", "Edward Gramboneley"]
    assert resolved(spark, p) == [set(p)]


def test_typed_keys_agree(spark):
    """Two words share a key that stands for agreement exactly if they are near."""
    r = random.Random(2)
    ws = {"".join(r.choice("abe") for _ in range(r.randint(4, 6))) for _ in range(60)}
    df = spark.createDataFrame([(w,) for w in sorted(ws)], "w string").select("w", names._typed(F.col("w")).alias("keys"))
    keys = {x.w: set(x["keys"]) for x in df.collect()}
    for a in ws:
        for b in ws:
            if a < b and near(a, b):
                shared = keys[a] & keys[b]
                assert any(k[0] not in "-" for k in shared) or {"-" + a, "-" + b} & shared


def test_hot_entity_is_split(spark, monkeypatch):
    monkeypatch.setattr(names, "PART", 7)
    df = spark.createDataFrame([("GB", f"n{i:03d}", 1) for i in range(50)] + [("GB", "x", 2)], "country string, name string, entity bigint")
    assert names.variant_pairs(df).distinct().count() == names.variant_pairs(df).count() == 50 * 49 // 2


def test_names_take_few_jobs(spark):
    """Each job and broadcast of a plan costs the driver memory, whatever the size of the tables."""
    p = ["Citizens' Rally of the Orchard", "Citizens' Rally o. t. Orchard", "Orchard Rally", "CRO", "Progressive Quarry Union", "Quarry Union", "PQU"]
    df = spark.createDataFrame([("GB", n, n in p) for n in PEOPLE + p], MENTIONS)
    begun = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    was = begun()
    assert names.resolve(df).count() > 20
    assert begun() - was <= 125  # 101; 168 with a join for each block and look-up


def test_nicknames_of_a_profile_stay(spark):
    """A record that joined a profile has no nicknames of its own, whichever row comes first."""
    rows = [(1, "GB", "smithers", "edward", 1, True, []), (1, "GB", "smithers", "edward", 2, True, ["ted"])]
    for part in (rows, rows[::-1]):
        df = spark.createDataFrame(part, "pid bigint, country string, fam1 string, given string, n bigint, known boolean, mates array<string>").coalesce(1)
        assert [(r.total, r.mates) for r in names._spellings(df).collect()] == [(3, ["ted"])]
