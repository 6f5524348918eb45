"""Variant spellings of typed names: merge-and-rematch resolution over blocks.

Every distinct (country, string) is read once. Words are told to be given or family names by how the whole corpus uses them.
Records that carry a family and a given name begin as one profile per (country, family, given); then rounds follow:

1. *Merge*: profiles that share a block and agree are merged. Blocks are (country, family, key of the given name) and (country,
   given, key of the family name). Keys are such that the rows of a block agree with each other, or all with the one whose word is the key: a word
   with one letter masked, a word with one letter cut, its nicknames, the longer names it begins. So one comparison for each row finds every link.
2. *Rematch*: merged profiles union their spellings and initials. Records with initials or the family name only look for the
   profiles of that family whose given names begin so; they join if there is exactly one, and bring it their spellings of the family name. Family names
   no profile has are looked up by deletion key. Then the richer profiles are merged again.

Both are repeated until no record changes its profile. Party names do the same with word sets, pairs of words and acronyms as keys.
No step compares all members of a group, and nothing but (country, letter) counts is assumed small.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut
from . import name_parse as np_

RECORD = """country string, name string, rid bigint, n bigint, kind string, long array<string>, inits array<string>, abbr array<string>, alias array<string>,
 fam array<string>, giv array<string>, lead_init boolean, toks array<string>, acr string, squash string, plain string"""
#: Share of the names a letter leads that give the whole name too, from which it is an address in a country ("M. Jean Morel") and no initial.
POLITE = 0.05
#: Family names shorter than this are only linked when spelled alike.
FUZZY_LEN = 5


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["kind", "long", "inits", "abbr", "alias", "fam", "giv", "lead_init", "toks", "acr", "squash", "plain"]
    for pdf in batches:
        out = []
        for name, hint in zip(pdf["name"], pdf["hint"]):
            row: dict = {}
            if np_.is_party(name, bool(hint)):
                row = (p := np_.parse_party(name)) and {"kind": "g"} | p or {}
            elif p := np_.parse_person(name):
                row = {"kind": "p"} | p
            out.append([row.get(c) for c in cols])
        res = pd.concat([pdf[["country", "name", "rid", "n"]].reset_index(drop=True), pd.DataFrame(out, columns=cols)], axis=1)
        yield res[res["kind"].notna()]


def _look(w: Column) -> Column:
    for a, b in np_.LOOKS:
        w = F.replace(w, F.lit(a), F.lit(b))
    return w


def _dels(w: Column) -> Column:
    """A word's deletion keys and the form without scanning confusions; null and short words have none."""
    n = F.length(w)
    cuts = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    return F.when(n >= 4, F.array_distinct(F.concat(F.array(w, _look(w)), cuts)))


def _typed(w: Column) -> Column:
    """Keys of which two words within one edit, a swap or a scanning confusion share one: a letter masked (``*``), cut or none (``-``), the letters sorted (``~``),
    the form without confusions (``=``). Under ``*`` and ``=`` all words agree with each other, under ``-`` with the one that is the key."""
    n = F.length(w)
    at = F.sequence(F.lit(1), n)
    cut_ = F.transform(at, lambda i: F.concat(F.lit("-"), F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    mask = F.transform(at, lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.lit("*"), F.substr(w, i + 1)))
    sorted_ = F.concat(F.lit("~"), F.array_join(F.array_sort(F.split(w, "")), ""))
    return F.when(n >= 4, F.array_distinct(F.concat(F.array(F.concat(F.lit("-"), w), F.concat(F.lit("="), _look(w)), sorted_), mask, cut_)))


def _near(a: Column, b: Column) -> Column:
    """Within one edit, a swap of neighbours, or letters that scanning mixes up."""
    lev = F.levenshtein(a, b)
    swap = (F.length(a) == F.length(b)) & (lev == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (lev <= 1) | swap | (_look(a) == _look(b))


def _roles(words: pd.Series, long: pd.Series, fam: pd.Series, giv: pd.Series, inits: pd.Series, abbr: pd.Series, lead: pd.Series) -> pd.DataFrame:
    out, nicks = [], np_.nickname_pairs()
    for ws, ls, f, g, ini, ab, ld in zip(words, long, fam, giv, inits, abbr, lead):
        stat = {w["w"]: w for w in ws}
        ls, f, g, ini, ab = list(ls), list(f), list(g), list(ini), list(ab)

        def given_like(w: str) -> bool:
            s = stat[w]
            return (s["gv"] > s["fv"] and (s["gv"] >= 2 or s["deg"] >= 3)) or (s["deg"] >= 8 and s["fv"] * 4 <= s["deg"])

        if not f:
            known = [w for w in ls if given_like(w)]
            if len(ls) == 1:
                f = ls
            elif known and len(known) < len(ls):
                g, f = known, [w for w in ls if w not in known]
            elif known:
                f = [max(enumerate(ls), key=lambda x: (stat[x[1]]["fv"] - stat[x[1]]["gv"], -stat[x[1]]["deg"], x[0]))[1]]
                g = [w for w in ls if w != f[0]]
            elif ab or ini or ld:
                f = ls
            else:
                voted = [w for w in ls if stat[w]["fv"] > 0 and stat[w]["fv"] >= stat[w]["gv"]]
                if voted:
                    g, f = [w for w in ls if w not in voted], voted
                else:
                    top = max(ls, key=lambda w: stat[w]["deg"])
                    first = top if stat[top]["deg"] >= 4 and not voted else ls[0]
                    g, f = [first], [w for w in ls if w != first]
        f = f or ls[-1:]
        first = ab[0] if ab and not g else ini[0] if ini and not g else ""
        more = [w[0] for w in g[1:]] + ini if g else ini if ab else ini[1:]
        out.append((f[0], f[1] if len(f) > 1 else None, g[0] if g else None, bool(g) and given_like(g[0]), first, more[0] if more else "", sorted(nicks.get(g[0], ())) if g else []))
    return pd.DataFrame(out, columns=["fam1", "fam2", "given", "known", "prefix", "second", "nicks"])


def _jump(par: DataFrame) -> DataFrame:
    """``pid, hub`` with every hub replaced by the last one of its chain; ``par`` is a checkpoint."""
    while True:
        nxt = par.alias("a").join(par.alias("b"), F.col("a.hub") == F.col("b.pid"), "left").select(F.col("a.pid").alias("pid"), F.coalesce("b.hub", "a.hub").alias("hub"), F.col("b.hub").isNotNull().alias("moved"))
        nxt = cut(nxt)
        if nxt.filter("moved").isEmpty():
            return nxt.select("pid", "hub")
        par = nxt.select("pid", "hub")


def _star(s: DataFrame, keys: list[str], exact: Column, same: Column) -> DataFrame:
    """Edges ``pid, hub, hub_n`` of the rows of ``s`` to the row of their block that is ``exact``, else to the best supported one, where ``same`` (over ``w, h.*, lo, hi``) holds; ``lo`` and
    ``hi`` are the block's first and last profile of exact rows. A window and no join: the rows of a block move once, and nothing goes through the driver."""
    w = W.partitionBy(*keys)
    only = F.when(exact, F.col("pid"))
    j = s.withColumns({"h": F.max(F.struct(exact.alias("exact"), "total", "pid", "fam1", "given", "known")).over(w), "lo": F.min(only).over(w), "hi": F.max(only).over(w)}).filter(F.col("pid") != F.col("h.pid"))
    # a merge goes to the better supported profile, so that chains end
    up = F.struct("h.total", "h.pid") > F.struct("total", "pid")
    return j.filter(same).select(F.when(up, F.col("pid")).otherwise(F.col("h.pid")).alias("pid"), F.when(up, F.col("h.pid")).otherwise(F.col("pid")).alias("hub"), F.when(up, F.col("h.total")).otherwise(F.col("total")).alias("hub_n"))


def _relabel(strong: DataFrame, edges: DataFrame) -> tuple[DataFrame, bool]:
    par = cut(edges.groupBy("pid").agg(F.max_by("hub", F.struct("hub_n", "hub")).alias("hub")))
    if par.isEmpty():
        return strong, False
    par = _jump(par)
    return cut(strong.join(par, "pid", "left").withColumn("pid", F.coalesce("hub", "pid")).drop("hub")), True


def _spellings(rec: DataFrame) -> DataFrame:
    # records that joined a profile come without nicknames, hence the largest list; one exchange serves both sums
    s = rec.repartition("pid").groupBy("pid", "country", "fam1", "given").agg(F.sum("n").alias("n"), F.max("known").alias("known"), F.max("mates").alias("mates"))
    return s.withColumn("total", F.sum("n").over(W.partitionBy("pid")))


def _merge_strong(strong: DataFrame) -> DataFrame:
    """``strong`` with the profiles relabelled until no two of a block agree.

    All blocks are made at once; the first letter of a key tells of what: ``g`` given names of a family, ``f`` family names of a given name, ``b`` the given names
    of a family that begin so (exact, as they are longer than the key) and the one that is the key."""
    none = F.array().cast("array<string>")
    side = F.substr("key", F.lit(1), F.lit(1))
    of = lambda x, keys: F.transform(keys, lambda k: F.concat(F.lit(x), k))
    while True:
        s = _spellings(strong)
        given = F.concat(F.coalesce(of("g", _typed(F.col("given"))), none), F.array(F.concat(F.lit("g@"), "given")), of("g@", F.col("mates")))
        fam = F.when(F.length("fam1") >= FUZZY_LEN - 1, F.coalesce(of("f", _typed(F.col("fam1"))), none)).otherwise(none)
        begins = F.when(F.length("given") > 3, F.transform(F.sequence(F.lit(3), F.length("given") - 1), lambda k: F.concat(F.lit("b"), F.substr("given", F.lit(1), k)))).otherwise(none)
        begun = F.when(~F.col("known") & (F.length("given") >= 3), F.array(F.concat(F.lit("b"), "given"))).otherwise(none)
        s = s.withColumn("key", F.explode(F.concat(given, fam, begins, begun))).withColumn("of", F.when(side == "f", F.col("given")).otherwise(F.col("fam1")))
        exact = F.when(side == "b", F.col("key") != F.concat(F.lit("b"), "given")).otherwise(F.col("key") == F.concat(side, F.lit("-"), F.when(side == "f", F.col("fam1")).otherwise(F.col("given"))))
        nick = F.array_contains("mates", F.col("h.given")) | (F.col("given") == F.col("h.given"))
        typo = _near(F.col("given"), F.col("h.given")) & (F.length("given") >= 4) & ~(F.col("known") & F.col("h.known"))
        fams = (F.length("fam1") >= FUZZY_LEN) & _near(F.col("fam1"), F.col("h.fam1"))
        # a shortened given name joins the profile of that family whose given name it begins, if there is one only
        short = ~exact & F.col("h.exact") & (F.col("lo") == F.col("hi"))
        strong, moved = _relabel(strong, _star(s, ["country", "of", "key"], exact, F.when(side == "g", nick | typo).when(side == "f", fams).otherwise(short)))
        if not moved:
            return strong


def _lookup(todo: DataFrame, strong: DataFrame) -> DataFrame:
    """``rid, pid, has, fits`` of the records without given name (whether any profile has the family name, whether one has the initial too): found profiles by family and beginning of the given name, first as spelled, else by deletion key."""
    s = strong.filter("fam1 IS NOT NULL").select("country", "fam1", "fam2", "given", "second", "pid")
    both_fams = F.when(F.col("fam2").isNotNull(), F.concat_ws(" ", "fam1", "fam2"))
    begins = F.transform(F.sequence(F.lit(0), F.length("given")), lambda k: F.substr("given", F.lit(1), k))
    two_letters = F.when(F.col("second") != "", F.array(F.concat(F.substr("given", F.lit(1), F.lit(1)), F.lit(" "), "second"))).otherwise(F.array().cast("array<string>"))
    table = s.select("country", F.explode(F.array_compact(F.array("fam1", both_fams))).alias("fkey"), "given", "second", "pid").select("country", "fkey", F.explode(F.concat(begins, two_letters)).alias("start"), "pid")
    table = table.groupBy("country", "fkey", "start").agg(F.min("pid").alias("lo"), F.max("pid").alias("hi"))
    # All a record looks for, in one join: both family names or the first with its initial, the first with all initials, the first alone
    letters = F.when((F.col("prefix") != "") & (F.col("second") != ""), F.concat(F.substr("prefix", F.lit(1), F.lit(1)), F.lit(" "), "second"))
    look = [("two", both_fams, F.col("prefix")), ("one", F.col("fam1"), F.col("prefix")), ("both", F.when(letters.isNotNull(), F.col("fam1")), letters), ("any", F.col("fam1"), F.lit(""))]
    t = todo.select("rid", "country", "fam1", "prefix", F.explode(F.array(*[F.struct(F.lit(k).alias("what"), f.alias("fkey"), p.alias("start")) for k, f, p in look])).alias("x")).select("rid", "country", "fam1", "prefix", "x.*").filter("fkey IS NOT NULL")
    one_only = F.col("lo") == F.col("hi")
    hit = lambda k: F.max(F.when((F.col("what") == k) & one_only, F.col("lo")))
    t = t.join(table, ["country", "fkey", "start"], "left").groupBy("rid", "country", "fam1", "prefix").agg(hit("two").alias("pid2"), hit("one").alias("pid1"), hit("both").alias("pid0"), F.max((F.col("what") == "one") & F.col("lo").isNotNull()).alias("begun"), F.max((F.col("what") == "any") & F.col("lo").isNotNull()).alias("has"))
    # all initials where one isn't enough
    t = cut(t.select("rid", "country", "fam1", "prefix", F.coalesce("pid2", "pid1", "pid0").alias("pid"), "has", (F.col("begun") | F.col("pid2").isNotNull()).alias("fits")))
    # Family names that no profile has: by deletion key
    lost = t.filter(~F.col("has") & (F.length("fam1") >= FUZZY_LEN)).select("rid", "country", F.col("fam1").alias("typed"), "prefix").withColumn("key", F.explode(_dels(F.col("typed"))))
    near = s.filter(F.length("fam1") >= FUZZY_LEN).select("country", "fam1", F.substr("given", F.lit(1), F.lit(1)).alias("g1"), "pid").distinct().withColumn("key", F.explode(_dels(F.col("fam1"))))
    hits = lost.join(near, ["country", "key"]).filter(_near(F.col("typed"), F.col("fam1")) & ((F.col("prefix") == "") | (F.substr("prefix", F.lit(1), F.lit(1)) == F.col("g1"))))
    none = F.lit(None)
    t = t.select("rid", "pid", "has", "fits", none.cast("bigint").alias("hit")).unionByName(hits.select("rid", none.cast("bigint").alias("pid"), none.cast("boolean").alias("has"), none.cast("boolean").alias("fits"), F.col("pid").alias("hit")))
    t = t.groupBy("rid").agg(F.max("pid").alias("pid"), F.max("has").alias("has"), F.max("fits").alias("fits"), F.min("hit").alias("lo"), F.max("hit").alias("hi"))
    return t.select("rid", F.coalesce("pid", F.when(F.col("lo") == F.col("hi"), F.col("lo"))).alias("pid"), (F.col("has") | F.col("lo").isNotNull()).alias("has"), "fits")


def _persons(rec: DataFrame) -> DataFrame:
    """``rid, pid``."""
    tok = rec.select("rid", "country", F.explode("long").alias("w"), "long", "fam", "giv")
    # a row without v for the votes of each use, one for each other word beside it
    beside = F.concat(F.array(F.lit(None).cast("string")), F.filter("long", lambda v: v != F.col("w")))
    votes = tok.select("w", F.explode(beside).alias("v"), *[F.array_contains(c, F.col("w")).cast("int").alias(c) for c in ("fam", "giv")])
    lex = votes.groupBy("w").agg(*[F.sum(F.when(F.col("v").isNull(), F.col(c))).alias(k) for c, k in (("fam", "fv"), ("giv", "gv"))], F.count_distinct("v").alias("deg"))
    words = tok.select("rid", "w").join(lex, "w").groupBy("rid").agg(F.collect_set(F.struct("w", "fv", "gv", "deg")).alias("words"))
    role = F.pandas_udf(_roles, "fam1 string, fam2 string, given string, known boolean, prefix string, second string, nicks array<string>")
    rec = rec.join(words, "rid").withColumn("r", role("words", "long", "fam", "giv", "inits", "abbr", "lead_init"))
    rec = cut(rec.select("rid", "country", "n", "r.*", "alias", F.element_at(F.array_union("inits", F.array(F.lit(""))), 1).alias("i0"), "lead_init"))
    # Two words without a known given name that are elsewhere the two family names after one
    double = rec.filter("known AND fam2 IS NOT NULL").select("country", F.col("fam1").alias("given"), F.col("fam2").alias("fam1"), F.lit(True).alias("double")).distinct()
    rec = rec.join(double, ["country", "given", "fam1"], "left").withColumn("double", F.coalesce(F.col("double") & ~F.col("known") & F.col("fam2").isNull(), F.lit(False)))
    rec = rec.withColumns({"fam2": F.when(F.col("double"), F.col("fam1")).otherwise(F.col("fam2")), "fam1": F.when(F.col("double"), F.col("given")).otherwise(F.col("fam1")), "given": F.when(~F.col("double"), F.col("given"))}).drop("double")
    rec = cut(rec)  # read four times below, else each reading would plan and run the join again
    # A letter that stands before full names in a country is an address, not an initial
    base = rec
    leads = base.filter("lead_init").groupBy("country", F.col("i0").alias("prefix")).agg(F.sum(F.col("given").isNotNull().cast("int")).alias("whole"), F.count(F.lit(1)).alias("uses"))
    polite = leads.filter(F.col("whole") - 1 >= POLITE * (F.col("uses") + 3)).select("country", "prefix", F.lit(True).alias("polite"))
    rec = rec.join(polite, ["country", "prefix"], "left").withColumn("prefix", F.when(F.col("polite") & F.col("lead_init"), F.lit("")).otherwise(F.col("prefix"))).drop("polite", "i0", "lead_init")
    learned = base.filter("given IS NOT NULL").select("given", F.explode("alias").alias("mate")).filter("given <> mate")
    learned = learned.select(F.explode(F.array(F.struct("given", "mate"), F.struct(F.col("mate").alias("given"), F.col("given").alias("mate")))).alias("x")).groupBy("x.given").agg(F.collect_set("x.mate").alias("learned"))
    none = F.array().cast("array<string>")
    rec = rec.join(learned, "given", "left").withColumn("mates", F.array_distinct(F.concat(F.coalesce("learned", none), F.when(F.col("given").isNotNull(), F.col("nicks")).otherwise(none)))).drop("learned", "alias", "nicks")
    rec = cut(rec)
    strong = cut(rec.filter("given IS NOT NULL").withColumns({"pid": F.xxhash64("country", F.lit("s"), "fam1", "given"), "own": F.lit(True)}))
    weak = rec.filter("given IS NULL")
    state, more = None, None
    while True:
        both = strong if more is None else strong.unionByName(more, allowMissingColumns=True)
        both = _merge_strong(both)
        strong = cut(both.filter("own"))
        got = _lookup(weak, both)
        # Initials that fit no profile found one of their own, family names alone likewise; an ambiguous record stays alone
        rest = weak.join(got, "rid").withColumn("pid", F.when(F.col("pid").isNotNull(), F.col("pid")).when(~F.col("has") | ((F.col("prefix") != "") & ~F.col("fits")), F.xxhash64("country", F.lit("w"), "fam1", "prefix")))
        rest = cut(rest.drop("fits", "has"))
        now = strong.select("rid", "pid").unionByName(rest.select("rid", "pid")).agg(F.sum(F.xxhash64("rid", "pid").cast("decimal(38, 0)"))).first()[0]
        if now == state:
            break
        state = now
        # The profiles take over the spellings of the records that joined, with their own given names, and are merged again
        given = strong.groupBy("pid").agg(F.max_by("given", F.struct("n", "given")).alias("g"))
        more = rest.filter("pid IS NOT NULL").join(given, "pid", "left").withColumns({"given": F.coalesce("g", F.when(F.col("prefix") != "", F.col("prefix"))), "known": F.col("g").isNotNull(), "own": F.lit(False)}).filter("given IS NOT NULL").drop("g")
        more = cut(more)
    return strong.select("rid", "pid").unionByName(rest.select("rid", F.coalesce("pid", "rid").alias("pid")))


def _parties(rec: DataFrame) -> DataFrame:
    """``rid, pid``."""
    rec = cut(rec.select("rid", "country", "n", "toks", "acr", "squash", "plain"))
    full = rec.filter(F.size("toks") >= 3).withColumns({"pid": F.xxhash64("country", F.lit("g"), "squash"), "fam1": F.col("plain"), "given": F.lit(""), "known": F.lit(True), "mates": F.array().cast("array<string>")})
    full = cut(full)
    pairs = F.transform(F.filter(F.flatten(F.transform("toks", lambda a: F.transform("toks", lambda b: F.struct(a.alias("a"), b.alias("b"))))), lambda p: p.a < p.b), lambda p: F.concat_ws(" ", p.a, p.b))
    keyed = lambda d: d.withColumn("key", F.explode(F.concat(pairs, F.transform("toks", lambda t: F.concat(F.lit("1 "), t)))))
    own, hub = F.array_join(F.array_sort(F.array_except("toks", "h.toks")), ""), F.array_join(F.array_sort(F.array_except("h.toks", "toks")), "")
    agree = (hub == "") | _near(own, hub) | ((F.length(own) >= 3) & F.startswith(hub, own))
    moved = True
    while moved:
        # spellings within one edit; then names that share two words and whose other words agree or are missing. Those that don't agree with the best
        # supported one of their pair are held against the best of what is left, until nothing is
        s = _spellings(full).withColumn("key", F.explode(_typed(F.col("fam1"))))
        e = _star(s, ["country", "key"], F.col("key") == F.concat(F.lit("-"), "fam1"), _near(F.col("fam1"), F.col("h.fam1")))
        totals = full.select("country", "pid", F.sum("n").over(W.partitionBy("pid")).alias("total"), "toks").distinct()
        left = keyed(totals).filter("key NOT LIKE '1 %'")
        while True:
            best = F.max(F.struct("total", "pid", "toks")).over(W.partitionBy("country", "key"))
            met = cut(left.withColumn("h", best).filter(F.col("pid") != F.col("h.pid")).withColumn("agree", agree))
            e = e.unionByName(met.filter("agree").select("pid", F.col("h.pid").alias("hub"), F.col("h.total").alias("hub_n")))
            left = met.filter("NOT agree").drop("h", "agree")
            if left.isEmpty():
                break
        full, moved = _relabel(full, e)
    # A word or pair of words names a party if one party holds nearly all of its uses in the country
    use = keyed(full).groupBy("country", "key", "pid").agg(F.sum("n").alias("u"))
    hub = cut(use.groupBy("country", "key").agg(F.max_by("pid", F.struct("u", "pid")).alias("hub"), F.max("u").alias("u"), F.sum("u").alias("all_u")).filter("u >= 0.9 * all_u").select("country", "key", "hub"))
    short = rec.filter((F.size("toks") > 0) & (F.size("toks") < 3))
    # a short name has one key: its word or its pair
    short = cut(keyed(short).filter((F.size("toks") == 1) | ~F.startswith("key", F.lit("1 "))).join(hub, ["country", "key"], "left").select("rid", "country", "plain", "squash", F.col("hub").alias("pid")))
    acr = full.filter("length(acr) >= 2").groupBy("country", "acr", "pid").agg(F.sum("n").alias("u")).groupBy("country", "acr").agg(F.max_by("pid", F.struct("u", "pid")).alias("pid"), F.max("u").alias("u"), F.sum("u").alias("all_u")).filter("u >= 0.9 * all_u")
    letters = rec.filter(F.size("toks") == 0).join(acr.select("country", "acr", "pid"), ["country", "acr"], "left").select("rid", F.coalesce("pid", F.xxhash64("country", F.lit("a"), "acr")).alias("pid"))
    # Short forms with a typo: by deletion key of the whole form to a short or full form of one party
    known = cut(full.select("country", "plain", "pid").unionByName(short.filter("pid IS NOT NULL").select("country", "plain", "pid")).distinct())
    lost = short.filter("pid IS NULL").filter(F.length("plain") >= FUZZY_LEN)
    hits = lost.select("rid", "country", F.col("plain").alias("typed"), F.explode(_dels(F.col("plain"))).alias("key")).join(known.withColumn("key", F.explode(_dels(F.col("plain")))), ["country", "key"])
    hits = hits.filter(_near(F.col("typed"), F.col("plain"))).groupBy("rid").agg(F.min("pid").alias("lo"), F.max("pid").alias("hi")).filter("lo = hi").select("rid", "lo")
    left = short.join(hits, "rid", "left").select("rid", F.coalesce("pid", "lo", F.xxhash64("country", F.lit("g"), "squash")).alias("pid"))
    return full.select("rid", "pid").unionByName(letters).unionByName(left)


def resolve(mentions: DataFrame) -> DataFrame:
    """``country, name, entity``: one row per distinct (country, name) that can name a person or party.

    ``mentions``: ``country string, name string, is_party boolean`` (true where the string is known to name a party; may be null), any
    number of rows per string; other columns are ignored. Null countries and null names don't count, strings are compared as they
    are. Labels, offices and strings without letters are absent. A family name that several people of the country bear, without
    given name or initial, gets an entity of its own. An empty table gives no rows.
    """
    m = mentions.filter("country IS NOT NULL AND name IS NOT NULL").groupBy("country", "name").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("is_party", F.lit(False))).alias("hint"))
    m = m.withColumn("rid", F.xxhash64("country", "name"))
    rec = cut(m.mapInPandas(_parse, RECORD))
    ids = _persons(rec.filter("kind = 'p'")).unionByName(_parties(rec.filter("kind = 'g'")))
    return rec.select("country", "name", "rid").join(ids, "rid").select("country", "name", F.col("pid").alias("entity"))


#: Spellings of an entity that one task pairs with all others.
PART = 1000


def variant_pairs(resolved: DataFrame) -> DataFrame:
    """``country, name_a, name_b``: the pairs of spellings of one entity, ``name_a < name_b`` in byte order. An entity of many spellings is split over tasks."""
    r = cut(resolved)
    parts = r.groupBy("country", "entity").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    r = r.join(parts, ["country", "entity"])
    a = r.withColumnRenamed("name", "name_a").withColumn("part", F.pmod(F.xxhash64("name_a"), F.col("parts")).cast("int"))
    b = r.withColumnRenamed("name", "name_b").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return a.join(b.drop("parts"), ["country", "entity", "part"]).filter("name_a < name_b").select("country", "name_a", "name_b")
