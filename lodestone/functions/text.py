"""Column expressions for text, names, dates and validation, JVM-side wherever the engine has a form."""

from __future__ import annotations

import difflib
import json
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

#: Roles that make a person-typed target a government.
GOVERNMENT_ROLES = r"(?i)(minister|chancellor|kanzler|staatssekret|secretary of state|state secretary)"
#: Phrases that tell a bloc; the first match wins.
BLOCS = (
    ("opposition", r"(?i)\b(the )?opposition\b|those opposite|\bother side\b|opposite benches?"),
    ("government", r"(?i)\b(the )?government\b|treasury benches?|\bcabinet\b"),
    ("left", r"(?i)\bthe left\b|\bleft wing\b|\bleftists?\b"),
    ("right", r"(?i)\bthe right\b|\bright wing\b|\brightists?\b"),
)
#: Titles before a name, each followed by white space; they may be stacked.
TITLES = (
    r"(?:the\s+)?(?:federal\s+)?(?:minister|bundesminister(?:in)?|staatssekretär(?:in)?|präsident(?:in)?|abg\.?|mag\.?|dr\.?|dipl\.?-?\s?ing\.?|prof\.?|mr|mrs|ms|miss|hon\.?)\s+"
)
#: Words left out of a party key.
KEY_STOP = ("the", "party", "parties", "of", "and", "for", "a", "an")
BLACKLIST = ("facebook.com", "twitter.com", "instagram.com", "linkedin.com", "youtube.com")


def text_or_null(c: Column) -> Column:
    """Trimmed; empty and the text ``nan`` become null."""
    t = F.trim(c)
    return F.when((t == "") | (F.lower(t) == "nan"), F.lit(None)).otherwise(t)


def year_of(c: Column) -> Column:
    """Year of an ISO-prefixed date text; null where the first four characters are no digits."""
    return F.when(c.rlike("^[0-9]{4}"), F.substring(c, 1, 4).try_cast("int"))


def month_of(c: Column) -> Column:
    return F.when(F.length(c) >= 7, F.substring(c, 1, 7))


def per_10k(num: Column, den: Column) -> Column:
    return F.when(den > 0, F.round(num * 10000.0 / den, 6))


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0a-\x1f]", "")


def word_count(c: Column) -> Column:
    t = collapse_ws(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("bigint")


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def surname(c: Column) -> Column:
    """Family name of a typed name: the last word before a comma, else the last word after its stacked titles; casefolded, '' if none."""
    n = F.trim(F.coalesce(c, F.lit("")))
    n = F.when(F.contains(n, F.lit(",")), F.trim(F.split(n, ",")[0])).otherwise(F.trim(F.regexp_replace(n, rf"^(?iu:{TITLES})+", "")))
    n = F.trim(F.regexp_replace(n, r"^[.,;:]+|[.,;:]+$", ""))
    return casefold(F.element_at(F.split(n, r"\s+"), -1))


def bloc(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(BLOCS):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def titlecase_caps(c: Column) -> Column:
    """All-capitals words capitalised; one-letter words stay as they are."""
    cap = lambda w: F.when((F.length(w) > 1) & (w == F.upper(w)), F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))).otherwise(w)
    return F.array_join(F.transform(F.split(collapse_ws(c), " "), cap), " ")


def person_id(name: Column, country: Column, dataset: Column) -> Column:
    return F.sha1(F.concat_ws("|", name, country, dataset))


def sentences(c: Column) -> Column:
    """Rule-based sentences of three words or more, in order (no parity with trained splitters is claimed)."""
    parts = F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, collapse_ws), lambda s: F.size(F.split(s, " ")) >= 3)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1))


def wikipedia(url: Column) -> Column:
    """``lang, title`` of a Wikipedia article's address, the title decoded; null for any other host."""
    lang = F.regexp_extract(host(url), r"^([a-z]{2,3})\.wikipedia\.org$", 1)
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+/([^?#]*)", 1)
    title = F.try_url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))
    return F.when(lang != "", F.struct(lang.alias("lang"), title.alias("title")))


def page_file(url: Column) -> Column:
    """Stable file name of an address."""
    return F.concat(F.sha1(url), F.lit(".html"))


def flip_name(c: Column) -> Column:
    """``last, full`` of a name given as "Last, First" or plainly."""
    last, first = F.trim(F.split(c, ",", 2)[0]), F.trim(F.split(c, ",", 2)[1])
    comma = F.contains(c, F.lit(","))
    return F.struct(F.when(comma, last).otherwise(F.trim(c)).alias("last"), F.when(comma, F.concat_ws(" ", first, last)).otherwise(F.trim(c)).alias("full"))


def blacklisted(url: Column, domains: tuple[str, ...] = BLACKLIST) -> Column:
    h = host(url)
    out = F.lit(False)
    for d in domains:
        out = out | (h == d) | F.endswith(h, F.lit("." + d))
    return out


def utf8_budget(c: Column, budget: int) -> Column:
    """At most ``budget`` bytes of UTF-8, cut at a character."""

    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else t.encode("utf-8")[:budget].decode("utf-8", "ignore"))

    return F.when(F.octet_length(c) <= budget, c).otherwise(cut(c))


@F.pandas_udf(StringType())
def normal_form(s: pd.Series) -> pd.Series:
    """Without accents, lower case, punctuation as spaces, collapsed (no built-in has the decomposition)."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
        return " ".join(re.sub(r"[^\w\s]|_", " ", t).split())

    return s.map(one)


def content_key(normal: Column) -> Column:
    """Words of a normalised name without stop words, plural s cut off (the stop-word test is on the word as it stands)."""
    kept = F.filter(F.split(normal, " "), lambda w: ~w.isin(*KEY_STOP) & (w != ""))
    stem = lambda w: F.when((F.length(w) > 4) & F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss")), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.array_join(F.transform(kept, stem), " ")


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of pairs; 0 if either is null."""
    cache: dict[tuple[str, str], float] = {}

    def one(x: str | None, y: str | None) -> float:
        if x is None or y is None:
            return 0.0
        if (x, y) not in cache:
            cache[(x, y)] = difflib.SequenceMatcher(None, x, y).ratio()
        return cache[(x, y)]

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """Upper bound of ``ratio`` from lengths alone: prunes pairs before any Python."""
    return F.lit(2.0) * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))


@F.pandas_udf(StringType())
def first_json(s: pd.Series) -> pd.Series:
    """The JSON object or list in fenced or prose-wrapped text, else null."""

    def one(t: str | None) -> str | None:
        if not t:
            return None
        tries = re.findall(r"```(?:json)?\s*(.*?)```", t, re.S) + [t]
        for o, c in (("{", "}"), ("[", "]")):
            i, j = t.find(o), t.rfind(c)
            if 0 <= i < j:
                tries.append(t[i : j + 1])
        for x in tries:
            try:
                return json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True)
            except ValueError:
                continue
        return None

    return s.map(one)


def valid_codes(codes: Column, low: int, high: int) -> Column:
    """Sorted distinct integers of an array of strings within [low, high]; others are dropped."""
    ints = F.transform(codes, lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(ints, lambda x: x.between(low, high))))


#: Elements, and parts of an element's class or id, that hold no content.
HTML_DROP = frozenset(
    ("script", "style", "noscript", "meta", "link", "head", "nav", "header", "footer", "aside", "form", "button", "input", "select", "textarea", "iframe", "object", "embed", "canvas", "svg", "figure")
)
HTML_NOISE = (
    r"(?i)(cookie|consent|gdpr|banner|popup|modal|overlay|social|share|comment|sidebar|widget|newsletter|adverti|sponsor|related|recommend|promo|breadcrumb|pagination|pager|skip-to|site-header|site-footer|search-form|language-switch|nav-menu)"
)
HTML_LIMIT, HTML_LEAST, CUT_MARK = 80_000, 100, "\n[truncated]"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[tuple[str, bool]] = []

    @property
    def quiet(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        noise = any(k in ("class", "id") and v and re.search(HTML_NOISE, v) for k, v in attrs)
        if tag in _VOID:
            self.out.append("\n" if tag in ("br", "hr") else "")
            return
        self.open.append((tag, self.quiet or tag in HTML_DROP or noise))
        if tag not in ("a", "b", "i", "em", "strong", "span"):
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while self.open and self.open.pop()[0] != tag:
                pass
        if tag not in ("a", "b", "i", "em", "strong", "span"):
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.quiet:
            self.out.append(data)


@F.pandas_udf(StringType())
def html_text(s: pd.Series) -> pd.Series:
    """Text of HTML pages: no navigation or other noise, one line per block, at most one blank line; null below the least length, cut at the limit."""

    def one(h: str | None) -> str | None:
        if h is None:
            return None
        p = _Text()
        p.feed(h)
        p.close()
        t = re.sub(r"\n{3,}", "\n\n", "\n".join(" ".join(x.split()) for x in "".join(p.out).split("\n"))).strip()
        if len(t) < HTML_LEAST:
            return None
        return t if len(t) <= HTML_LIMIT else t[:HTML_LIMIT] + CUT_MARK

    return s.map(one)


def _chain(text: str | None, lang: str | None) -> list[str]:
    if not text or not text.strip():
        return []
    if lang == "cs":
        parts = [p.strip() for p in re.split(r"\s{2,}", text) if len(p.strip()) > 5]
        if len(parts) > 1:
            return parts
    parts = [p for p in re.split(r"(?<=[.!?])\s+(?=[A-ZÀ-ÞА-Я\"'„“])", text.strip()) if p]
    if len(parts) == 1 and len(text) > 1000:
        parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+|\n+", text) if p.strip()]
    if len(parts) == 1 and len(text) > 500:
        parts = [p.strip() for p in re.split(r"[.!?;:\n]+", text) if len(p.strip()) > 10] or [text.strip()]
    if len(parts) == 1 and len(parts[0]) > 500:
        out, line = [], ""
        for w in parts[0].split():
            if line and len(line) + 1 + len(w) > 500:
                out.append(line)
                line = w
            else:
                line = f"{line} {w}" if line else w
        parts = [*out, line] if line else out
    return parts


@F.pandas_udf(ArrayType(StringType()))
def split_chain(text: pd.Series, lang: pd.Series) -> pd.Series:
    """Pieces for translation: by double spaces (cs), by sentence ends, then by ever weaker marks, at last by words packed to 500 characters."""
    return pd.Series([_chain(t, v) for t, v in zip(text, lang)])


def clean_name(name: Column, kind: Column, looked_up: Column) -> Column:
    """A speaker's display name by kind of source: looked up by id, title-cased, or as it stands."""
    return F.when(kind == "tei", F.coalesce(looked_up, name)).when(kind == "caps", titlecase_caps(name)).otherwise(collapse_ws(name))
