"""Lines of a web page as text, with what the page's address tells: the speaker's name and the site's."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_FOLD = str.maketrans({"ß": "ss", "ł": "l", "ø": "o", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"})
#: Parts of a host that aren't the site's name.
HOST_PARTS = frozenset("www m en de fr es sv org gov news example com net info co".split())


_MARKS = re.compile("[\u0300-\u036f]")


@lru_cache(maxsize=50_000)
def _fold(s: str) -> str:
    s = _MARKS.sub("", unicodedata.normalize("NFKD", s.lower())).translate(_FOLD)
    return " ".join(s.split())


def fold(s: str) -> str:
    """Without accents, in lower case, white space collapsed."""
    if s.isascii():
        return " ".join(s.lower().split())
    return _fold(s) if len(s) < 200 else _fold.__wrapped__(s)


@lru_cache(maxsize=20_000)
def _name_re(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + r")(?:s|'s|’s)?\b")


@lru_cache(maxsize=20_000)
def _site_re(site: str) -> re.Pattern:
    return re.compile(r"[\W_]*".join(map(re.escape, site)))


def address(url: str | None) -> tuple[list[str], str]:
    """(folded words of the name, squashed site name) of an address; empty where it tells none."""
    m = re.match(r"^[a-z]+://([^/?#]+)([^?#]*)", url or "")
    if not m:
        return [], ""
    site = "".join(p for p in m.group(1).split(".") if p not in HOST_PARTS).replace("-", "")
    slug = [w for w in re.split(r"[-_/]", m.group(2).rstrip("/").rsplit("/", 1)[-1]) if w and not w.isdigit()]
    return [fold(w) for w in slug], site


#: Words beside a name that aren't part of it, and particles.
BESIDE = frozenset("mr mrs ms dr prof sir dame lord lady hon rt the von van der den de del della di da do dos das du la le les zu zum af av".split())


def name_words(name: str | None) -> tuple[list[str], list[str]]:
    """(folded words, family name's words) of a typed name."""
    head = (name or "").split(",")[0]
    words = [w for w in re.findall(r"[^\W\d_]+", fold(name or "")) if len(w) >= 2 and w not in BESIDE]
    own = [w for w in re.findall(r"[^\W\d_]+", fold(head)) if len(w) >= 3 and w not in BESIDE]
    return words, own if "," in (name or "") else own[-1:]


class Page:
    """Folds lines and finds the name and the site in them. The name comes from the speaker's record and from the address, if that tells one."""

    def __init__(self, url: str | None, name: str | None = None):
        self.name, self.site = address(url)
        long = [w for w in self.name if len(w) >= 4]
        self.family = (self.name[-1:] if self.name and len(self.name[-1]) >= 3 else long[-1:]) or []
        self.told = bool(self.name)  # the address spells the name as the page does
        words, family = name_words(name)
        self.name += [w for w in words if w not in self.name]
        self.family += [w for w in family if w not in self.family]
        self.name_re = _name_re(tuple(self.name)) if self.name else None
        self.site_re = _site_re(self.site) if len(self.site) >= 3 else None

    def names_speaker(self, folded: str) -> bool:
        return any(w in folded for w in self.family)

    def mask(self, folded: str) -> str:
        if self.site_re and self.site[:2] in folded:
            folded = self.site_re.sub("\x01", folded)
        return self.name_re.sub("\x02", folded) if self.name_re and any(w in folded for w in self.name) else folded

    def is_title(self, line: str, folded: str) -> bool:
        """Whether a line is only the speaker's name and years; a spelling of the given name unlike the record's may stand beside it."""
        left = [t for t in _TOKEN.findall(self.mask(folded)) if not t.isdigit()]
        if not left:
            return True
        return not self.told and len(left) <= 2 and not _MARK.search(line) and all(t[:1].isupper() or t[:1].isdigit() for t in line.split())


_TOKEN = re.compile(r"[^\W_]+")
_MARK = re.compile(r"[.!?:»›>|·/]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)")


@lru_cache(maxsize=200_000)
def frames(line: str) -> tuple[str, ...]:
    """The sentences of a line, folded; numbers and words with a capital inside the sentence are slots, so that equal ones align."""
    out = []
    for s in _SENTENCE.split(line.strip()):
        o: list[str] = []
        for k, w in enumerate(s.split()):
            g = "0" if w[:1].isdigit() else "^" if k and w[:1].isupper() else fold(w).strip(".,:;")
            if g != "^" or not o or o[-1] != "^":
                o.append(g)
        out.append(" ".join(o))
    return tuple(out)
