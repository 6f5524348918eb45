"""Text decoded with a wrong character encoding: code-page swaps as substitution ciphers, learned per source.

A garbled character (or the two to four that one UTF-8 letter became) is a cipher symbol. Which letter a symbol stands for is
learned per source by expectation-maximization: the E step weighs each occurrence's candidate letters by letter bigrams
with its two neighbours (themselves known only as distributions), the M step sums those weights into the source's symbol-to-letter
table. A symbol's candidates are itself and what the byte behind it means in other code pages. Each table is learned twice, by the bigrams of all
sources and by those of the other sources alone, so that a source that is garbled throughout doesn't speak for itself; a swap
counts if more of the words it restores are known than of the words as they stand, each source speaking once. Bigrams are then counted again with the tables
applied. A document gets the most probable letter for each of its symbols, and counts as garbled if that explains its letters better than
the text as it stands; ``translate()`` restores it.

Tables, bigrams and word counts all come from the vocabulary of each source, made by one aggregation over all texts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from math import log
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Code pages a text may have been read with, and single-byte pages it may have been written in.
READ_AS = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp852", "koi8_r", "cp866", "cp1253", "cp1254", "cp1257")
WRITTEN_IN = ("cp1252", "cp1250", "iso8859_2", "cp1251", "mac_roman", "cp437", "cp850", "cp852", "koi8_r", "cp866", "iso8859_5")
FLOOR = 1e-7
#: Nats by which the restored reading must be the better one, and the prior of a symbol not standing for itself.
THRESHOLD, SWAP_PRIOR = 3.0, 0.01
#: Nats that a reading must gain where no word of the corpus speaks for or against it.
ALONE = 30.0
#: Nats against a misread sequence whose signs would stand right after a letter, at each use.
INSIDE = 2.0
#: Nats that a letter may read worse and still be taken if the document's other swaps come from the same pair of pages.
PAIR = 3.0
#: Rows of the sources' tables and bigrams that are held at once; sources beyond it are taken in several turns.
MAX_ROWS = 1_000_000
LOST = "�"


def _byte_of(page: str) -> dict[str, int]:
    """Characters of a page with their bytes; bytes it leaves undefined, and 0x80-0x9F read as Latin-1, are control characters."""
    out = {chr(b): b for b in range(0x80, 0xA0)}
    for b in range(0x80, 0x100):
        out[bytes([b]).decode(page, "replace").replace(LOST, chr(b))] = b
    if page == "cp1252":
        out |= {chr(b): b for b in range(0xA0, 0x100)}
    return out


BYTES = {p: _byte_of(p) for p in READ_AS}
CHARS = {p: [bytes([b]).decode(p, "replace") for b in range(256)] for p in WRITTEN_IN}


def _likely(letter: str, page: str) -> bool:
    """Whether a UTF-8 letter is one that texts hold: Latin, Greek, Cyrillic, punctuation and signs; read as cp1252, of any script. Without
    this bound, plain Cyrillic words are UTF-8 sequences under other pages."""
    o = ord(letter)
    return o < 0x250 or 0x340 <= o < 0x530 or 0x1E00 <= o < 0x20D0 or 0x2100 <= o < 0x2180 or 0x2700 <= o < 0x2740 or o in (0xFEFF, 0xFFFD) or 0xFB00 <= o < 0xFB07 or page == "cp1252"


def _unit_pattern() -> re.Pattern:
    """UTF-8 letters read with one of the pages, the likely ones."""
    alts = []
    for page, m in BYTES.items():
        cls = lambda *spans: "[" + "".join(re.escape(c) for c, b in m.items() if any(lo <= b <= hi for lo, hi in spans)) + "]"  # noqa: B023, E731
        c = cls((0x80, 0xBF))
        if page == "cp1252":
            alts.append(f"{cls((0xC2, 0xDF))}{c}|{cls((0xE0, 0xEF))}{c}{c}|{cls((0xF0, 0xF4))}{c}{c}{c}")
        else:
            alts.append(f"{cls((0xC2, 0xC9), (0xCD, 0xD4))}{c}|{cls((0xE2, 0xE2))}{cls((0x80, 0x82), (0x84, 0x85), (0x9C, 0x9C))}{c}|{cls((0xE1, 0xE1))}{cls((0xB8, 0xBB))}{c}|{cls((0xEF, 0xEF))}{c}{c}")
    return re.compile("|".join(alts))


UNIT = _unit_pattern()
RUN = re.compile(r"[^\x00-\x7f]+")
HAN = re.compile(r"[㐀-鿿-]")


def _one(seq: str) -> list[str]:
    """The letters a sequence of characters is, if it is one UTF-8 letter read with some page."""
    out = []
    for page, m in BYTES.items():
        try:
            t = bytes(m[c] for c in seq).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if len(t) == 1 and t not in out and _likely(t, page):
            out.append(t)
    return out


def _split(s: str, depth: int = 3) -> list[tuple[str, str | None]]:
    """``s`` as (sequence, letter) units; letter None for a character that belongs to no UTF-8 sequence. Undone up to ``depth`` times."""
    best: list[tuple[str, str | None]] = []
    best_n = -1
    for page, m in BYTES.items():
        out, i, n = [], 0, 0
        while i < len(s):
            b = m.get(s[i], 0)
            k = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 1
            letter = None
            if k > 1 and i + k <= len(s):
                try:
                    letter = bytes(m[c] for c in s[i : i + k]).decode("utf-8")
                    letter = letter if _likely(letter, page) else None
                except (KeyError, UnicodeDecodeError):
                    letter = None
            k = k if letter else 1
            out.append((s[i : i + k], letter))
            n += k if letter else 0
            i += k
        if n > best_n:
            best, best_n = out, n
    if best_n > 0 and depth > 1:
        # Once undone, letters and their neighbours may be such sequences again (also where a control character between was lost)
        merged: list[tuple[str, str | None]] = []
        at = 0
        for seq, letter in _split("".join(letter or seq for seq, letter in best), depth - 1):
            k = len(seq)
            part = best[at : at + k]
            at += k
            merged += [("".join(x for x, _ in part), letter)] if letter else part
        best = merged
    return best


@lru_cache(maxsize=200_000)
def symbols(run: str) -> tuple[str, ...]:
    """The cipher symbols of a run of non-ASCII characters."""
    if HAN.search(run):
        try:
            if not HAN.search(run.encode("gb18030").decode("utf-8")):
                return (run,)
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
        # two-byte readings cut in the middle of a letter: take each such character alone
        return tuple(run)
    return tuple(x[0] for x in _split(run))


@lru_cache(maxsize=50_000)
def candidates(sym: str) -> tuple[str, ...]:
    """What a symbol may stand for, itself first."""
    out = [sym]
    if HAN.search(sym):
        try:
            t = sym.encode("gb18030").decode("utf-8")
            return (sym, t) if not HAN.search(t) else (sym,)
        except (UnicodeEncodeError, UnicodeDecodeError):
            return (sym,)
    if len(sym) > 1:
        out += [x for _, x in _split(sym) if x] if len(_split(sym)) == 1 else []
        out += [x for x in _one(sym) if x not in out]
        return tuple(out)
    for m in BYTES.values():
        b = m.get(sym)
        if b is None:
            continue
        for table in CHARS.values():
            c = table[b]
            if c not in out and c != LOST and (c.isalpha() or c in "’‘“”„–—…€£§«»¿¡°"):
                out.append(c)
    return tuple(out)


def _ctx(c: str) -> str:
    return "0" if c.isdigit() and c.isascii() else " " if c.isspace() else c


@lru_cache(maxsize=400_000)
def _around(left: str, run: str, right: str) -> tuple[tuple[str, str, str], ...]:
    syms = (_ctx(left), *symbols(run), _ctx(right))
    return tuple(zip(syms, syms[1:], syms[2:]))


#: A run with the character before and after it.
RUN_AROUND = re.compile(r"([\x00-\x7f]?)([^\x00-\x7f]+)(?=([\x00-\x7f]?))")


def occurrences(text: str) -> Counter:
    """Counts of (left, symbol, right); neighbours are symbols or single ASCII characters."""
    out: Counter = Counter()
    for (left, run, right), n in Counter(RUN_AROUND.findall(text)).items():
        for o in _around(left or " ", run, right or " "):
            out[o] += n
    return out


class Bigrams:
    """P(b | a) of letters from counts of pairs, each discounted by one (a text's own single use is no evidence for it), never below FLOOR."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        total: Counter = Counter()
        for (a, _), n in counts.items():
            total[a] += n
        self.p = {(a, b): p for (a, b), n in counts.items() if (p := (n - 1) / total[a]) > FLOOR}
        self.letters = tuple(sorted({b for _, b in counts if not b.isascii() and b.isalpha()}))

    def __call__(self, a: str, b: str) -> float:
        return self.p.get((a[-1], b[0]), FLOOR)

    def candidates(self, sym: str) -> tuple[str, ...]:
        return (LOST, *self.letters) if sym == LOST else candidates(sym)

    def side(self, dist: dict[str, float], a: str, left: bool) -> float:
        """Probability of letter ``a`` beside a neighbour known as a distribution."""
        return sum(w * (self(b, a) if left else self(a, b)) for b, w in dist.items())


def maximize(occ: dict[tuple[str, str, str], int], theta: dict[str, dict[str, float]], big: Bigrams, rounds: int, weight: float = 1.0) -> dict[str, dict[str, float]]:
    """EM over counted occurrences: ``theta`` is the prior (and start) of each symbol's letters."""
    by: dict[str, list[tuple[str, str, int]]] = defaultdict(list)
    for (l, s, r), n in occ.items():
        by[s].append((l, r, n))
    now = {s: dict(theta[s]) for s in by}
    for _ in range(rounds):
        new = {}
        for s, ctx in by.items():
            cands = [a for a, w in now[s].items() if w > 1e-6]
            if len(cands) == 1:
                new[s] = {cands[0]: 1.0}
                continue
            sums = dict.fromkeys(cands, 0.0)
            seen: dict[tuple[str, bool], dict[str, float]] = {}
            for l, r, n in ctx:
                post = []
                dl, dr = now.get(l) or {l: 1.0}, now.get(r) or {r: 1.0}
                for a in cands:
                    kl, kr = seen.setdefault((l, True), {}), seen.setdefault((r, False), {})
                    pl = kl[a] if a in kl else kl.setdefault(a, big.side(dl, a, True))
                    pr = kr[a] if a in kr else kr.setdefault(a, big.side(dr, a, False))
                    post.append(now[s][a] * pl * pr)
                z = sum(post) or 1.0
                for a, p in zip(cands, post):
                    sums[a] += n * p / z
            total = sum(sums.values())
            prior = theta[s]
            new[s] = {a: (v + weight * prior[a]) / (total + weight) for a, v in sums.items()}
        now = new
    return now


def start(sym: str, big: Bigrams) -> dict[str, float]:
    c = big.candidates(sym)
    rest = (0.5 if len(sym) > 1 or sym == LOST else 0.09) / max(1, len(c) - 1)
    return {c[0]: 1.0 - rest * (len(c) - 1)} | {x: rest for x in c[1:]}


def hard(sym: str) -> bool:
    """Symbols that no writing system has: misread UTF-8 and two-byte letters, lost and control characters."""
    return len(sym) > 1 or sym == LOST or "\x80" <= sym < "\xa0" or (bool(HAN.match(sym)) and len(candidates(sym)) > 1)


def decode(text: str, table: dict[str, dict[str, float]], trust: dict[str, float], big: Bigrams) -> tuple[list[float], list[dict[str, str]]]:
    """Gains in nats and maps symbol -> letter of a document under its source's table: of hard, strange and proper symbols."""
    none = ([0.0] * 3, [{}, {}, {}])
    gains, maps = [0.0] * 3, [{}, {}, {}]
    occ = occurrences(text)
    odd, theta = set(), {}
    for l, s, r in occ:
        if s not in theta:
            theta[s] = table.get(s) or start(s, big)
            if hard(s) or trust.get(s, 1.0) < 0.5 or theta[s].get(s, 0.0) < 0.9:
                odd.add(s)
        if s not in odd and (min(pair := (big(l, s), big(s, r))) <= FLOOR or pair[0] * pair[1] < 1e-8):
            odd.add(s)  # a single improbable use is enough; threshold and word check decide
    odd = {s for s in odd if len(big.candidates(s)) > 1}
    if not odd:
        return none  # it reads well as it stands
    prior = {s: {a: max(w, SWAP_PRIOR / 10 if a != s else SWAP_PRIOR) for a, w in d.items()} if s in odd else {s: 1.0} for s, d in theta.items()}
    post = maximize(occ, prior, big, 3)
    near = lambda x: post.get(x) or {x: 1.0}
    ev = {s: dict.fromkeys(post[s], 0.0) for s in odd}
    own: Counter = Counter()
    for (l, s, r), n in occ.items():
        if s in odd:
            own[s] += n * (log(big(l, s) * big(s, r)) - (INSIDE if len(s) > 1 and not s[1:].isalnum() else 0.0))
            for a in ev[s]:
                ev[s][a] += n * log(max(big.side(near(l), a, True) * big.side(near(r), a, False), 1e-14))
    for s, d in ev.items():
        a = max(d, key=lambda x: d[x] + log(max(post[s][x], 1e-9)))
        if a != s:
            k = 0 if hard(s) else 1 if trust.get(s, 1.0) < 0.5 else 2
            gains[k] += d[a] - own[s] + log(SWAP_PRIOR) / 4
            maps[k][s] = a
    if all(s.lower() == a.lower() for m in maps for s, a in m.items()):
        return none  # a letter in the other case alone is no fault
    return gains, maps


def complete(text: str, used: dict[str, str], big: Bigrams) -> dict[str, str]:
    """``used`` with the other letters of the pair of pages behind most of it: a single character becomes what the pair makes of it unless that reads worse by more than PAIR nats."""
    occ = occurrences(text)
    n_of: Counter = Counter()
    for (_, s, _), n in occ.items():
        n_of[s] += n
    soft = {s: (a, float(n_of[s])) for s, a in used.items() if not hard(s) or len(s) == 1}
    if len(soft) < 2:
        return used
    pair, weight = page_pair(soft)
    if weight < 0.6 * sum(n for _, n in soft.values()):
        return used
    m = PAIRS[pair]
    change = {s: m[s] for s in n_of if s in m and m[s] != used.get(s, s)}
    side = lambda x: m.get(x, x) if x in change else used.get(x, x)
    diff = dict.fromkeys(change, PAIR)
    for (l, s, r), n in occ.items():
        if s in change:
            l, r = side(l), side(r)
            now = used.get(s, s)
            diff[s] += n * (log(big(l, change[s]) * big(change[s], r)) - log(big(l, now) * big(now, r)))
    return used | {s: a for s, a in change.items() if diff[s] > 0}


def apply(text: str, mapping: dict[str, str]) -> str:
    """The text with the mapped symbols replaced: ``translate()`` for single characters, whole sequences before."""
    if long := [s for s in mapping if len(s) > 1]:
        text = re.sub("|".join(map(re.escape, sorted(long, key=len, reverse=True))), lambda m: mapping[m.group()], text)
    return text.translate({ord(s): a for s, a in mapping.items() if len(s) == 1 and s != LOST})


@lru_cache(maxsize=200_000)
def _masked(run: str) -> str:
    return UNIT.sub("\x00", run)


def _bigrams_of(words: list[str], uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring characters of words (a << 21 | b) and their counts; Han and Hangul characters don't count."""
    t = " ".join(w if w.isascii() else RUN.sub(lambda m: _masked(m.group()), w) for w in words)
    c = np.frombuffer(f" {t} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    # a space belongs to the word before it, as the left one to the word after
    at = np.cumsum(c == 32)
    c = np.where(c == 160, 32, c)
    n = np.asarray(uses, np.int64)
    own = n[np.minimum(at[:-1] - 1, len(n) - 1)]
    alphabet, code = np.unique(c, return_inverse=True)
    m = len(alphabet)
    k, where = np.unique(code[:-1] * m + code[1:], return_inverse=True)
    sums = np.bincount(where, weights=own).astype(np.int64)
    left, right = alphabet[k // m], alphabet[k % m]
    han = lambda x: (x >= 0x3400) & (x <= 0xFAFF)
    ok = ~han(left) & ~han(right) & (left != 0xFFFD) & (right != 0xFFFD) & (left > 0) & (right > 0) & ~((left >= 0x80) & (left < 0xA0)) & ~((right >= 0x80) & (right < 0xA0))
    return (left << 21 | right)[ok], sums[ok]


def count_bigrams(vocab: DataFrame, tables: Broadcast | None = None) -> DataFrame:
    """``source, k, n``: each source's letter pairs, in words as they stand or read by the sources' tables. Sequences that look like misread UTF-8, lost and control characters don't count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for src, part in pdf.groupby("source", sort=False):
                words, swaps = part["word"].tolist(), tables.value.get(src) if tables else None
                k, n = _bigrams_of([w if w.isascii() else apply(w, swaps) for w in words] if swaps else words, part["n"].to_numpy())
                yield pd.DataFrame({"source": src, "k": k, "n": n})

    return vocab.mapInPandas(run, "source string, k bigint, n bigint").groupBy("source", "k").agg(F.sum("n").alias("n"))


def _pairs(rows: list) -> dict[tuple[str, str], int]:
    return {(chr(r.k >> 21), chr(r.k & 0x1FFFFF)): r.n for r in rows}


def vocabulary(texts: DataFrame) -> DataFrame:
    """``source, word, n``: what stands between white space in ``texts`` (``source, text``) with its uses, digits folded."""
    words = texts.select("source", F.explode(F.split(F.regexp_replace("text", "[0-9]+", "0"), r"[\x00-\x20]+")).alias("word"))
    return words.filter("word <> ''").groupBy("source", "word").agg(F.count(F.lit(1)).alias("n"))


Theta = dict[tuple[int, str, str], dict[str, float]]


def learn(occ: DataFrame, own: dict[str, dict], all_pairs: dict, sweeps: int = 3, rounds: int = 6) -> Theta:
    """(0 by all sources' bigrams or 1 by the other sources', source, symbol) -> letters with their probability.

    ``occ``: ``source, l, s, r, n``, counted occurrences. Each sweep is one task group per source and symbol, the neighbours' letters
    known from the sweep before; within it the symbol's own table goes through ``rounds`` of EM.
    """
    spark = occ.sparkSession
    pairs = spark.sparkContext.broadcast((uuid4().hex, all_pairs, own))  # rows of alphabets, at most about MAX_ROWS for own
    theta: Theta = {}
    for _ in range(sweeps):
        box = spark.sparkContext.broadcast(theta)

        def em(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            (src, s), out = key, []
            l, r, n = pdf["l"].tolist(), pdf["r"].tolist(), pdf["n"].to_numpy(float)  # noqa: B023
            for v in (0, 1):
                big = _bigrams_for(pairs, src if v else None)
                prior = start(s, big)
                cands = list(prior)
                if len(cands) == 1:
                    out.append((v, src, s, s, 1.0))
                    continue
                p = np.ones((len(l), len(cands)))
                for side, left in ((l, True), (r, False)):
                    vecs = {}
                    for x in set(side):
                        d = {x: 1.0} if x.isascii() else box.value.get((v, src, x)) or start(x, big)  # noqa: B023
                        vecs[x] = [big.side(d, a, left) for a in cands]
                    p *= np.array([vecs[x] for x in side])
                base = np.array(list(prior.values()))
                before = box.value.get((v, src, s))  # noqa: B023
                now = np.array([max(before.get(a, 0.0), 1e-6) for a in cands]) if before else base
                for _ in range(rounds):
                    post = now * p
                    sums = n @ (post / np.maximum(post.sum(1, keepdims=True), 1e-300))
                    now = (sums + base) / (sums.sum() + 1.0)
                out += [(v, src, s, a, float(w)) for a, w in zip(cands, now) if w > 1e-4]
            return pd.DataFrame(out, columns=["v", "source", "sym", "letter", "p"])

        rows = occ.groupBy("source", "s").applyInPandas(em, "v int, source string, sym string, letter string, p double").collect()  # sources times symbols
        theta = {}
        for x in rows:
            theta.setdefault((x.v, x.source, x.sym), {})[x.letter] = x.p
    return theta


_BIGRAMS: dict = {}


def _bigrams_for(pairs: Broadcast, without: str | None) -> Bigrams:
    """All sources' bigrams, or those without one source's, made once in a worker."""
    token, every, own = pairs.value
    at = (token, without)
    if at not in _BIGRAMS:
        if len(_BIGRAMS) > 8:
            _BIGRAMS.clear()
        mine = own.get(without, {}) if without is not None else {}
        _BIGRAMS[at] = Bigrams({k: m for k, n in every.items() if (m := n - mine.get(k, 0)) > 0} if mine else every)
    return _BIGRAMS[at]


def _best(d: dict[str, float]) -> str:
    return max(d, key=lambda x: (d[x], x))


def _scripts(word: str) -> int:
    """In how many scripts, Latin, Greek and Cyrillic, a word is written."""
    return len({"c" if "\u0400" <= c < "\u0530" else "g" if "\u0370" <= c < "\u0400" else "l" for c in word if c.isalpha()})


def oddness(word: str) -> int:
    """Signs and capital letters inside a word."""
    return sum(1 for i, c in enumerate(word) if not c.isascii() and (((not c.isalpha() or c in "ˆˇªº") and c not in "’‘·ʼ\xad") or (i and c.isupper() and word[i - 1].islower())))


def verify(odd: DataFrame, theta: Theta) -> dict[tuple[int, str, str], tuple[float, float, int]]:
    """(votes, votes by uses, words) of each soft swap (version, source, symbol) of ``theta``: by how many more of the words it restores are better known than those that
    stand there. Better known is what more sources prefer, or, if as many do, what has fewer signs and capitals within words. ``odd``: the vocabulary's words with other than ASCII letters."""
    spark = odd.sparkSession
    swaps: dict[tuple[int, str], dict[str, str]] = defaultdict(dict)
    for (v, src, s), d in theta.items():
        if (a := _best(d)) != s:
            swaps[v, src][s] = a
    box, versions = spark.sparkContext.broadcast(dict(swaps)), sorted({v for v, _ in swaps})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for src, w, n in zip(pdf["source"], pdf["word"], pdf["n"].tolist()):
                for v in versions:
                    if (m := box.value.get((v, src))) and (soft := [s for s in {o[1] for o in occurrences(w)} if s in m and not hard(s)]):
                        u = apply(w, m)
                        if u.lower() != w.lower():  # a word in other letter cases tells nothing
                            out += [(v, src, s, w, u, float(np.sign(oddness(w) - oddness(u))), n) for s in soft]
            yield pd.DataFrame(out, columns=["v", "source", "sym", "w", "u", "odd", "uses"])

    asked = cut(odd.mapInPandas(run, "v int, source string, sym string, w string, u string, odd double, uses bigint"))
    # each source speaks once, for the spelling that it uses more
    both = asked.select("w", "u").distinct().select("w", "u", F.explode(F.array(F.struct(F.col("w").alias("word"), F.lit(-1).alias("side")), F.struct(F.col("u").alias("word"), F.lit(1).alias("side")))).alias("x")).select("w", "u", "x.*")
    per = both.join(odd.select(F.col("source").alias("by"), "word", "n"), "word").groupBy("w", "u", "by").agg(F.sum(F.col("side") * F.col("n")).alias("d"))
    vote = per.groupBy("w", "u").agg(F.sum(F.signum("d")).alias("sources"))
    asked = asked.join(vote, ["w", "u"]).withColumn("vote", F.when(F.col("sources") != 0, F.signum("sources")).otherwise(F.col("odd")))
    rows = asked.groupBy("v", "source", "sym").agg(F.sum("vote").alias("x"), F.sum(F.col("vote") * F.col("uses")).alias("y"), F.count(F.lit(1)).alias("n")).collect()  # sources times symbols
    return {(r.v, r.source, r.sym): (r.x, r.y, r.n) for r in rows}


#: What each character means if one page was written and another one read.
PAIRS = {(r, w): {c: CHARS[w][b] for c, b in BYTES[r].items() if CHARS[w][b] != LOST} for r in READ_AS for w in WRITTEN_IN if r != w}


def page_pair(swaps: dict[str, tuple[str, float]]) -> tuple[tuple[str, str], float]:
    """The (read, written) pair of pages that explains most of ``swaps`` (symbol -> letter, weight), with the weight it explains."""
    score = {p: sum(n for s, (a, n) in swaps.items() if m.get(s) == a) for p, m in PAIRS.items()}
    best = max(score, key=lambda p: score[p])  # the first of equal ones
    return best, score[best]


def _by_pair(theta: Theta, votes: dict[tuple[int, str, str], tuple[float, float, int]]) -> tuple[set[tuple[int, str, str]], Theta]:
    """(swaps that words confirm, each by itself or together those of one pair of pages; what that pair makes of the source's other characters)."""
    ok: set[tuple[int, str, str]] = {k for k, (x, y, _) in votes.items() if x > 0 and y > 0}
    swaps: dict[tuple[int, str], dict[str, tuple[str, float]]] = defaultdict(dict)
    for (v, src, s), (*_, n) in votes.items():
        swaps[v, src][s] = (_best(theta[v, src, s]), n)
    pairs: dict[str, set[tuple[str, str]]] = defaultdict(set)
    for (v, src), m in swaps.items():
        pair, _ = page_pair(m)
        same = [(v, src, s) for s, (a, _) in m.items() if PAIRS[pair].get(s) == a]
        if all(sum(votes[k][i] for k in same) > 0 for i in (0, 1)):
            ok.update(k for k in same if votes[k][1] >= 0)  # not one that mostly stands for itself
            pairs[src].add(pair)
    more: Theta = {}
    for v, src, s in theta:
        for i, pair in enumerate(sorted(pairs.get(src, ()))):
            if v == 0 and not hard(s) and (a := PAIRS[pair].get(s, s)) != s:
                more[2 + i, src, s] = {a: 0.98, s: 0.02}
    return ok, more


def tables_of(odd: DataFrame, theta: Theta) -> tuple[dict[str, dict[str, dict[str, float]]], dict[str, dict[str, str]]]:
    """(each source's symbol-to-letter table, its swaps that words confirm)."""
    ok, more = _by_pair(theta, verify(odd, theta))
    if more:
        ok |= {k for k, (x, y, _) in verify(odd, more).items() if x > 0 and y > 0}
    theta = theta | more
    tables: dict[str, dict[str, dict[str, float]]] = defaultdict(dict)
    sure: dict[str, dict[str, str]] = defaultdict(dict)
    for v, src, s in theta:
        if v == 0:
            known = [x for x in (2, 3, 1, 0) if (x, src, s) in ok]
            d = theta[known[0] if known else 0, src, s]
            if known:
                sure[src][s] = _best(d)
            tables[src][s] = d
    return tables, sure


#: Splits a text into words of letters, digits and non-ASCII characters.
WORDS = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def restore(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, gain, restored`` of each garbled document of ``docs`` (``doc_id, source, text``; other columns are ignored).

    A document counts as garbled if reading its hard symbols as letters gains more than ``threshold`` nats, or if reading other characters as
    other letters does and the corpus, this document and its copies aside, knows more of the words so restored than of the words as they stand; where it knows
    neither, if the swap is one that words confirm for the source, or gains more than ALONE. A null, empty or ASCII text is none; a null source is a source of its own; repeated ids give repeated rows.
    Characters lost for good (U+FFFD) mark a document as garbled and stay in ``restored``; everything else that the table maps is replaced in
    the whole text. A source that is garbled throughout is found if other sources hold texts of its languages.
    """
    spark = docs.sparkSession
    docs = docs.filter("text IS NOT NULL").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    texts = docs.filter(r"text RLIKE '[^\\x00-\\x7F]'")
    vocab = cut(vocabulary(docs))
    whole = vocab.filter(r"word RLIKE '[^\\x00-\\x7F]'")
    odd = whole.select("source", F.explode(F.split("word", WORDS)).alias("word"), "n").filter(r"word RLIKE '[^\\x00-\\x7F]'").groupBy("source", "word").agg(F.sum("n").alias("n"))
    odd = cut(odd)

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            per: Counter = Counter()
            for src, w, n in zip(pdf["source"], pdf["word"], pdf["n"].tolist()):
                for o, k in occurrences(w).items():
                    per[(src, *o)] += n * k
            yield pd.DataFrame([(*k, n) for k, n in per.items()], columns=["source", "l", "s", "r", "n"])

    occ = cut(whole.mapInPandas(around, "source string, l string, s string, r string, n bigint").groupBy("source", "l", "s", "r").agg(F.sum("n").alias("n")))
    grams = cut(count_bigrams(vocab))
    all_pairs = _pairs(grams.groupBy("k").agg(F.sum("n").alias("n")).collect())  # pairs of letters below U+3400
    turns = max(1, -(-(grams.count() + occ.select("source", "s").distinct().count()) // MAX_ROWS))
    turn = lambda d, i: d.filter(F.pmod(F.xxhash64("source"), F.lit(turns)) == i) if turns > 1 else d
    tables, sure = {}, {}
    for i in range(turns):
        own: dict[str, list] = defaultdict(list)
        for r in turn(grams, i).collect():
            own[r.source].append(r)
        theta = learn(turn(occ, i), {s: _pairs(rows) for s, rows in own.items()}, all_pairs)
        tables[i], sure[i] = tables_of(odd, theta)
    swaps = [spark.sparkContext.broadcast(dict(sure[i])) for i in range(turns)]
    clean = [count_bigrams(turn(vocab, i), swaps[i]) for i in range(turns)]
    clean_pairs = reduce(DataFrame.unionByName, clean).groupBy("k").agg(F.sum("n").alias("n")).collect()
    big = Bigrams(_pairs(clean_pairs))
    uses: Counter = Counter()
    swapped: Counter = Counter()
    for r in occ.groupBy("source", "s").agg(F.sum("n").alias("n")).toLocalIterator():
        uses[r.s] += r.n
        i = next(i for i in range(turns) if r.source in tables[i]) if any(r.source in tables[i] for i in range(turns)) else 0
        swapped[r.s] += r.n * (1.0 - tables[i].get(r.source, {}).get(r.s, {r.s: 1.0}).get(r.s, 0.0))
    trust = {s: 1.0 - swapped[s] / n for s, n in uses.items()}
    hits = [_decode_all(turn(texts, i), spark.sparkContext.broadcast((big, {k: dict(v) for k, v in tables[i].items()}, dict(sure[i]), trust)), threshold, docs) for i in range(turns)]
    hits = cut(reduce(DataFrame.unionByName, hits))
    return _settle(hits, odd, [(turn(odd, i), swaps[i]) for i in range(turns)])


def _decode_all(texts: DataFrame, box: Broadcast, threshold: float, docs: DataFrame) -> DataFrame:
    """``doc_id, gain, restored, h, words, sure`` of the documents that read better otherwise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        big, tables, known, trust = box.value
        full = {src: {s: {c: 1e-5 for c in big.candidates(s)} | {s: 1e-4} | d for s, d in t.items()} for src, t in tables.items()}
        for pdf in batches:
            out = []
            for i, src, t in zip(pdf["doc_id"], pdf["source"], pdf["text"]):
                (g0, g1, g2), maps = decode(t, full.get(src, {}), trust, big)
                sure = g0 > threshold
                if sure or g1 + g2 > threshold:
                    used = maps[0] | (maps[1] if not sure or g1 > threshold else {}) | (maps[2] if not sure or g2 > 5 * threshold else {})
                    used = complete(t, used, big)
                    words = [] if sure else Counter(w for w in re.split(WORDS, re.sub("[0-9]+", "0", t)) if not w.isascii())
                    pairs = [{"w": w, "v": v, "n": n} for w, n in sorted(words.items()) if (v := apply(w, used)) != w] if words else []
                    mine = known.get(src, {})
                    pure = all(_scripts(x["v"]) <= max(1, _scripts(x["w"])) and oddness(x["v"]) <= oddness(x["w"]) for x in pairs)
                    agreed = bool(used) and all(mine.get(s) == a for s, a in used.items() if not hard(s))
                    out.append((i, src, g0 + g1 + g2, apply(t, used), [x for x in pairs if x["w"].lower() != x["v"].lower()], sure, agreed, pure))
            yield pd.DataFrame(out, columns=["doc_id", "source", "gain", "restored", "words", "sure", "agreed", "pure"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInPandas(run, f"doc_id {kind}, source string, gain double, restored string, words array<struct<w: string, v: string, n: bigint>>, sure boolean, agreed boolean, pure boolean")


def _settle(hits: DataFrame, odd: DataFrame, parts: list[tuple[DataFrame, Broadcast]]) -> DataFrame:
    """The hits that are sure, and those whose words the corpus knows better as restored than as they stand."""
    asked = hits.filter("NOT sure").select("source", F.xxhash64("restored", "source").alias("h"), F.explode("words").alias("x")).select("source", "h", "x.*")
    asked = cut(asked.groupBy("source", "h", "w", "v").agg(F.sum("n").alias("n")))  # copies count together
    need = asked.select(F.explode(F.array("w", "v")).alias("word")).distinct()

    def reader(swaps: Broadcast):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf["read"] = [apply(w, m) if (m := swaps.value.get(s)) else w for s, w in zip(pdf["source"], pdf["word"])]
                yield pdf[["source", "word", "read", "n"]]

        return run

    read = reduce(DataFrame.unionByName, [p.mapInPandas(reader(b), "source string, word string, read string, n bigint") for p, b in parts])
    read = cut(read)
    uses = cut(read.groupBy(F.col("read").alias("word")).agg(F.sum("n").alias("n")).join(need, "word", "left_semi"))
    mine = read.filter("word <> read").select("source", F.col("word").alias("w"), F.col("read").alias("mine")).join(asked.select("source", "w").distinct(), ["source", "w"], "left_semi")
    votes = asked.join(mine, ["source", "w"], "left").withColumn("mine", F.coalesce("mine", "w"))
    for c in ("w", "v"):
        votes = votes.join(uses.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}")), c, "left")
        votes = votes.withColumn(f"n_{c}", F.coalesce(f"n_{c}", F.lit(0)) - F.when(F.col("mine") == F.col(c), F.col("n")).otherwise(0))
    votes = votes.groupBy("source", "h").agg(F.sum(F.signum(F.col("n_v") - F.col("n_w"))).alias("vote"), F.max(((F.col("n_v") > 0) | (F.col("n_w") > 0)).cast("int")).alias("known"))
    rest = hits.filter("NOT sure").withColumn("h", F.xxhash64("restored", "source")).join(votes, ["source", "h"])
    ok = (F.col("vote") > 0) | ((F.col("known") == 0) & F.col("pure") & (F.col("agreed") | (F.col("gain") > ALONE)))
    return hits.filter("sure").select("doc_id", "gain", "restored").unionByName(rest.filter(ok).select("doc_id", "gain", "restored"))
