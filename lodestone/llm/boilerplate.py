"""Main body of web pages: a recurrent block labeller over the lines of a page.

A numpy bidirectional LSTM reads, for each line of a page in order, a path vector (its shape, its place, the lines round it, whether it names the
speaker or the site) and the mean of its hashed words' vectors, and labels every line with the whole page in view. It is trained where it is
used, on a bounded sample of pages whose lines are labelled by how the same line stands on all pages: with or beside sentences about
the speaker, opening a body, or only round it and interrupting it. What that leaves open is labelled by the words and
surroundings learned. A few general phrases per language help; none is needed for a language to be learned.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .page_lines import Page, fold, frames

#: Pages the labeller is trained on at most, the longest of them in characters and lines, and its sizes.
SAMPLE_PAGES, SAMPLE_CHARS, SAMPLE_LINES = 2400, 20_000, 160
HASHES, WORD_DIM, HIDDEN, EPOCHS, BATCH = 2048, 24, 32, 7, 48
#: Padded lines and hashed words labelled at once; a page beyond that is labelled by itself.
CELLS, CELL_WORDS = 16_384, 500_000

#: General headings of a biography, in five languages (folded). They are main body.
MAIN_SEEDS = re.compile(r"^(?:education|career|biography|publications|ausbildung|leben|formacion|vida|obras|formation|biographie|utbildning|skrifter)$")
#: General phrases of page furniture, in five languages (folded).
FURNITURE_SEEDS = re.compile(r"cookie|kakor\b|©|all rights reserved|privacy|datenschutz|newsletter|^(?:advertisement|anzeige|annons|publicidad|publicite)$|^(?:share|teilen|dela|compartir|partager)\b")
#: A list entry that begins with a year.
_YEAR = re.compile(r"^\d{4}(?:\s?[–-]\s?\d{2,4})?\s?:?\s+[^\W\d_]")
#: Uses from which a frame's places tell something, and from which they tell an insertion from a heading.
USES, MANY = 5, 12
#: Share of a sample's lines whose words are hidden in an epoch, so that their surroundings are learned too.
HIDDEN_LINES = 0.1
_SEPARATED = re.compile(r"\s[·|]\s|\s{2,}")
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[^\W_]+")
SHAPE = 30


#: Places of a frame: uses; with a sentence about the speaker; before and after all of these; right before one; right after the title.
PLACES = ("n", "told", "before", "after", "opens", "titled")


def marks(page: Page, text: str) -> list[tuple[int, str, str, int, bool, bool]]:
    """(number, line, folded and masked, words, title, sentence about the speaker) of the lines that aren't blank."""
    out = []
    for no, line in enumerate(text.split("\n"), 1):
        if not line.strip():
            continue
        f0 = fold(line)
        f = _DIGITS.sub("0", page.mask(f0))
        toks = _WORD.findall(f)
        names = "\x02" in f
        title = names and page.is_title(line, f0)
        out.append((no, line, f, len(toks) + names, title, names and not title and len(toks) >= 5 and f[-1:] in ".!?"))
    return out


def places(lines: list[tuple]) -> Iterator[tuple[str, tuple[int, ...]]]:
    """Each frame of a page's lines with its PLACES."""
    told = [k for k, x in enumerate(lines) if x[5]] or [k for k, x in enumerate(lines) if x[4]]
    if not told:
        return
    first, last = told[0], told[-1]
    for k, (_, line, _, _, _, sentence) in enumerate(lines):
        titled = k > 0 and lines[k - 1][4]
        at = (1, sentence, k < first, k > last and not titled, k + 1 < len(lines) and lines[k + 1][5], titled)
        for f in set(frames(line)):
            yield f, at


def seed_label(line: str, folded: str, words: int, title: bool, sentence: bool, known: dict[str, tuple[int, ...]]) -> int:
    """1 furniture, 0 main body, -1 left open. ``known``: the PLACES of frames over all pages."""
    if title or sentence or MAIN_SEEDS.match(folded):
        return 0
    if FURNITURE_SEEDS.search(folded) and words <= 30:
        return 1
    if _YEAR.match(line.strip()):
        return 0
    own = frames(line)
    seen = [v for f in own if (v := known.get(f)) and v[0] >= USES]
    if any(told >= 0.5 * n or titled >= 0.5 * n for n, told, _, _, _, titled in seen):
        return 0
    if seen and all(told < 0.05 * n for n, told, *_ in seen):
        if all(before + after >= 0.7 * n and opens < 0.4 * n for n, _, before, after, opens, _ in seen):
            return 1
        if len(seen) == len(own) == 1 and seen[0][0] >= MANY:
            n, _, before, after, opens, _ = seen[0]
            if opens >= 0.7 * n and before >= 0.18 * n:
                return 0  # a heading or entry: it opens bodies too
            if before <= 0.1 * n and after <= 0.1 * n:
                return 1  # it only interrupts them
    return -1


@lru_cache(maxsize=200_000)
def _hash(word: str) -> int:
    return zlib.crc32(word.encode()) % HASHES


def read_page(text: str, url: str | None, name: str | None = None, known: dict[str, tuple[int, ...]] | None = None) -> tuple[list[int], np.ndarray, list[list[int]], list[int]]:
    """(numbers of the lines that aren't blank, their shapes, their hashed words, their seed labels if the frames' places are given)."""
    page = Page(url, name)
    raw = text.split("\n")
    keep = [i for i, line in enumerate(raw) if line.strip()]
    n = len(keep)
    shape, words = np.zeros((n, SHAPE), np.float32), []
    labels = [seed_label(*x[1:], known) for x in marks(page, text)] if known is not None else []
    for k, i in enumerate(keep):
        line = raw[i].rstrip("\r")
        f0 = fold(line)
        f = _DIGITS.sub("0", page.mask(f0))
        toks = _WORD.findall(f)
        names = "\x02" in f
        title = names and page.is_title(line, f0)
        ln = len(line)
        v = shape[k]
        v[0], v[1] = k / max(1, n - 1), min(k, 20) / 20
        v[2] = min(n - 1 - k, 20) / 20
        v[3], v[4] = min(ln, 400) / 400, min(len(toks), 40) / 40
        v[5:10] = (ln < 12, ln < 25, ln < 60, ln < 140, ln >= 140)
        v[10] = i > 0 and not raw[i - 1].strip()
        v[11] = i + 1 < len(raw) and not raw[i + 1].strip()
        v[12], v[13] = names, "\x01" in f
        v[14] = line[:1] in " \t"
        v[15] = f[-1:] in ".!?"
        v[16] = " · " in line
        v[17] = " | " in line
        v[18] = "  " in line.strip()
        v[19] = "©" in line
        v[20] = any(c in line for c in "»›>")
        v[21] = "0" in f
        v[22] = f.startswith("0")
        v[23] = ":" in line
        v[24] = title
        v[25] = sum(t[:1].isupper() for t in line.split()) / max(1, len(toks))
        v[26] = line.isupper()
        v[27] = len(_SEPARATED.findall(line)) / max(1, len(toks))
        v[28], v[29] = n < 6, min(n, 60) / 60
        hashed = [_hash(t) for t in toks]
        hashed += [zlib.crc32(f"{a} {b}".encode()) % HASHES for a, b in zip(toks, toks[1:])]
        hashed += [_hash("^" + toks[0]), _hash("$" + toks[-1]), _hash("=" + " ".join(toks[:8]))] if toks else [0]
        words.append(hashed)
    return [i + 1 for i in keep], shape, words, labels


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLSTM:
    """Bidirectional LSTM over line vectors with a logistic output per line; forward, backward and Adam in numpy."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        d, h = SHAPE + WORD_DIM, HIDDEN
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": g(HASHES, WORD_DIM) * 2, "out": g(2 * h + d, 1), "b": np.zeros(1, np.float32)}
        for side in "fb":
            self.p["W" + side] = g(d + h, 4 * h)
            self.p["c" + side] = np.zeros(4 * h, np.float32)
            self.p["c" + side][h : 2 * h] = 1.0
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    @staticmethod
    def pad(pages: list[tuple[np.ndarray, list[list[int]]]]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Shapes (T, B, SHAPE), mask (T, B) and the hashed words as (flat line, hash, weight)."""
        t = max(len(s) for s, _ in pages)
        x, mask = np.zeros((t, len(pages), SHAPE), np.float32), np.zeros((t, len(pages)), np.float32)
        line, hashes, weight = [], [], []
        for b, (s, ws) in enumerate(pages):
            x[: len(s), b], mask[: len(s), b] = s, 1
            for k, w in enumerate(ws):
                each = 1 / np.sqrt(len(w))
                if len(w) > HASHES:  # a line of any length has so many different ones at most
                    u, n = np.unique(w, return_counts=True)
                    w, own = u.tolist(), (n * each).tolist()
                else:
                    own = [each] * len(w)
                line += [k * len(pages) + b] * len(w)
                hashes += w
                weight += own
        return x, mask, (np.array(line), np.array(hashes), np.array(weight, np.float32))

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, tape: list | None) -> np.ndarray:
        t, b, _ = x.shape
        h = c = np.zeros((b, HIDDEN), np.float32)
        out = np.zeros((t, b, HIDDEN), np.float32)
        w, bias, n = self.p["W" + side], self.p["c" + side], HIDDEN
        xin = x @ w[: x.shape[2]] + bias
        rec = w[x.shape[2] :]
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            z = xin[k] + h @ rec
            i, f, o, g = _sigmoid(z[:, :n]), _sigmoid(z[:, n : 2 * n]), _sigmoid(z[:, 2 * n : 3 * n]), np.tanh(z[:, 3 * n :])
            c2 = f * c + i * g
            th = np.tanh(c2)
            mk = mask[k][:, None]
            if tape is not None:
                tape.append((k, h, c, i, f, o, g, th, mk))
            h, c = np.where(mk > 0, o * th, h), np.where(mk > 0, c2, c)
            out[k] = h
        return out

    def forward(self, pages: list, tapes: dict | None = None) -> tuple:
        x, mask, (line, hashes, weight) = self.pad(pages)
        t, b, _ = x.shape
        e = np.zeros((t * b, WORD_DIM), np.float32)
        order = np.argsort(line, kind="stable")
        line, hashes, weight = line[order], hashes[order], weight[order]
        vec = self.p["E"][hashes] * weight[:, None]
        starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        e[line[starts]] = np.add.reduceat(vec, starts, axis=0)
        x = np.concatenate([x, e.reshape(t, b, WORD_DIM)], axis=2)
        hf = self._run(x, mask, "f", tapes["f"] if tapes is not None else None)
        hb = self._run(x, mask, "b", tapes["b"] if tapes is not None else None)
        top = np.concatenate([hf, hb, x], axis=2)
        y = _sigmoid(top @ self.p["out"] + self.p["b"])[..., 0]
        return y, mask, x, top, (line, hashes, weight)

    def step(self, pages: list, targets: np.ndarray, known: np.ndarray, rate: float) -> float:
        """One Adam step; ``known`` (T, B) marks the labelled lines."""
        tapes: dict = {"f": [], "b": []}
        y, mask, x, top, (line, hashes, weight) = self.forward(pages, tapes)
        n, d = HIDDEN, x.shape[2]
        dy = (y - targets) * known / max(1.0, known.sum())
        g = {"out": np.einsum("tbi,tb->i", top, dy)[:, None], "b": np.array([dy.sum()], np.float32)}
        dtop = dy[..., None] * self.p["out"][:, 0]
        dx = dtop[..., 2 * n :].copy()
        for side, at in (("f", 0), ("b", n)):
            w = self.p["W" + side]
            dz_all = np.zeros((*mask.shape, 4 * n), np.float32)
            gr = np.zeros((n, 4 * n), np.float32)
            dh = dc = np.zeros((mask.shape[1], n), np.float32)
            for k, h0, c0, i, f, o, gg, th, mk in reversed(tapes[side]):
                dh = dh + dtop[k][:, at : at + n]
                a, ca = dh * mk, dc * mk
                ca = ca + a * o * (1 - th * th)
                dz = np.concatenate([ca * gg * i * (1 - i), ca * c0 * f * (1 - f), a * th * o * (1 - o), ca * i * (1 - gg * gg)], axis=1)
                dz_all[k] = dz
                gr += h0.T @ dz
                dh = dz @ w[d:].T + dh * (1 - mk)
                dc = ca * f + dc * (1 - mk)
            flat = dz_all.reshape(-1, 4 * n)
            g["W" + side] = np.concatenate([x.reshape(-1, d).T @ flat, gr])
            g["c" + side] = flat.sum(0)
            dx += dz_all @ w[:d].T
        de = dx[..., SHAPE:].reshape(-1, WORD_DIM)[line] * weight[:, None]
        ge = np.zeros_like(self.p["E"])
        order = np.argsort(hashes, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(hashes[order]) != 0])
        ge[hashes[order][starts]] = np.add.reduceat(de[order], starts, axis=0)
        g["E"] = ge
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        self.t += 1
        for k, v in g.items():
            v = v * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * v
            self.v[k] = 0.995 * self.v[k] + 0.005 * v * v
            self.p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.995**self.t)) + 1e-8)
        eps = 1e-7
        return float(-((targets * np.log(y + eps) + (1 - targets) * np.log(1 - y + eps)) * known).sum() / max(1.0, known.sum()))


def fit(pages: list[tuple[np.ndarray, list[list[int]], list[int]]], epochs: int = EPOCHS, seed: int = 5) -> BiLSTM:
    """The labeller trained on read pages (shapes, hashed words, seed labels)."""
    net, r = BiLSTM(seed), np.random.default_rng(seed)
    pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
    batches = [pages[i : i + BATCH] for i in range(0, len(pages), BATCH)]
    for e in range(epochs):
        for i in r.permutation(len(batches)):
            own = batches[i]
            t = max(len(p[0]) for p in own)
            y, k = np.zeros((t, len(own)), np.float32), np.zeros((t, len(own)), np.float32)
            for b, (_, _, lab) in enumerate(own):
                lab = np.array(lab)
                y[: len(lab), b], k[: len(lab), b] = lab == 1, lab >= 0
            # The words of some lines are hidden: what these are must follow from their shape and surroundings
            net.step([(s, [[0] if r.random() < HIDDEN_LINES else w for w in ws]) for s, ws, _ in own], y, k, 0.01 * (0.5 ** (e / 2.5)))
    return net


def label(net: BiLSTM, pages: list[tuple[np.ndarray, list[list[int]]]]) -> list[np.ndarray]:
    """Probability of furniture of each line of each page, in batches of bounded size."""
    out: list = [np.zeros(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i][0])), key=lambda i: len(pages[i][0]))
    at = 0
    while at < len(order):
        end, words = at + 1, sum(map(len, pages[order[at]][1]))
        while end < len(order) and len(pages[order[end]][0]) * (end + 1 - at) <= CELLS and (words := words + sum(map(len, pages[order[end]][1]))) <= CELL_WORDS:
            end += 1
        y, *_ = net.forward([pages[i] for i in order[at:end]])
        for b, i in enumerate(order[at:end]):
            out[i] = y[: len(pages[i][0]), b]
        at = end
    return out


def _named(pages: DataFrame) -> DataFrame:
    """``id, url, name, cleaned_text``; a missing name is null."""
    return pages.select("id", "url", F.col("name") if "name" in pages.columns else F.lit(None).cast("string").alias("name"), "cleaned_text")


def frame_places(pages: DataFrame) -> DataFrame:
    """``frame`` and its PLACES, summed over all pages; sums of a batch are made before they are shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums: dict[str, np.ndarray] = {}
            for url, name, text in zip(pdf["url"], pdf["name"], pdf["cleaned_text"]):
                for f, at in places(marks(Page(url, name), text)):
                    sums[f] = sums[f] + at if f in sums else np.array(at, np.int64)
            yield pd.DataFrame([(f, *v.tolist()) for f, v in sums.items()], columns=["frame", *PLACES])

    lines = _named(pages).filter("cleaned_text IS NOT NULL").mapInPandas(count, "frame string, " + ", ".join(f"{c} bigint" for c in PLACES))
    return lines.groupBy("frame").agg(*[F.sum(c).alias(c) for c in PLACES])


def train(pages: DataFrame, sample: int = SAMPLE_PAGES) -> BiLSTM:
    """Fits the labeller on at most ``sample`` pages drawn by a hash of their id, none longer than SAMPLE_CHARS characters; what labels their lines is counted over all pages."""
    rows = _named(pages).filter(F.length(F.trim("cleaned_text")) > 0).filter(F.length("cleaned_text") <= SAMPLE_CHARS).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample).collect()
    own = {f for r in rows for line in r.cleaned_text.split("\n") if line.strip() for f in frames(line)}
    wanted = F.broadcast(pages.sparkSession.createDataFrame([(f,) for f in sorted(own)], "frame string"))  # frames of the sample: at most sample * SAMPLE_CHARS characters
    known = {r.frame: tuple(r)[1:] for r in frame_places(pages).filter(f"n >= {USES}").join(wanted, "frame", "left_semi").collect()}
    read = [read_page(r.cleaned_text, r.url, r.name, known) for r in rows]
    return fit([(s, w, lab) for _, s, w, lab in read if 0 < len(s) <= SAMPLE_LINES])


def furniture_lines(pages: DataFrame, net: BiLSTM | None = None, threshold: float = 0.5) -> DataFrame:
    """``id, line_no, line, furniture`` of every line that isn't blank (``id, url, cleaned_text`` and, if known, the speaker's ``name``; other columns are ignored).

    Lines are numbered from 1 as split at line feeds. Null and blank texts have no lines; a page of any length is read as a whole; a null url
    tells no site, and the name only if ``name`` does. Repeated ids give repeated rows.
    """
    net = net or train(pages)
    box = pages.sparkSession.sparkContext.broadcast(net.p)  # fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = BiLSTM()
        net.p = box.value
        for pdf in batches:
            read = [read_page(t, u, n) for t, u, n in zip(pdf["cleaned_text"], pdf["url"], pdf["name"])]
            probs = label(net, [r[1:3] for r in read])
            rows = []
            for i, t, (nos, *_), p in zip(pdf["id"], pdf["cleaned_text"], read, probs):
                lines = t.split("\n")
                rows += [(i, no, lines[no - 1], bool(q >= threshold)) for no, q in zip(nos, p)]
            yield pd.DataFrame(rows, columns=["id", "line_no", "line", "furniture"])

    kind = pages.schema["id"].dataType.simpleString()
    texts = _named(pages).filter("cleaned_text IS NOT NULL")
    return texts.mapInPandas(run, f"id {kind}, line_no int, line string, furniture boolean")


def main_bodies(pages: DataFrame, net: BiLSTM | None = None) -> DataFrame:
    """``id, main_text``: each page reduced to the lines of its main body, in order; one row per id and text with any such line."""
    kept = furniture_lines(pages, net).filter("NOT furniture")
    rows = kept.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("line_no", "line"))).alias("x"))
    return rows.select("id", F.array_join(F.transform("x", lambda s: F.regexp_replace(s["line"], r"\r$", "")), "\n").alias("main_text"))
