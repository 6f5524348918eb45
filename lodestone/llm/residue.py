"""Template residue and error pages, found by aligning the records made from the same templates.

Every line is reduced to a skeleton (numbers, the site's and the speaker's name and the syntax of variables masked) and to a template: its fixed words in
order, with a slot wherever a name, a number, a variable or nothing stands between them. Lines of one template align; a column that
holds several values over the records is an induced slot. Pages are split into those that say anything of their speaker and those that
don't: a sentence with the name says something unless it is itself a template's, one that stands alone on its pages. What stands on the
latter pages out of all proportion is residue: a skeleton that is frequent (filler, an error page's text), or of a rare one its slots' values
(retained variable names, defaults, blanks, in the column or in any column) or its most telling words. Furniture stands on both kinds of pages alike and doesn't
count, nor does a bare title. Of a page that says nothing, every line that is neither residue nor furniture by the block labeller speaks against it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import boilerplate
from .page_lines import Page, fold, frames

#: Spellings of an unfilled slot: brackets and marks of template languages round a variable's name, and what empty values print as.
SLOT = re.compile(
    r"\{\{.*?\}\}|\$\{.*?\}|#\{.*?\}|\{%.*?%\}|<%.*?%>|\[\[.*?\]\]|«[\w .]{1,40}»|@@.{1,40}?@@|__\w{1,40}?__|%[a-z][a-z_]{1,40}%|\{\w{0,40}\}|<insert [^<>]{1,40}>|<[a-z_ ]{1,40}>|\[object object\]"
    r"|\[[a-z_ ]{2,40}\]|\bundefined\b|\bnull\b|\bnan\b|\bn/a\b"
)
#: What a line must hold for SLOT to match at all.
_MAY = re.compile(r"[{}$#%<\[«@_]|undefined|null|nan|n/a")
_HEX = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b")
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[^\W\d_]+")
#: Log ratio from which a skeleton is residue, and below which it is content; uses from which it is judged by itself.
RESIDUE, CONTENT, ENOUGH = 2.0, 1.0, 4
WORD_USES = 3
#: A sentence: so many words at least.
SENTENCE_WORDS = 4
#: A sentence with the name is a template's if it is its pages' only one in this share of its uses, and it has ENOUGH.
ALONE = 0.9
_SENTENCES = re.compile(r"(?<=[.!?])\s+(?=\S)")
_ONLY_MARKS = re.compile(r"^[^\w\x02\x03]+$")


def template(line: str, page: Page) -> tuple[str, list[str]]:
    """The fixed words of a line with ``^`` for each slot, and the slots' values; a mark that stands alone leaves a blank before it."""
    fixed: list[str] = []
    slots: list[str] = []
    may = _MAY.search(line.lower())
    masked = page.mask(SLOT.sub("\x03", fold(line)) if may else fold(line)).split()
    raw = (SLOT.sub("\x03", line) if may else line).split()
    raw = raw if len(raw) == len(masked) else masked
    for k, (w, m) in enumerate(zip(raw, masked)):
        m = m.strip(".,:;!?()")
        blank = bool(_ONLY_MARKS.match(w)) and w[0] in ".,:;"
        if blank or "\x03" in m or "\x02" in m or m[:1].isdigit() or (w[:1].isupper() and (k > 0 or raw[1:2] and raw[1][:1].isupper())):
            value = "" if blank else _DIGITS.sub("0", m)
            if fixed and fixed[-1] == "^":
                slots[-1] = f"{slots[-1]} {value}".strip()
            else:
                fixed.append("^")
                slots.append(value)
        elif m:
            fixed.append(m)
    return " ".join(fixed), slots


def _hash(s: str) -> int:
    return int.from_bytes(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def skeletons(text: str, page: Page) -> tuple[list[str], list[tuple[int, str, str]]]:
    """(skeletons of the sentences that name the speaker; number, skeleton and text of the lines that aren't a bare title)."""
    told, out = [], []
    for no, line in enumerate(text.split("\n"), 1):
        f = fold(line)
        if not f:
            continue
        slots = SLOT.sub("\x03", f) if _MAY.search(f) else f
        masked = page.mask(slots)
        words = _WORD.findall(masked)
        if page.names_speaker(f) and len(words) >= SENTENCE_WORDS and f[-1:] in ".!?:;" and "\x03" not in slots:
            told += [" ".join(frames(page.mask(x))) for x in _SENTENCES.split(line.strip()) if page.names_speaker(fold(x))] or [masked]
        if "\x02" in masked and "\x03" not in masked and page.is_title(line, f):
            continue  # the name, its years, the site: a bare title
        out.append((no, _DIGITS.sub("0", _HEX.sub("0", masked)), line))
    return told, out


def residue_pages(pages: DataFrame, net: boilerplate.BiLSTM | None = None) -> DataFrame:
    """``id`` of each page (``id, url, cleaned_text`` and, if known, the speaker's ``name``; other columns are ignored) without real content but with residue.

    A null, empty or blank text is no case. A page on which no sentence says anything of the speaker is one if it has a residue line
    and no other line of main body. Where neither ``name`` nor the url tells a name, a page is judged by its lines alone. Repeated ids are judged row by row and returned once.
    All lines of all pages are counted; the counts are combined before they are shuffled and nothing is collected.
    """
    net = net or boilerplate.train(pages)
    box = pages.sparkSession.sparkContext.broadcast(net.p)  # fixed size

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = boilerplate.BiLSTM()
        net.p = box.value
        for pdf in batches:
            rows, bare, said, seen = [], [], {}, {}
            for i, row, url, name, text in zip(pdf["id"], pdf["row"], pdf["url"], pdf["name"], pdf["cleaned_text"]):
                page = Page(url, name)
                told, sk = skeletons(text, page)
                for t in set(told):
                    n, alone = said.get(t, (0, 0))
                    said[t] = (n + 1, alone + (len(told) == 1))
                for _, s, line in sk:
                    if s not in seen:
                        seen[s] = (_hash(s), *template(line, page))
                if len(told) > 1:
                    rows += [(i, row, None, seen[s][0], False) for s in {s for _, s, _ in sk}]
                else:
                    bare.append((i, row, sk, boilerplate.read_page(text, url, name), _hash(told[0]) if told else 0))
            for (i, row, sk, (nos, *_), told), probs in zip(bare, boilerplate.label(net, [b[3][1:3] for b in bare])):
                furniture = dict(zip(nos, probs >= 0.5))
                by: dict[str, bool] = {}
                for no, s, _ in sk:
                    by[s] = by.get(s, True) and bool(furniture.get(no, False))
                rows += [(i, row, told, seen[s][0], f) for s, f in by.items()]
            rows = [(*r, None, None, None, None, []) for r in rows]
            rows += [(None, None, None, _hash(t), None, n, alone, None, None, []) for t, (n, alone) in said.items()]
            rows += [(None, None, None, h, None, None, None, s, t, v) for s, (h, t, v) in seen.items()]
            yield pd.DataFrame(dict(zip(columns, map(lambda c: pd.Series(list(c), dtype=object), zip(*rows))))) if rows else pd.DataFrame(columns=columns)

    columns = ["id", "row", "told", "h", "furniture", "n", "alone", "skeleton", "template", "slots"]
    kind = pages.schema["id"].dataType.simpleString()
    texts = boilerplate._named(pages).filter("cleaned_text IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    # lines by their hashes; sentences about a speaker; and once a batch what each hash stands for
    out = cut(texts.mapInPandas(read, f"id {kind}, row bigint, told bigint, h bigint, furniture boolean, n bigint, alone bigint, skeleton string, template string, slots array<string>"))
    empty = out.filter("n IS NOT NULL").groupBy(F.col("h").alias("told")).agg(F.sum("n").alias("n"), F.sum("alone").alias("alone")).filter((F.col("n") >= ENOUGH) & (F.col("alone") >= ALONE * F.col("n")))
    lines = out.filter("row IS NOT NULL").select("id", "row", "told", "h", "furniture").join(empty.select("told", F.lit(True).alias("empty")), "told", "left")
    # told: null where several sentences name the speaker, 0 where none does
    lines = cut(lines.select("id", "row", (F.col("told").isNull() | ((F.col("told") != 0) & F.col("empty").isNull())).alias("content"), "furniture", "h"))
    what = out.filter("skeleton IS NOT NULL").groupBy("h").agg(F.first("skeleton").alias("skeleton"), F.first(F.xxhash64("template")).alias("t"), F.first("slots").alias("slots"))
    base = lines.select("content", "row").distinct().groupBy().agg(F.sum(F.when(F.col("content"), 1).otherwise(0)).alias("c"), F.sum(F.when(F.col("content"), 0).otherwise(1)).alias("s")).first()
    odds = ((base.s or 0) + 1.0) / ((base.c or 0) + 1.0)
    ratio = lambda s, c: F.log((s + 0.3) / (c + 0.3) / F.lit(odds))
    own = ratio(F.col("s"), F.col("c"))
    clip = lambda x: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), x))
    stats = lines.groupBy("h").agg(F.sum(F.when(F.col("content"), 0).otherwise(1)).alias("s"), F.sum(F.when(F.col("content"), 1).otherwise(0)).alias("c")).join(what, "h")
    stats = cut(stats.withColumn("rare", F.col("s") + F.col("c") < ENOUGH))
    # Columns of aligned lines: those with several values are slots
    columns = stats.select("h", "s", "c", "t", "rare", F.posexplode("slots").alias("pos", "value"))
    values = columns.groupBy("t", "pos", "value").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    slots = values.groupBy("t", "pos").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds >= 2").select("t", "pos")
    here = values.filter((F.col("s") > 0) & (F.col("s") + F.col("c") >= ENOUGH)).select("t", "pos", "value", clip(own).alias("here"))
    anywhere = values.groupBy("value").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).filter((F.col("s") > 0) & (F.col("s") + F.col("c") >= WORD_USES)).select("value", clip(own).alias("anywhere"))
    kept = columns.filter("rare AND s > 0").select("h", "t", "pos", "value").join(slots, ["t", "pos"], "left_semi").join(here, ["t", "pos", "value"], "left").join(anywhere, "value", "left")
    by_slots = kept.groupBy("h").agg(F.max(F.coalesce("here", "anywhere")).alias("slot_lift"))
    # The telling words of a rare skeleton, of those that are used elsewhere too; without any it stands for itself
    split = F.explode(F.array_distinct(F.split(F.trim(F.regexp_replace("skeleton", r"[^\p{L}\u0003]+", " ")), " "))).alias("word")
    words = stats.select(split, "s", "c").groupBy("word").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    words = words.select("word", (F.col("s") + F.col("c")).alias("uses"), clip(own).alias("lift"))
    rare = stats.filter("rare AND s > 0").select("h", own.alias("own"), split)
    top = F.slice(F.sort_array(F.collect_list(F.when(F.col("uses") >= WORD_USES, F.col("lift"))), asc=False), 1, 3)  # at most the words of a line
    by_words = rare.join(words, "word", "left").groupBy("h").agg(top.alias("top"), F.first("own").alias("own"))
    by_words = by_words.select("h", F.when(F.size("top") > 0, F.aggregate("top", F.lit(0.0), lambda a, b: a + b) / F.size("top")).otherwise(F.col("own")).alias("lift"))
    by_words = by_words.join(by_slots, "h", "left").select("h", F.greatest("lift", "slot_lift").alias("lift"))
    known = stats.filter("NOT rare AND s > 0").select("h", own.alias("lift"))
    lift = stats.filter("s > 0").select("h", "s", own.alias("own")).join(known.unionByName(by_words), "h")
    judged = lines.filter("NOT content").select("id", "row", "h", "furniture").join(lift, "h", "left")
    residue = F.greatest(F.col("lift"), F.when(F.col("s") >= 2, F.col("own"))) >= RESIDUE
    against = ~F.col("furniture") & (F.coalesce("lift", F.lit(0.0)) < CONTENT)
    judged = judged.groupBy("row").agg(F.first("id").alias("id"), F.max(residue.cast("int")).alias("yes"), F.max(against.cast("int")).alias("no"))
    return judged.filter("yes = 1 AND no = 0").select("id").distinct()
