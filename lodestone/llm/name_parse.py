"""Reading one typed name: titles, order, initials, nicknames, suffixes; party names and their acronyms."""

from __future__ import annotations

import re
import unicodedata

#: Words of address, office and degree that stand beside a name (folded).
TITLES = frozenset(
    """mr mrs ms miss dr prof professor sir dame lord lady hon honourable honorable right rt the a minister prime deputy president vice
    senator congressman congresswoman commissioner chancellor state secretary chair chairman chairwoman speaker member mp mep td
    representative councillor governor mayor ambassador judge justice hc herr frau hr fru froken senor senora senhor senhora sr sra don dona
    exmo exma excmo excma monsieur madame mme mlle mons pan pani ing mgr judr mudr phdr bc doc statsrad pr dipl mag signor signora sig onorevole
    on dott avv dhr mevr mevrouw meneer drs ir gospodin gospodja g ga ur dr. poslanec poslankyne ministre ministra ministro depute diputado diputada
    deputado deputada abg abgeordneter abgeordnete""".split()
)
LONG_TITLES = tuple(t for t in TITLES if len(t) >= 5)
#: Particles of family names.
PARTICLES = frozenset("von van der den de del della dei la le les du des da do dos das di zu zum zur af av z ze ten ter te el al y e i og und and".split())
#: Labels that name nobody.
NOBODY = frozenset("nan none null unknown n/a na anonymous various several".split())
ARTICLES = frozenset("the this that those these a an some".split())
#: Nouns that make a political group of a name (folded singular).
GROUPS = frozenset(
    """party union rally bloc block front league initiative alliance movement assembly coalition congress federation group list democrats
    partei bund liste partido partit union parti rassemblement mouvement ligue partito lega movimento strana hnuti partia ruch parti lista
    alianza frente coalicion bloque bewegung allianz""".split()
)
PARTY_STOP = frozenset("the of and for a an o t party's group in".split())
#: Common short forms of given names; further pairs are learned from forms that give both.
NICKNAMES = """robert bob bobby rob robbie|william bill billy will liam|richard dick rick rich richie|edward ted ed eddie ned|james jim jimmy jamie|
john jack johnny|michael mike mick mikey|thomas tom tommy|charles charlie chuck|margaret maggie meg peggy|elizabeth liz beth betty lizzie eliza|
katherine kate kathy katie kitty|catherine cathy kate katie|patricia pat patty trish|susan sue susie|deborah debbie deb|jennifer jenny jen|
anthony tony|christopher chris kit|nicholas nick nicky|andrew andy drew|daniel dan danny|david dave davey|stephen steve|steven steve|gregory greg|
lawrence larry|leonard len lenny leo|walter walt wally|frances fran fanny|francis frank|theresa tess terry tessa|rebecca becky becca|victoria vicky tori|
philip phil pip|penelope penny|desmond des|gwendolyn gwen|harriet hattie harry|judith judy jude|beverley bev|howard howie|raymond ray|ronald ron|
donald don|kenneth ken|joseph joe|matthew matt|samuel sam|benjamin ben|alexander alex sandy|alexandra alex sandra|heinrich heinz heini|friedrich fritz|
johannes hans hannes|wolfgang wolf|konrad kurt|elisabeth lisa elli liesel|ursula uschi|brigitte gitti|katharina kathi|maximilian max|josef sepp|
jose pepe|francisco paco pancho|eduardo edu|enrique quique|rafael rafa|concepcion concha conchita|beatriz bea|guadalupe lupe|ignacio nacho|manuel manolo|
dolores lola|rosario charo|jiri jirka|josef pepa|frantisek franta|katarzyna kasia|katerina katka|krzysztof krzys|jan honza|gyorgy gyuri|istvan pista|ilona ica|
jozsef joska|bernhard bernd|gabriele gabi|ludmila lida|domenico mimmo|nikolaj kolja|hildegard hilde|mercedes merche|salvador salva|imogen immy|joachim jochen|manfred manni|andreas andi|matthias matze|karl charly|gustav gusti|christine tina|cecile cissi|genevieve ginette|jeronimo jero|consuelo chelo|rosemary rosie|veronica vero|vladimir vlado|zdenek zdena|vojtech vojta|stanislav standa|malgorzata gosia|agnieszka aga|barbara basia|zoltan zoli|gabor gabi|katalin kati|erzsebet bozsi|judit jutka|mihaly misi|gudrun gunna|kristina stina|margareta greta|torbjorn tobbe|sandor sanyi|sigurdur siggi|lars lasse|mikael micke|per pelle|ljubomir ljubo|radovan rado|alexandre alex|benoit ben|dominique dom|lucien lulu"""

_SPECIAL = str.maketrans({"ß": "ss", "ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "ı": "i", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "’": "'", "‘": "'", "`": "'", "´": "'", "“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "‐": "-", "‑": "-", "–": "-"})
_DIGIT = str.maketrans("10538", "loseb")


def fold(s: str) -> str:
    """Without accents, in lower case."""
    s = unicodedata.normalize("NFKD", s.translate(_SPECIAL))
    return "".join(c for c in s if not unicodedata.combining(c)).lower()


def near(a: str, b: str) -> bool:
    """Whether a and b are one insertion, deletion, substitution or swap of neighbours apart, or equal."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < la and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :] if la < lb else a[i + 1 :] == b[i:]


def look(s: str) -> str:
    """One form for letters that scanning mixes up."""
    for a, b in LOOKS:
        s = s.replace(a, b)
    return s


#: Letter groups that scanning or transliteration puts for others, applied in this order.
LOOKS = (("ph", "f"), ("ae", "a"), ("oe", "o"), ("ue", "u"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("ri", "n"))


def deletions(s: str) -> list[str]:
    """Keys of which two strings within one edit or swap share at least one."""
    return sorted({s, look(s), *(s[:i] + s[i + 1 :] for i in range(len(s)))})


def nickname_pairs() -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for line in NICKNAMES.replace("\n", "").split("|"):
        full, *short = line.split()
        for s in short:
            out.setdefault(full, set()).add(s)
            out.setdefault(s, set()).add(full)
    return out


def _is_title(word: str, raw: str) -> bool:
    if word in TITLES:
        return True
    return len(word) >= 5 and raw[:1].isalpha() and any(abs(len(t) - len(word)) <= 1 and near(word, t) for t in LONG_TITLES)




def parse_party(name: str) -> dict | None:
    """tokens of a party name: ``toks`` (significant, folded, singular), ``acr`` (its acronym or its own letters), ``squash``."""
    s = " ".join(name.split())
    inner = re.findall(r"\(([^)]*)\)", s)
    s = re.sub(r"\([^)]*\)", " ", s).strip()
    letters = re.sub(r"[.\s]", "", re.sub(r"\s+group$", "", s, flags=re.I))
    if re.fullmatch(r"[A-ZÀ-Þ]{2,6}", letters) and " " not in re.sub(r"\s+group$", "", s, flags=re.I).strip():
        return {"toks": [], "acr": fold(letters), "squash": "", "plain": ""}
    words = [fold(w).translate(_DIGIT) if re.search(r"[^\W\d_]", w) else w for w in re.split(r"[\s,\-]+", s) if w]
    toks, firsts = [], []
    for w in words:
        w = re.sub(r"[^\w]", "", w)
        if not w or w in PARTY_STOP or len(w) < 2:
            continue
        if len(w) > 3 and w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        toks.append(w)
        firsts.append(w[0])
    if not toks:
        return None
    acr = fold(inner[0]) if inner and re.fullmatch(r"[A-Z]{2,6}", inner[0]) else "".join(firsts)
    return {"toks": sorted(set(toks)), "acr": acr if len(toks) >= 3 or inner else "", "squash": "".join(sorted(set(toks))), "plain": re.sub(r"[^\w]", "", re.sub(r"^the\s+", "", fold(s)))}


def is_party(name: str, hint: bool) -> bool:
    if hint:
        return True
    if not name or fold(name) in NOBODY:
        return False
    words = [re.sub(r"[^\w]", "", fold(w)) for w in name.split()]
    caps = sum(w[:1].isupper() for w in name.split())
    return caps >= 2 and any(w in GROUPS for w in words)


def parse_person(name: str) -> dict | None:
    """What the form of a typed name tells: ``long`` (folded words in order), ``inits``, ``abbr``, ``alias``, and how far the family name
    is certain: ``fam`` and ``giv`` hold the words that a comma, a title before a single word, capitals or an initial mark as such."""
    s = unicodedata.normalize("NFC", name).translate(_SPECIAL)
    s = " ".join(s.split())
    if not s or s[0] in "[<{" or fold(s) in NOBODY:
        return None
    alias: list[str] = []
    m = re.search(r"""[("]\s*([^)"]+?)\s*[)"]""", s)
    if m:
        inside, after = m.group(1), s[m.end() :].strip(" .,")
        if after and " " not in inside and m.start() > 0:
            alias.append(fold(inside))
        s = (s[: m.start()] + " " + s[m.end() :]).strip()
    parts = [p.strip() for p in s.split(",")]
    if len(parts) > 1 and parts[-1]:
        last = parts[-1].rstrip(".")
        if " " not in last and len(last) <= 4 and last != "" and (last.lower() in ("ind", "grn") or (len(last) >= 2 and last.isupper() and not parts[0].isupper()) or (len(last) >= 2 and not re.search(r"[aeiouy]", fold(last)))):
            parts = parts[:-1]
    comma = len(parts) > 1
    longs: list[tuple[str, int, bool]] = []  # word, part, capitals
    inits: list[tuple[str, int]] = []
    abbr: list[str] = []
    titled = False
    lead = True
    raw_all = s.isupper()
    for pi, part in enumerate(parts[:2]):
        for raw in part.split():
            hyph = raw.split("-") if "-" in raw.strip("-") else [raw]
            base = fold(raw)
            word = re.sub(r"[^\w]", "", base)
            if not word or (len(word) == 1 and raw[0].islower() and s != s.lower()):  # also z., v., d.: shortened particles
                continue
            if lead and _is_title(word, raw) and not (len(word) == 1):
                titled = True
                continue
            if re.fullmatch(r"(?:[^\W\d_]\.){1,3}|[^\W\d_]\.?", raw):
                inits += [(c, pi) for c in fold(raw.replace(".", ""))]
                lead = lead and not longs
                continue
            if word in PARTICLES and not raw.isupper():
                continue
            if word in PARTICLES and len(word) <= 3:
                continue
            lead = False
            if word in TITLES and len(word) >= 2 and (longs or comma):  # MP and the like after the name
                continue
            if raw.endswith(".") and len(word) >= 2 and raw != part.split()[-1]:
                abbr.append(word)
                continue
            if raw.endswith(".") and len(word) >= 3 and comma and pi == 1:
                abbr.append(word)
                continue
            for h in hyph:
                w = re.sub(r"[^\w]", "", fold(h)).translate(_DIGIT)
                if len(w) >= 2 and w not in PARTICLES:
                    longs.append((w, pi, h.isupper() and len(h) > 2 and not raw_all))
    if not longs:
        return None
    head = [re.sub(r"[^\w]", "", fold(w)) for w in s.split()[:2]]
    if fold(s.split()[0]) in ARTICLES and (len(head) < 2 or not _is_title(head[1], head[1])):
        return None  # "the press"; a title may follow an article, as in "the Honourable"
    if titled and any(re.fullmatch(r"of|for|fur", fold(w)) and _is_title(fold(v), v) for v, w in zip(s.split(), s.split()[1:])) and not comma:
        return None  # an office and what it is for
    words = [w for w, _, _ in longs]
    fam: list[str] = []
    giv: list[str] = []
    if comma and any(p == 1 for _, p, _ in longs) or comma and inits:
        fam, giv = [w for w, p, _ in longs if p == 0], [w for w, p, _ in longs if p == 1]
    elif any(c for _, _, c in longs) and not all(c for _, _, c in longs):
        fam, giv = [w for w, _, c in longs if c], [w for w, _, c in longs if not c]
    elif len(words) == 1 and (titled or inits or abbr) or len({w for w in s.replace(",", " ").split() if "-" in w}) == 1 and len(words) == max(len(w.split("-")) for w in s.replace(",", " ").split()):
        fam = words
    return {"long": words, "inits": [c for c, _ in inits], "abbr": abbr, "alias": alias, "fam": fam, "giv": giv, "lead_init": bool(inits) and not comma and bool(re.match(r"^[^\W\d_]\.\s", s)), "titled": titled}
