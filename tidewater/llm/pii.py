"""Personal information in conversation turns: found, typed, and replaced by readable placeholders.

Information-theoretic sanitisation in four steps:

1. `candidates` reads every record once, as a reader sees it. Recognisers propose spans from general shapes: runs of
   digits in any script, spelled, leet or spaced; address shapes; identity-number shapes; mail addresses plain or
   spelled out; runs of capitalised words; pieces of a number or mail address that are given turn by turn. A proposal
   whose form alone tells its type is a *seed*, a protected entity: for names a title, a self-introduction, a relative
   or helper by name, an act of speech. The others (plain digit runs, other capitalised runs) are open.
2. Corpus co-occurrence: terms with the contexts they stand in, counted over all records. P(name | term) over the seeds
   says how strongly a term discloses a person; the mean of that over the terms of a context, how strongly the context
   does. For numbers, log2 P(context | kind) / P(context | coded) of the seed phones, identity and coded numbers.
3. Disclosure thresholds: a term is a name if enough of its occurrences stand in disclosing contexts, and then wherever
   it occurs, except as part of a property's name, a handle or an address. An open number is what its contexts disclose
   most, if that exceeds the threshold.
4. `redact` generalises each disclosed span to a placeholder of its type and leaves the rest of the text as it is.

Counts are joined, never collected: terms and contexts can be as many as the corpus makes them.

Types: phone, email, id_number, street_address, person_name. Payment handles (no dotted domain), platform handles,
links and coded numbers (bookings, invoices, parcels, flights, devices, meters) are none of them.

Defined results: null turns have no spans; texts are processed whole; repeated records are reported under each id;
without any seed in the corpus open numbers fall back to their length; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater import constants as K
from tidewater.llm.skeleton import consistent
from tidewater.runtime import cut, spread

# ---------------------------------------------------------------- numbers

# Digit words, leet spellings included.
DIGIT_WORDS = (
    ("0", r"z[e3]r[o0]|[o0]h|sh[ou]o?nya"),
    ("1", r"[o0]n[e3]|ek"),
    ("2", r"tw[o0]|do"),
    ("3", r"thr[e3]{2}|teen"),
    ("4", r"f[o0]ur|ch?aar?"),
    ("5", r"f[i1!]v[e3]|paa?nch"),
    ("6", r"[s5][i1!]x|chh?[ea]h?"),
    ("7", r"[s5][e3]v[e3]n|saat"),
    ("8", r"[e3][i1!]ght|aath"),
    ("9", r"n[i1!]n[e3]|nau"),
)
WORD_UNIT = "|".join(p for _, p in DIGIT_WORDS)
UNIT = rf"(?:\d️?⃣?|(?:(?:double|triple)\s+)?(?:{WORD_UNIT})|(?:double|triple)\s+\d)"
GAP = r"(?:[\s.,*/_|\-–—()+]{0,3}|\s*\(?\s*(?:then|phir)\s*\)?\s*)"
NUMBER = re.compile(rf"(?<![^\W_])(?:\+\s?)?\(?{UNIT}(?:{GAP}{UNIT})*(?![^\W_])", re.I)
LOOKS_DIGIT = re.compile(r"(?<![^\W_])(?=[\dOolI|S]*\d)(?=[\dOolI|S]*[OolI|S])[\dOolI|S]{2,}(?![^\W_])")
ONE_UNIT = re.compile(rf"(?:(double|triple)\s+)?(?:(\d)|({WORD_UNIT}))", re.I)
WORD_VALUES = [(v, re.compile(p, re.I)) for v, p in DIGIT_WORDS]


def digits_of(run: str) -> str:
    out = []
    for times, digit, word in ONE_UNIT.findall(run):
        d = str(int(digit)) if digit else next(v for v, p in WORD_VALUES if p.fullmatch(word))
        out.append(d * {"double": 2, "triple": 3}.get(times.lower(), 1))
    return "".join(out)


def readable_digits(text: str) -> str:
    """Letters that stand for digits inside a number become digits (same length)."""
    return LOOKS_DIGIT.sub(lambda m: m.group().translate(str.maketrans("OolI|S", "001115")), text)


# ---------------------------------------------------------------- shapes

IDS = re.compile(
    r"(?<![\w-])(?:[A-Z]{5}[\s-]?\d{4}[\s-]?[A-Z]|[A-Z]{2}[\s-]?\d{2}[\s-]+(?:19|20)\d{2}[\s-]?\d{6,8}|[A-Z]{2}\d{2}(?:19|20)\d{9}|[A-Z]\d{7}|\d{3}-\d{2}-\d{4}|"
    r"[A-Z]{2}\d{6}[A-Z]|\d{2}[A-Z]{2}\d{5})(?![\w-])",
    re.I,
)
#: Numbers behind a word that says what they are.
CUED_ID = re.compile(r"\b(?:ssn|social security|aadha?ar|passport|driving licen[cs]e|tax id|steuer-?id|personalausweis)(?:\s+(?:no\.?|number|is|hai))*\s*[:#]?\s*([A-Z]{0,3}\d(?:[\s-]?\d){5,13})(?![\w-])", re.I)
STREET = r"(?:street|st|road|rd|lane|ln|close|avenue|ave|marg|nagar|gali|crescent|boulevard|blvd)"
BLOCK = r"(?:residency|towers?|apartments?|heights|enclave|mansions?)"
NAME_WORD = r"(?!(?:a|an|the|in|on|at|of|to|is|for|from|and|or|by|with)\b)[^\W\d_]+"
AREA = rf"(?:\s*,\s*{NAME_WORD}(?:\s+{STREET}\b\.?)?)"
ADDRESS = re.compile(
    rf"""(?<![\w/#])(?:
      (?:flat|apartment|apt|unit|door|room)\s*(?:no\.?)?\s*\d+\s?-?[a-z]?\s*,?\s*(?:[\w\s]{{1,30}},\s*){{0,4}}[\w\s]{{0,30}}\b(?:{BLOCK}|{STREET})\b{AREA}{{0,2}}
    | (?:house|h\.?|plot|door)\s*(?:no\.?)?\s*\d+[\w/-]*\s*,\s*[^.;!?\n]{{0,60}}?\b(?:{NAME_WORD}\s+)?(?:marg|nagar|road|street|lane)\b\.?(?:\s*,\s*{NAME_WORD}(?:\s+\d{{5,6}})?)?
    | \d{{1,4}}(?:\s?[/-]\s?\w{{1,3}})?[a-z]?\s+(?:{NAME_WORD}\s+){{1,3}}{STREET}\b\.?(?:\s+(?:apt|flat|unit)\.?\s*\d+)?(?:,?\s*{NAME_WORD})?
    | {NAME_WORD}(?:weg|stra(?:ß|ss)e|str\.|gasse|platz|allee)\s+(?:nr\.?\s*)?\d+[a-z]?(?:\s*,\s*\d{{5}}\s+{NAME_WORD})?
    | \d{{1,4}}(?:\s?(?:bis|ter))?\s*,?\s+(?:rue|quai|impasse|chemin|boulevard|avenue)\s+(?:(?:de|du|des|la|le)\s+){{0,2}}{NAME_WORD}(?:\s*,\s*(?:\d{{5}}\s+)?{NAME_WORD})?
    | (?:calle|avenida|rue|via)\s+{NAME_WORD}(?:\s+{NAME_WORD})?\s*,?\s*\d+(?:\s*,\s*piso\s*\d+)?(?:\s*,\s*{NAME_WORD})?
    )""",
    re.I | re.X,
)

_SPELLED = [w for w in (*K.AT_WORDS.split("|"), *K.DOT_WORDS.split("|")) if w.isalnum()]
AT_SPELLED = "|".join(w for w in _SPELLED if w in K.AT_WORDS.split("|"))
DOT_SPELLED = "|".join(w for w in _SPELLED if w in K.DOT_WORDS.split("|"))
AT = rf"(?:\s*@\s*|\s*[\[({{<]\s*(?:{K.AT_WORDS})\s*[\])}}>]\s*|\s+(?:{AT_SPELLED})\s+)"
DOT = rf"(?:\s*[\[({{<]\s*(?:{K.DOT_WORDS})\s*[\])}}>]\s*|\s+(?:{DOT_SPELLED})\s+)"
#: What a text must hold before the patterns of mail addresses, links and street addresses are tried on it.
MAY_MAIL = re.compile(rf"@|{DOT_SPELLED}|(?:{AT_SPELLED})\s*[\])}}>]", re.I)
MAY_LINK = re.compile(r"[/@#]|www", re.I)
STREET_WORDS = frozenset(w for p in (STREET, BLOCK) for w in p[3:-1].replace("towers?", "tower|towers").replace("apartments?", "apartment|apartments").replace("mansions?", "mansion|mansions").split("|")) | {
    "calle", "avenida", "rue", "via", "quai", "impasse", "chemin"
}
STREET_ENDS = ("weg", "straße", "strasse", "str.", "gasse", "platz", "allee")


def may_address(text: str) -> bool:
    low = text.lower()
    return any(e in low for e in STREET_ENDS) or not STREET_WORDS.isdisjoint(LETTER_RUN.findall(low))


LETTER_RUN = re.compile(r"[^\W\d_]+")
LABEL = r"[a-z0-9][a-z0-9-]*"
LOCAL = rf"[a-z0-9][a-z0-9._%+-]*(?:{DOT}[a-z0-9][a-z0-9._%+-]*)?"
PERIOD = rf"(?:\.(?=\S)|\s\.\s|{DOT})"
EMAIL = re.compile(
    rf"""(?<![\w.@/])(?:mailto:)?(?:
      {LOCAL}\s*@\s*{LABEL}(?:{PERIOD}{LABEL})+
    | {LOCAL}(?:{AT})(?!www\b){LABEL}(?:{DOT}{LABEL})+
    | {LOCAL}\s*[\[({{<]\s*(?:at|aat|@)\s*[\])}}>]\s*{LABEL}(?:{PERIOD}{LABEL})+
    | (?:[a-z0-9._%+-]\s){{3,}}@\s(?:[a-z0-9-]\s){{2,}}\.\s(?:[a-z0-9.-]\s?(?![^\W_]{{2}})){{2,}}
    )(?!\w)(?!\s*(?:/|slash\b|[\[({{<]\s*(?:at|aat|@)\b))""",
    re.I | re.X,
)
LINK = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)+/\S*|\bwww\s+dot\b.*?(?:\bslash\s+\S+|$)|\S+@\S+|(?<!\w)@\w[\w.]*|\S+#\d{3,}", re.I)

# ---------------------------------------------------------------- names

# Words that are never a person's name in the frames below.
NOT_A_NAME = set(
    """the a an our my your his her their this that these those every each no nobody one two all some any it we you they he she i there here what who when
    guest guests host owner cook nephew niece caretaker porter gardener husband wife uncle aunt son daughter sister brother brother-in-law mother father
    grandmother grandfather guide driver plumber painter electrician carpenter cleaner teammate colleague co-host flatmate roommate landlord tenant neighbour
    receptionist cousin friend manager villa casa hotel parking breakfast booking wifi please kindly thankfully great okay ok thanks hi hello namaste the
    aap hum main mera mere woh yeh aaj kal parso aur bas kripya mujhe agar kya yaar suno ab phir pehle uske pe se ko ki ke ka hai na ne ho toh bhi
    asked whether said says told kept found opened rukwa mil pi
    somvaar mangalvaar budhvaar guruvaar shukravaar shanivaar ravivaar monday tuesday wednesday thursday friday saturday sunday""".split()
)
#: Hindi verbs that are given names too; only capitalised ones away from a sentence's start count.
VERB_OR_NAME = {"lena", "dena"}
# Words that show what form alone settles.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "shri", "smt", "herr", "frau", "señora", "señor", "madame"}
RELATION = set(
    """cook nephew niece caretaker porter gardener husband wife uncle aunt son daughter sister brother brother-in-law mother father grandmother grandfather guide driver plumber
    painter electrician carpenter cleaner teammate colleague co-host flatmate roommate landlord tenant neighbour receptionist cousin friend manager""".split()
)
POSSESSIVE = {"my", "our", "his", "her", "their", "mere", "meri", "mera", "hamare", "hamari", "apne", "apni"}
INTRODUCES = {("name", "is"), ("mera", "naam"), ("meri", "naam"), ("am", "called"), ("is", "called"), ("is", "named"), ("are", "called"), ("name", "of"), ("this", "is")}
SPOKEN_TO = {"tell", "ask", "thank", "inform", "remind", "meet", "met"}
SPEAKS = {"told", "said", "says", "wrote", "ji"}
SOUGHT = {(a, "for") for a in ("ask", "asking", "look", "looking", "wait", "waiting")} | {(a, "under") for a in ("is", "booking", "booked", "reservation")} | {(a, ":") for a in ("guest", "guests", "name", "names")}
ASKS = {"did", "does", "has", "can", "could", "would", "will"}
SIGNS_OFF = {"thanks", "regards", "cheers", "dhanyavaad", "love"}
AFTER_THIS_IS = {"writing", "calling", "speaking", "texting", "here"}
PART = r"(?:[^\W\d_]\.|[^\W\d_]{2,}(?:['’-][^\W\d_]+)*)"
# Fillers around what a turn says.
FILLER = r"(?:hello there|hello ji|hello|hi|hey|arre|ok(?:ay)?(?:\s+na)?|just saying|by the way|bas|theek hai|thanks|cheers|haan)"
# Words before or after a name that make it the name of a property, shop or street.
PROPERTY_BEFORE = set("villa casa hotel hostel café cafe chez homestay cottage palazzo haus restaurant pension".split())
PROPERTY_AFTER = set("bakery villa hotel hostel cafe café store shop stores market kitchen road street lane marg residency tower house homestay cottage inn".split())
OWNER = re.compile(r"['’]s$", re.I)

# Words that open a sentence with a capital; where its stop is missing they stand beside a name.
OPENERS = set(
    """since for five four three two six seven eight nine ten before after while when where why how who what which whose if as at by on in of to from with
    without until because although and but or so then now today tomorrow yesterday every each some many most both only just also perhaps maybe sadly
    frankly did does do can could will would should may might must is are was were has have had be been not never always contact call write reach ask
    give take keep leave bring see pay send use turn check ring text invoice reservation booking easier does guests before tell during between
    under over near inside outside once again january february march april may june july august september october november december
    humne tumne usne maine unhone jab tab kahan kaun kaise kab kyunki lekin yahan wahan har roz pichhle agle cab room key door house number""".split()
)

# ---------------------------------------------------------------- pieces over turns

OPENS = re.compile(rf"^(?:\s*{FILLER}?\s*[,.!?]+\s*)+", re.I)
CLOSES = re.compile(rf"(?:[\s,.!?]+{FILLER}?\s*[,.!?]+)+\s*$", re.I)
PIECE_FRAMES = re.compile(
    r"^\s*(?:then|first bit:?|last part is|note|next is|phir|aur last mein|last mein|pehle|ab|uske baad|and|aur)?\s*(?P<x>.+?)\s*(?:after that|next|likho|likh lo)?\s*[.!]?\s*$", re.I
)
PLATFORM = re.compile(r"^(?:insta(?:gram)?|telegram|snap(?:chat)?|discord|whatsapp|wa|fb|facebook|kik|line|signal|twitter|x)$", re.I)
AT_PIECE = re.compile(rf"^(?:(?:[a-z0-9._%+-]+\s*)?@\s*(?:{LABEL}(?:\.{LABEL})*)?|(?:at|aat)\s+{LABEL}(?:\s*(?:dot|\.)\s*{LABEL})*)$", re.I)
DOMAIN_PIECE = re.compile(rf"^(?:(?:dot|\.)\s*{LABEL}(?:\s*(?:dot|\.)\s*{LABEL})*|{LABEL}(?:\.{LABEL})+)$", re.I)
LOCAL_PIECE = re.compile(r"^[a-z][a-z0-9._%+-]*\d[a-z0-9._%+-]*$|^[a-z]+[._-][a-z0-9._-]+$", re.I)


SENTENCE = re.compile(r"[^.!?।…\n](?:[^.!?।…\n]|[.!?](?=\S))*[.!?।…]*")


def pieces(texts: list[str]) -> dict[int, list[tuple[str, int, int]]]:
    """turn number -> (type, start, end) of pieces of one phone number or mail address over several turns. A piece is the
    whole of a sentence but for words that lead up to it or close it; the turn may hold other sentences."""
    if len(texts) < 2:
        return {}
    numbers: dict[int, list[tuple[str, int, int]]] = {}
    mails: dict[int, list[tuple[int, int, bool]]] = {}
    platform = False
    for k, text in enumerate(texts, 1):
        opens, closes = OPENS.match(text), CLOSES.search(text)
        start, end = opens.end() if opens else 0, closes.start() if closes else len(text)
        # the turn as one sentence, else each of its sentences
        whole = PIECE_FRAMES.match(text[start:end])
        spans = [(start, end)] if whole and _piece(whole["x"]) else [m.span() for m in SENTENCE.finditer(text)]
        for lo, hi in spans:
            m = PIECE_FRAMES.match(text[lo:hi])
            kind = _piece(m["x"]) if m else None
            if kind is None:
                continue
            span = (lo + m.start("x"), lo + m.end("x"))
            if kind == "number":
                numbers.setdefault(k, []).append((digits_of(readable_digits(m["x"].strip())), *span))
            elif kind == "platform":
                platform = True
            else:
                mails.setdefault(k, []).append((*span, kind == "at"))
    out: dict[int, list[tuple[str, int, int]]] = {}
    if len(numbers) > 1 and sum(len(d) for ds in numbers.values() for d, _, _ in ds) >= 8:
        for k, ds in numbers.items():
            out.setdefault(k, []).extend(("phone", a, b) for _, a, b in ds)
    if len(mails) > 1 and not platform and any(s for ms in mails.values() for _, _, s in ms):
        for k, ms in mails.items():
            out.setdefault(k, []).extend(("email", a, b) for a, b, _ in ms)
    return out


def _piece(x: str) -> str | None:
    """What a sentence is as a piece: number, platform, at (holds the at-sign), mail, or nothing."""
    x = x.strip()
    if not x or x.count(" ") > 40:  # more words than any number or address spelled out
        return "number" if x and NUMBER.fullmatch(readable_digits(x)) else None
    if NUMBER.fullmatch(readable_digits(x)):
        return "number"
    if PLATFORM.match(x):
        return "platform"
    if AT_PIECE.match(x):
        return "at"
    return "mail" if DOMAIN_PIECE.match(x) or LOCAL_PIECE.match(x) else None


# ---------------------------------------------------------------- candidates

# Code words before numbers that name a thing.
CODED = re.compile(r"(?:^|[^\w])(?:[A-Z]{2,4}[-\s]?)$")
EVASIVE = re.compile(rf"[^\W\d_]|[^\x00-\x7f]|^\+", re.I)
CONTEXT_WORD = re.compile(r"[^\W\d_]+|\d+")


def contexts(text: str, a: int, b: int) -> list[str]:
    """Context features of a span: the words around it, single and in pairs."""
    left = [w.lower() if not w.isdigit() else "9" for w in CONTEXT_WORD.findall(text[max(0, a - 60) : a])][-3:]
    right = [w.lower() if not w.isdigit() else "9" for w in CONTEXT_WORD.findall(text[b : b + 60])][:3]
    left, right = ["^"] * (3 - len(left)) + left, right + ["$"] * (3 - len(right))
    return [f"l {left[-1]}", f"l {left[-2]} {left[-1]}", f"r {right[0]}", f"r {right[0]} {right[1]}", f"b {left[-1]} {right[0]}"]


NAME_TOKEN = re.compile(r"[^\W\d_]\.(?=\s[^\W\d_])|[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|[^\w\s]|_")
STOPS = set(".!?।…\"“(")
#: Capitals inside a word: only behind a particle, a hyphen or an apostrophe.
INNER_CAPITAL = re.compile(r"^(?!Mc|Mac|De|Di|Du|La|Le|Van|Von)[^\W\d_]*[^\W\d_'’-][A-Z]")


def _name_like(word: str, following: str) -> bool:
    """A capital and small letters, an initial, or three capitals and more that are no code; no word of the language."""
    if not word[0].isupper():
        return False
    w = word.lower()
    if w.endswith("."):  # an initial
        return True
    if w in NOT_A_NAME or w in OPENERS or w in SPOKEN_TO or w == "let" or word.endswith("'s") or word.endswith("’s"):
        return False
    if not word.isupper() and INNER_CAPITAL.match(word):
        return False
    return len(w) == 1 or not word.isupper() or (len(w) > 2 and not following[:1].isdigit() and following != "-")


def words_and_runs(text: str, busy: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int, list[str], list[str]]], list[tuple[str, int, int]]]:
    """(runs, words): the runs of words that are written like a name as (start, end, seed, terms, contexts), seed 2 where
    form alone settles it, 1 where it makes a name likely; and the
    other words as (term, start, end), which are decided by their term alone. A turn without capitals, or in capitals, hides which
    words are written like names, so it has no runs."""
    toks = [(m.start(), m.end(), m.group()) for m in NAME_TOKEN.finditer(text)]
    words = [t[2] for t in toks]
    cased = any(w[0].isupper() and w[1:].islower() for w in words if len(w) > 1)
    low = [w.lower() if not w.isdigit() else "9" for w in words]
    n = len(toks)
    # a stretch of more than three words in capitals is written in capitals, not a name
    loud = [False] * n
    capitals: list[int] = []
    for k in range(n + 1):
        if k < n and (not words[k][0].isalpha() or len(words[k]) == 1):
            continue
        if k < n and words[k].isupper():
            capitals.append(k)
            continue
        if len(capitals) > 3:
            for c in capitals:
                loud[c] = True
        capitals = []
    word = lambda i: low[i] if 0 <= i < n else "^" if i < 0 else "$"
    hit = lambda a, b: any(x < b and a < y for x, y in busy)
    place = lambda i, j: word(i - 1) in PROPERTY_BEFORE or (word(j) in PROPERTY_AFTER and text[toks[j - 1][1] : toks[j][0]].isspace()) or low[j - 1] in PROPERTY_AFTER or bool(OWNER.search(words[j - 1]))
    runs, loose = [], []
    i = 0
    while i < n:
        a, b, w = toks[i]
        following = words[i + 1] if i + 1 < n else ""
        title = cased and low[i].strip(".") in TITLES and (w[0].isupper() or following == ".")
        first = j = i + 1 + (following == ".") if title else i
        while cased and j < n and j - first < 3 and not loud[j] and _name_like(words[j], words[j + 1] if j + 1 < n else "") and (j == first or text[toks[j - 1][1] : toks[j][0]] in (" ", "")):
            j += 1
        if j == first:
            if len(w) > 2 and (w.islower() or loud[i] or not cased) and w[0].isalpha() and low[i] not in NOT_A_NAME and low[i] not in TITLES and low[i] not in VERB_OR_NAME and not hit(a, b) and not place(i, i + 1):
                loose.append((low[i], a, b))
            i += 1
            continue
        a, b = toks[i if title else first][0], toks[j - 1][1]
        terms = [low[k] for k in range(first, j) if len(low[k].strip(".")) > 2]
        opens = i == 0 or words[i - 1] in STOPS or "\n" in text[toks[i - 1][1] : a]
        verb = opens and j - first == 1 and low[first] in VERB_OR_NAME and word(j) not in ("here", "ji", ":")
        if terms and not verb and not hit(a, b) and not place(i, j):
            l1, l2, l3 = word(i - 1), word(i - 2), word(i - 3)
            r1, r2 = word(j), word(j + 1)
            introduced = (l2, l1) in INTRODUCES and ((l2, l1) != ("this", "is") or r1 in AFTER_THIS_IS)
            seed = (
                (l1 in RELATION and (l2 in POSSESSIVE or l3 in POSSESSIVE))
                or (l1 == "main" and r1 == "bol")
                or (l1 in SPOKEN_TO and not opens)
                or (l1 == "let" and r1 == "know")
                or r1 in SPEAKS
                or (r1 == "here" and r2 == "," and opens)
                or (r1 == "ke" and r2 == "naam")
                or (l2, l1) in SOUGHT
                or (l1 in ASKS and (l2 == "^" or l2 in STOPS))
                or (l1 == "," and l2 in SIGNS_OFF and j - first > 1)
                or (l1 == "to" and r1 == "please")
                or (r1 == "se" and r2.startswith("mil"))
            )
            edge = "^" if opens else l1
            # the first word of a sentence has its capital anyway, so there it must be no word of the language
            if opens and j - first == 1 and not (title or introduced or seed):
                loose.append((terms[0], a, b))
            runs.append((a, b, 2 if title or introduced else int(seed), terms, [f"l {'^' if opens else l2} {edge}", f"r {r1} {r2}", f"b {edge} {r1}"]))
        i = j
    return runs, loose


def scan(texts: list[str | None]) -> list[tuple[int, str, bool, int, int, list[str], list[str]]]:
    """(turn_no, type, is_seed, start, end, terms, contexts) over the consistent texts of a record. Types besides the
    five: `number` for open digit runs (its digits are the one term), `coded` for numbers of things, `name` for runs that
    may be names, `opening` for single words at the start of a sentence, which count for the statistics and stand among
    the `words` too, and one row of `words` with the other words of a turn and their places, in one text."""
    out = []
    plain = [consistent(t) if t is not None else "" for t in texts]
    split = pieces(plain)
    for k, text in enumerate(plain, 1):
        if not text:
            continue
        taken: list[tuple[int, int]] = []
        for kind, a, b in split.get(k, ()):
            taken.append((a, b))
            out.append((k, kind, False, a, b, [], []))
        free = lambda a, b: all(b <= x or a >= y for x, y in taken)  # noqa: E731, B023
        if MAY_MAIL.search(text):
            for m in EMAIL.finditer(text):
                if free(*m.span()):
                    taken.append(m.span())
                    out.append((k, "email", True, *m.span(), [], []))
        links = [m.span() for m in LINK.finditer(text)] if MAY_LINK.search(text) else []
        digits = readable_digits(text)
        numbered = any(ch.isdigit() for ch in text)
        if numbered and may_address(text):
            for m in ADDRESS.finditer(text):
                if free(*m.span()):
                    taken.append(m.span())
                    out.append((k, "street_address", True, *m.span(), [], []))
        if numbered:
            for span in [m.span() for m in IDS.finditer(text)] + [m.span(1) for m in CUED_ID.finditer(text)]:
                if free(*span):
                    taken.append(span)
                    out.append((k, "id_number", True, *span, [], contexts(text, *span)))
        numbers: list[tuple[int, int]] = []
        for m in NUMBER.finditer(digits):
            a, b = m.span()
            if b - a < 7:
                continue
            while b > a and not (digits[b - 1].isalnum() or digits[b - 1] == "⃣"):
                b -= 1
            value = digits_of(digits[a:b])
            if len(value) < 7 or not free(a, b) or any(x < b and a < y for x, y in links):
                continue
            if digits[max(0, a - 1) : a] == "-" and a > 1 and digits[a - 2].isalnum():
                continue
            numbers.append((a, b))
            run = text[a:b]
            if re.fullmatch(r"(?:19|20)\d\d-\d\d-\d\d", run):
                continue
            coded = bool(re.fullmatch(r"(?:19|20)\d\d[-/]\d{3,}", run)) or bool(CODED.search(text[max(0, a - 6) : a])) and text[a - 1 : a] != "+"
            if EVASIVE.search(run) and len(value) >= 9:
                kind, seed = "phone", True
            elif coded or not 9 <= len(value) <= 15:
                kind, seed = "coded", True
            else:
                kind, seed = "number", False
            out.append((k, kind, seed, a, b, [value] if kind == "number" else [], contexts(text, a, b)))
        runs, loose = words_and_runs(text, taken + links + numbers)
        for a, b, seed, terms, ctx in runs:
            if (terms[0], a, b) in loose:
                out.append((k, "opening", seed > 0, a, b, terms, ctx))
                continue
            out.append((k, "name", seed > 0, a, b, terms, ctx))
            if seed > 1:  # a title or an introduction needs no corpus
                out.append((k, "person_name", True, a, b, [], []))
        if loose:
            out.append((k, "words", False, 0, 0, [" ".join([f"{w}@{a}@{b}" for w, a, b in loose])], []))
    return out


COLUMNS = ["tbl", "rec_no", "turn_no", "kind", "seed", "a", "b", "terms", "ctx"]
SCHEMA = "tbl string, rec_no long, turn_no int, kind string, seed boolean, a int, b int, terms array<string>, ctx array<string>"
LOWER_WORD = re.compile(r"(?<![^\W_])[^\W\d_A-Z]{3,}(?![^\W_])")


def candidates(records: DataFrame) -> DataFrame:
    """Proposals of every record of (tbl, rec_no, texts), and per batch one row of kind `lower` for each word with the
    number of times it stands in small letters (in `a`)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            lower: Counter = Counter()
            for t, r, texts in zip(b["tbl"], b["rec_no"], b["texts"]):
                texts = list(texts) if texts is not None else []
                rows += [(t, r, *c) for c in scan(texts)]
                for text in texts:
                    if text and not text.islower():
                        lower.update(set(LOWER_WORD.findall(text)))
            rows += [(None, None, None, "lower", False, n, 0, [w], []) for w, n in lower.items()]
            yield pd.DataFrame(rows, columns=COLUMNS)

    return spread(records.select("tbl", "rec_no", "texts"), "tbl", "rec_no").mapInPandas(run, SCHEMA)


# ---------------------------------------------------------------- disclosure


def name_terms(cands: DataFrame, disclose: float = 0.35, telling: float = 0.4, met: int = 3) -> DataFrame:
    """(term, small) of terms that disclose a person.

    P0(term): share of its runs that are seeds. A context tells names if it was met `met` times or more and the mean of P0
    over the terms in it is `telling` or more. A term is a name if, on one side or around it, `disclose` of its runs stand
    in telling contexts or are seeds. `small` says whether it is one in small letters too: not if it stands so more than
    twice as often, as words of the language do."""
    runs = cands.filter("kind IN ('name', 'opening')")
    pairs = runs.select("seed", F.explode(F.array_distinct("terms")).alias("term"), "ctx").select("term", "seed", F.explode("ctx").alias("ctx"))
    pairs = cut(pairs.groupBy("term", "ctx").agg(F.count("*").alias("n"), F.sum(F.col("seed").cast("long")).alias("k")))
    side = F.substring("ctx", 1, 1)
    per_term = pairs.filter(side == "l").groupBy("term").agg(F.sum("n").alias("all"), F.sum("k").alias("seeds")).withColumn("p0", F.col("seeds") / F.col("all"))
    per_term = cut(per_term)
    by_context = pairs.join(per_term.select("term", "p0"), "term").groupBy("ctx").agg(F.sum("n").alias("m"), (F.sum(F.col("n") * F.col("p0")) / F.sum("n")).alias("p"))
    worded = F.col("ctx").rlike(r"^..*\p{L}{2}")  # ends and marks alone say nothing
    tells = by_context.filter(worded & (F.col("m") >= met) & (F.col("p") >= telling)).select("ctx", F.lit(True).alias("tells"))
    shown = F.when(F.col("tells"), F.col("n")).otherwise(F.col("k"))
    sides = pairs.join(tells, "ctx", "left").groupBy("term", side.alias("side")).agg(F.sum(shown).alias("shown"))
    best = sides.groupBy("term").agg(F.max("shown").alias("shown"))
    lower = cands.filter("kind = 'lower'").groupBy(F.col("terms")[0].alias("term")).agg(F.sum("a").alias("lower"))
    judged = per_term.join(best, "term").join(lower, "term", "left")
    return judged.filter(F.col("shown") >= disclose * F.col("all")).select("term", (F.coalesce("lower", F.lit(0)) <= 2 * F.col("all")).alias("small"))


def number_kinds(cands: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(tbl, rec_no, turn_no, a, b, kind) of open numbers that their contexts disclose as phone or id_number.

    Each context adds log2 P(context | kind) / P(context | coded), its information on the kind, and so does the length:
    plain identity numbers have twelve digits. Numbers without a known context go by length alone."""
    seeds = cands.filter("seed AND kind IN ('phone', 'id_number', 'coded')").select("kind", F.explode("ctx").alias("f"))
    per = seeds.groupBy("f").agg(*[F.sum((F.col("kind") == k).cast("long")).alias(k) for k in ("phone", "id_number", "coded")])
    size = seeds.agg(F.struct(*[F.sum((F.col("kind") == k).cast("long")).alias(f"{k}_all") for k in ("phone", "id_number", "coded")]))
    share = lambda k: (F.col(k) + 0.2) / (F.coalesce(F.col(f"size.{k}_all"), F.lit(0)) + 2.0)
    info = per.withColumn("size", size.scalar()).select("f", *[F.log2(share(k) / share("coded")).alias(f"i_{k}") for k in ("phone", "id_number")])
    open_ = cands.filter("kind = 'number'").select("tbl", "rec_no", "turn_no", "a", "b", F.length(F.col("terms")[0]).alias("n"), F.explode("ctx").alias("f"))
    score = open_.join(info, "f", "left").groupBy("tbl", "rec_no", "turn_no", "a", "b", "n").agg(
        F.sum(F.coalesce("i_phone", F.lit(0.0))).alias("phone"), F.sum(F.coalesce("i_id_number", F.lit(0.0))).alias("id_number"), F.count("i_phone").alias("known")
    )
    score = score.withColumn("id_number", F.col("id_number") + F.when(F.col("n") == 12, 2.0).otherwise(-6.0))
    by_length = F.when(F.col("n") == 12, "id_number").when(F.col("n") >= 10, "phone")
    kind = (
        F.when(F.col("known") == 0, by_length)
        .when((F.col("phone") > threshold) & (F.col("phone") >= F.col("id_number")), "phone")
        .when(F.col("id_number") > threshold, "id_number")
    )
    return score.select("tbl", "rec_no", "turn_no", "a", "b", kind.alias("kind")).filter("kind IS NOT NULL")


TYPES = ("phone", "email", "id_number", "street_address", "person_name")


def disclosed_spans(records: DataFrame) -> DataFrame:
    """(tbl, rec_no, turn_no, a, b, kind): all spans that exceed their disclosure threshold, on the consistent text."""
    cands = cut(candidates(records))
    fixed = cands.filter(F.col("kind").isin(*TYPES)).select("tbl", "rec_no", "turn_no", "a", "b", "kind")
    runs = cands.filter("kind = 'name'").select("tbl", "rec_no", "turn_no", "a", "b", F.explode(F.array_distinct("terms")).alias("term"), F.lit(False).alias("loose"))
    loose = cands.filter("kind = 'words'").select("tbl", "rec_no", "turn_no", F.explode(F.split(F.col("terms")[0], " ")).alias("x")).withColumn("x", F.split("x", "@"))
    loose = loose.select("tbl", "rec_no", "turn_no", F.col("x")[1].cast("int").alias("a"), F.col("x")[2].cast("int").alias("b"), F.col("x")[0].alias("term"), F.lit(True).alias("loose"))
    # materialised, so that its size is known when the words are joined: a small one is broadcast, a large one is not
    names = cut(name_terms(cands))
    by_term = runs.unionByName(loose).join(names, "term").filter("small OR NOT loose").select("tbl", "rec_no", "turn_no", "a", "b", F.lit("person_name").alias("kind"))
    return fixed.unionByName(number_kinds(cands)).unionByName(by_term)


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The consistent text with each span as [TYPE]; overlapping spans merge into the first one's type."""
    if text is None:
        return None
    t = consistent(text)
    merged: list[list] = []
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if merged and (a < merged[-1][1] or (kind == merged[-1][2] and t[merged[-1][1] : a].isspace())):
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b, kind])
    for a, b, kind in reversed(merged):
        t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
    return t


def redacted_turns(records: DataFrame) -> DataFrame:
    """(tbl, rec_no, turn_no, text) of every turn with its personal information replaced."""
    spans = disclosed_spans(records).groupBy("tbl", "rec_no", "turn_no").agg(F.collect_list(F.struct("a", "b", "kind")).alias("spans"))
    turns = records.select("tbl", "rec_no", F.posexplode("texts").alias("p", "text")).select("tbl", "rec_no", (F.col("p") + 1).alias("turn_no"), "text")

    @F.pandas_udf("string")
    def replace(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([redact(t, [(s["a"], s["b"], s["kind"]) for s in f] if f is not None else []) for t, f in zip(text, found)])

    return turns.join(spans, ["tbl", "rec_no", "turn_no"], "left").select("tbl", "rec_no", "turn_no", replace("text", "spans").alias("text"))
