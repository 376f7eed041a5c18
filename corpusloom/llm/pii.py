"""Personal items in free text: found by a linear-chain conditional random field, replaced by typed placeholders.

Every text is split into tokens from its first character to its last. Each token's features are its shape and its class
in small lexicons, seen from up to two tokens away. The field is trained on the driver from a small labelled table, made
from the sentences below, by gradient ascent on its likelihood. All tokens are scored; where no item can lie on the best
path, whatever its bounds, the label is O by proof, and the rest is decoded by Viterbi in numpy batches: the labels are
those of Viterbi over the whole text. What it finds passes an exact check of form before it counts. The words that a
corpus writes in lower case are counted over all texts of all tables.

Defined cases: null and empty texts hold nothing; an item counts wherever it stands in a text of any length; items
never overlap; text outside the items stays untouched; more than MAX_NAMES given names are an error, none is dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.frames import map_batches, record
from corpusloom.llm.stopwords import stop_words
from corpusloom.runtime import written

KINDS = ("email", "phone", "id_number", "address", "name")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Given names that the model may know; share of the texts, and number of them, that make a lower-case word an ordinary one.
MAX_NAMES, ORDINARY_SHARE, ORDINARY_TEXTS = 100_000, 1 / 2000, 2
REACH = 2  # tokens to either side that a token's label looks at
CHUNK = 200_000  # tokens that are scored at once; a longer text is a chunk of its own

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|\n|[^\w\s]|_")
#: The same with the white space before it, if there is any; a token that has none is glued to the one before.
SPACED = re.compile(rf"[^\S\n]?(?:{TOKEN.pattern})")
#: The lexicons.
LEXICON = {
    "street": "street st road rd avenue ave lane ln drive dr court ct boulevard blvd way terrace close crescent parkway highway row grove mews walk quay hill gardens",
    "strasse": "straße strasse str allee weg gasse platz ring damm ufer rue calle via avenida plaza",
    "unit": "flat unit apt apartment suite house no north south east west n s e w am an der den",
    "id": "ssn passport nino aadhaar national insurance social security id ni personal tax licence license ausweis dni nif identity passnummer soc sec",
    "phone": "tel telephone phone call ring text mobile cell fax dial number",
    "mail": "mail email contact cc write reach send",
    "goods": "order sku serial build isbn page ticket tck score invoice item part covers steps rows session version v batch",
    "digitword": "zero oh one two three four five six seven eight nine double triple",
    "person": "signed ask thanks said wrote owe regards cheers dear met told by as mr mrs ms dr",
    "particle": "van von de da di del la le bin al der ter",
}
WORDS = {w: k for k, ws in LEXICON.items() for w in ws.split()}
STREET_END = re.compile(r".{2,}(?:straße|strasse|str|allee|weg|gasse|platz|ring|damm|ufer)$")
NUMBER_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple)"


LETTERS = re.compile(r"[^\W\d_]+")
LOWER = re.compile(r"(?<![^\W_])[a-zß-öø-ÿāăąćčďđēėęěğīįıłńňőœřśşšťūůűźżž]{2,}(?![^\W_])")
PARTICLES = frozenset(LEXICON["particle"].split())
DIGIT_SET = frozenset(LEXICON["digitword"].split())


class Gate:
    """Which forms a text can hold at all: those whose signs it lacks aren't sought in it. No place of a text is left out."""

    AT = re.compile(r"at ?[\])}]")
    STREET_BEFORE = re.compile(r"(?:strasse|str\.|allee|weg|gasse|platz|ring|damm|ufer) \d")
    WAY_BEFORE = re.compile(r"\b(?:am|an der|rue|calle|via|avenida|plaza) [^\W\d_]+ \d")
    STREETS, WAYS = ("strasse ", "str. ", "allee ", "weg ", "gasse ", "platz ", "ring ", "damm ", "ufer "), ("am ", "an der ", "rue ", "calle ", "via ", "avenida ", "plaza ")
    DIGIT = re.compile(r"\d")

    def __call__(self, text: str, digit_words: int) -> tuple[str, ...]:
        """Names of the alternatives of FORM that need more than a digit, and of the rest; empty if none can fit."""
        low = text.casefold()
        odd = "\u0130" in text or "\u0131" in text  # letters that fold in other ways in patterns
        out = []
        if odd or "@" in low or ("at" in low and ("dot" in low or self.AT.search(low))):
            out.append("mail")
        if self.DIGIT.search(text):
            out.append("digit")
            street = any(x in low for x in self.STREETS) and self.STREET_BEFORE.search(low)
            if odd or street or (any(x in low for x in self.WAYS) and self.WAY_BEFORE.search(low)):
                out.append("strasse")
        if odd or digit_words > 5:
            out.append("spoken")
        return tuple(out)


def gate(names: frozenset) -> Gate:
    """The gate is the same for all names."""
    return Gate()


#: Forms that a token can stand in; the first that fits holds. They are features like any other, not decisions.
FORMS = {
    "mail": r"(?P<mail>[\w.+'-]+ ?(?:@|[\[({] ?at ?[\])}]|\bat\b(?= ?[\w-]+ ?(?:[\[({] ?)?\bdot\b)) ?[\w-]+(?: ?(?:\.(?=\w)|[\[({] ?dot ?[\])}]|\bdot\b) ?[\w-]+)+)",
    "digit": r"(?P<quad>\b\d{1,3}(?:\.\d{1,3}){3}\b)|(?P<day>\b(?:19|20)\d\d[-./]\d{1,2}[-./]\d{1,2})|(?P<ssn>\b\d{3}[- ]\d{2}[- ]\d{4}\b)" "|"
    r"(?P<nino>\b[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b)|(?P<pass>\b[A-Z]{1,2}\d{6,8}\b)|(?P<four>\b\d{4} \d{4} \d{4}\b)|(?P<round>\+\d\d 000 000)" "|"
    r"(?P<phone>(?:\+|\b00)\d{1,3}[\d ()/.-]{6,}\d|\(\d{2,4}\)[ -]?\d{3,4}[ -]\d{3,4}\b|\b(?:1[ -])?\d{3}[-. ]\d{3}[-. ]\d{4}\b|\b0\d{2,4}[ /-]\d{3,8}(?:[ -]\d{3,6})?\b|\+\d{9,13}\b)",
    "spoken": rf"(?P<spoken>(?:\b{NUMBER_WORD}\b[ -]?){{7,}})",
    "street": rf"(?P<street>\b\d{{1,5}}[a-z]?,? (?:(?:north|south|east|west|[nsew])\.? )?(?:[^\W\d_]+ ){{1,2}}(?:{'|'.join(LEXICON['street'].split())})\b\.?)",
    "strasse": r"(?P<strasse>\b(?:[^\W\d_]{3,}(?:straße|strasse|str\.|allee|weg|gasse|platz|ring|damm|ufer)|(?:am|an der|rue|calle|via|avenida|plaza) [^\W\d_]+) \d{1,4}[a-z]?\b)",
}


@lru_cache(16)
def form_pattern(held: tuple[str, ...]) -> re.Pattern:
    """One pattern of the alternatives that a text can hold, in their order."""
    return re.compile("|".join(v for k, v in FORMS.items() if k in held or (k == "street" and "digit" in held)), re.I)


DIGIT_RUN = re.compile(r"\d+|[+(]")


def by_digits(text: str) -> list[re.Match]:
    """The same as finditer of the forms that need digits alone.

    Each begins at a bracket, a plus sign or the first digit of a run, or up to three characters, letters and a space,
    before its first digit.
    """
    fits, out, pos = form_pattern(("digit",)).match, [], 0
    while m := DIGIT_RUN.search(text, pos):
        p = m.start()
        for q in range(max(pos, p - 3), p + 1):
            if (q == p or text[q].isalpha()) and (got := fits(text, q)):
                out.append(got)
                pos = got.end()
                break
        else:
            pos = m.end()
    return out


#: Two capitalized words in a row, maybe with a comma, a hyphen or particles between, in a text's kinds of tokens.
PAIRS = re.compile("[CD](?:l{0,2}[CD])+")


class Kinds(dict):
    """Letters for tokens: capitalized (C, D if a digit word), link between names (l), digit word (d), other (x)."""

    def __init__(self, plain: frozenset):
        self.plain = plain

    def __missing__(self, spaced: str) -> str:
        tok, _ = bare(spaced)
        digit = any(w in DIGIT_SET for w in re.split("['’]", tok.casefold()))
        if tok[0].isupper() and len(tok) > 1 and tok.lower() not in self.plain:
            kind = "D" if digit else "C"
        else:
            kind = "l" if tok in "-,'’" or tok.lower() in PARTICLES else "d" if digit else "x"
        self[spaced] = kind
        return kind


def bare(spaced: str) -> tuple[str, bool]:
    """A token without the white space before it, and whether it is glued."""
    return (spaced[1:], False) if len(spaced) > 1 and spaced[0].isspace() else (spaced, True)


def split(text: str) -> list[str]:
    """Tokens with the white space before them; the first is never glued."""
    toks = SPACED.findall(text)
    if toks and bare(toks[0])[1]:
        toks[0] = " " + toks[0]
    return toks


def bounds(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def forms(text: str, toks: list[str], kinds: Kinds, where: Gate) -> dict[int, str]:
    """The forms that tokens stand in, by their place."""
    out: dict[int, str] = {}
    row = "".join(map(kinds.__getitem__, toks))
    held = where(text, row.count("d") + row.count("D"))
    got = (by_digits(text) if held == ("digit",) else list(form_pattern(held).finditer(text))) if held else ()
    if got:
        begin = [m.start() for m in TOKEN.finditer(text)]
        marked = list(row)
        for m in got:
            first, last = bisect_left(begin, m.start()), bisect_left(begin, m.end())
            for j in range(first, last):
                out[j] = ("i" if j > first else "b") + m.lastgroup
                marked[j] = "x"
        row = "".join(marked)
    for m in PAIRS.finditer(row):
        n = m[0].count("C") + m[0].count("D")
        for j in range(*m.span()):
            out[j] = "ipair" if j > m.start() else f"bpair{min(n, 4)}"
    return out


def shape(tok: str) -> str:
    if tok.isdigit():
        return f"d{min(len(tok), 9)}"
    if tok[0].isalpha():
        if len(tok) == 1:
            return "X" if tok.isupper() else "x"
        return "XX" if tok.isupper() else "Xx" if tok[0].isupper() else "xx"
    return tok


class Tokens:
    """Feature names of tokens by lexicon, names, words that the corpus writes in lower case, and frequent words."""

    def __init__(self, names: frozenset, lower: frozenset, common: frozenset):
        self.names, self.lower = names, lower | common
        self.plain = common | frozenset(w for k in ("person", "phone", "mail", "goods") for w in LEXICON[k].split())
        self.cache: dict[str, tuple[str, ...]] = {}

    def __call__(self, tok: str, glued: bool, form: str) -> tuple[str, ...]:
        key = ("~" if glued else " ") + form + " " + tok
        out = self.cache.get(key)
        if out is None:
            w = tok.lower()
            s = shape(tok)
            kind = WORDS.get(w) or ("strasse" if STREET_END.match(w) else "")
            known = w in self.lower
            name = w in self.names
            out = (f"s={s}|g={glued}", f"k={kind}|{name}|{known and not name}")
            out += (f"f={form}|{known}|{name}|{kind}" if "pair" in form else f"f={form}",)
            if kind in ("person", "id", "goods") or not tok.isalnum():
                out += (f"w={w}",)
            if len(self.cache) < 200_000:
                self.cache[key] = out
        return out


def _fill(r, what: str) -> str:
    pick = lambda *x: x[int(r.integers(len(x)))]
    d = lambda n: "".join(str(int(x)) for x in r.integers(0, 10, n))
    syll = lambda n: "".join(pick("ba", "ko", "ri", "mel", "tan", "sor", "vi", "du", "lek", "pra", "no", "gu", "fe") for _ in range(n))
    family = lambda: syll(int(r.integers(2, 4))).capitalize() + pick("", "", "son", "sen", "ini", "ard", "ova", "ez")
    given = lambda: pick("Anna", "Daniel", "Clara", "Erik", "Rose", "May", "Hope", "Grace", "Mark", "Will", "Tomas", "Yuki", "Arvid", "Selma", "Omar", syll(2).capitalize())
    host = lambda: pick("", "mail.", "hr.") + pick(syll(3), syll(2) + "-works", "example") + pick(".com", ".org", ".net", ".example", ".test")
    if what == "name":
        f = pick(family(), family(), f"van {family()}", f"{family()}-{family()}", f"de {family()}")
        return pick(f"{given()} {f}", f"{given()} {f}", f"{f}, {given()}")
    if what == "email":
        user = pick(f"{syll(3)}", f"{given().lower()}.{syll(3)}", f"{given().lower()}+{syll(2)}", f"{syll(2)}_{d(2)}", f"{syll(3)}-{given().lower()}")
        h = host()
        at = pick("@", "@", "@", " @ ", " [at] ", " (at) ", " at ")
        if at in ("@", " @ "):
            return pick(f"{user}{at}{h}", f"{user}{at}{h}", f"<{user}@{h}>", f"{user.upper()}@{h.upper()}")
        return user + at + (h.replace(".", pick(" [dot] ", " dot ", " (dot) ")) if at == " at " or r.random() < 0.5 else h)
    if what == "phone":
        a, b, c = d(3), d(3), d(4)
        spoken = " ".join(pick("zero", "oh", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine") for _ in range(10))
        return pick(f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+1 ({a}) {b}-{c}", f"001-{a}-{b}-{c}", f"{a}.{b}.{c}", f"+49 30 {d(5)} {a}",
                    f"+49 (0) 30 / {d(5)} {a}", f"0049 30 {d(8)}", f"030/{d(5)}-{a}", f"07700 {d(6)}", f"+44 (0)20 {d(4)} {c}", f"+4477{d(8)}", f"0{d(3)} {d(3)} {d(4)}",
                    f"{a}-{b}-{c} ext. {d(3)}", spoken, f"1 {a} {b} {c}", f"020 {d(4)} {d(4)}", f"{a} {b} {c}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+1{d(10)}", f"+49{d(10)}", f"+4477{d(8)}", f"07700 {d(6)}", f"020 {d(4)} {d(4)}")
    if what == "id_number":
        ssn = pick(f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}")
        nino = pick(f"{pick('QQ', 'AB', 'JK')}{d(6)}{pick(*'ABCD')}", f"{pick('QQ', 'AB')} {d(2)} {d(2)} {d(2)} {pick(*'ABCD')}")
        passp = pick(f"{pick(*'XYCL')}{d(7)}", f"{pick(*'XYCL')}{d(8)}", d(9))
        nat = f"{d(4)} {d(4)} {d(4)}"
        return pick(f"SSN {ssn}", f"SSN: {ssn}", f"social security number {ssn}", ssn, ssn, f"NI number {nino}", f"NINO: {nino}", f"national insurance {nino}", nino, nino,
                    f"passport {passp}", f"Passport {passp}", f"passport no. {passp}", f"passport number: {passp}", f"Aadhaar {nat}", f"national ID {nat}", f"national ID: {nat}", f"ID card no. {nat}", f"soc. sec. no. {ssn}", f"social security {ssn}")
    if what == "address":
        n = str(int(r.integers(1, 2500))) + pick("", "", "", "a", "b")
        town = pick("", "", f", {family()}", f", {family()} {d(5)}", f", {d(5)} {family()}")
        street = f"{pick('', 'North ', 'W. ', '')}{pick('Cobble', 'Quarry', 'Harrow', 'Bramble', 'Museum', 'Ferry', 'Harvest', family())} {pick('Street', 'St.', 'Road', 'Rd', 'Avenue', 'Ave', 'Lane', 'Court', 'Blvd', 'Drive', 'Way', 'Rd.', 'Row', 'Close', 'Terrace')}"
        german = pick(f"{pick('Hafen', 'Linden', 'Mühl', 'Brunnen', 'Garten', 'Kirsch')}{pick('straße', 'str.', 'allee', 'weg', 'platz', 'gasse')} {n}", f"Am {family()} {n}", f"An der {family()} {n}")
        english = pick(f"{pick('', '', 'Unit 3, ', 'Flat 12, ')}{n} {street}", f"{n} {street}, Apt {int(r.integers(1, 40))}{pick('A', 'B', 'C')}")
        return pick(english, german) + town
    if what == "given":
        return given()
    if what == "family":
        return family()
    if what == "num":
        return str(int(r.integers(2, 99)))
    if what == "noun":
        return pick("harvest", "choir", "ferry", "kiln", "museum", "bakery", "weather") + " " + pick("report", "timetable", "repair", "guide", "concert", "parcel", "lesson")
    if what == "firm":
        first, second = pick("Amber", "Northern", "Yellow", "Salt", "Open", "Iron", family()), pick("Kettle", "Orchard", "Bakery", "Bridge", "Studio", "Loom", family())
        return pick(f"{first} {second}", f"{first} {second}", f"{first} {second}", family(), f"{first} & {second}")
    if what == "money":
        return pick("$", "€", "£") + pick(f"{d(2)},{d(3)}", f"{d(2)}k", f"{d(2)}M")
    if what == "code":
        return pick(f"Order {d(4)} {d(4)} {d(4)}", f"SKU {d(3)}-{d(3)}-{d(6)}", f"Serial {d(9)}", f"Serial {d(8)}", f"Ticket {pick('QX', 'LM')}-{d(2)}-{d(5)}", f"build {d(4)}.{d(2)}.{d(3)}", f"ISBN {d(3)}-{d(2)}-{d(2)}",
                    f"{d(5)}-{d(2)}", f"Score {d(3)}-{d(3)}", f"{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"+{d(2)} 000 000 km", f"{d(4)} {d(2)} pages", f"v{d(1)}.{d(1)}", f"20{d(2)}-0{pick(*'123456789')}-1{d(1)}",
                    f"Invoice {d(8)}", f"Order #{d(8)}", f"Part {d(3)}-{d(4)}", f"item {d(7)}", f"{d(3)}.{d(2)}  {d(5)}  {d(4)}  {d(9)}", f"{d(5)}  --  {d(4)}  {d(9)}")
    raise KeyError(what)


#: The labelled table's sentences; a slot in braces is filled anew for every row and labelled if its name is a kind.
SENTENCES = (
    "Telephone {phone} between nine and five.", "Her new mobile is {phone}, she said.", "Tel.: {phone}", "After lunch you reach the front desk on {phone} again.", "Dial {phone} as soon as the boat is in.",
    "{phone} is the line for repairs.", "Fax: {phone}\nKind regards", "Text me under {phone} if the bus is late.", "Questions? Phone {phone} We open at ten.", "The hotline, {phone}, was busy all afternoon.", "Leave a message on {phone} or wait outside.", "call {phone}",
    "E-mail: {email}", "Drop a line to {email} if it rains.", "{email} gets copies of all letters.", "Letters go to {email}, not to the shop.", "Her mailbox is {email}.", "Forward this to {email} today.",
    "contact {email}\nBest wishes", "You find me at {email} most days.", "For the keys mail {email} They answer fast.", "mail {email} first",
    "A copy of {id_number} is attached.", "Please confirm {id_number} before boarding.", "The clerk typed {id_number} twice.", "{id_number} ran out in spring.", "Somebody left {id_number} on the printer.", "My {id_number} should be on record.",
    "Under {id_number} no entry was found.", "He read out {id_number} over the counter.", "{id_number}\nPlease keep it safe.", "Tel.: {phone}\n{id_number} is written below.", "E-mail: {email}\n{id_number} was lost at sea.",
    "Pick the parcel up at {address}.", "They went to {address} in spring.", "Visit: {address}", "Post goes to {address}, please.", "Since May the workshop is at {address} again.", "{address} is where the choir meets.", "Our new place, {address}, has a yard.", "meet me at {address}", "The crate goes to {address} tonight.", "Turn up at {address} around nine.", "Walk over to {address} with the key", "Stop by {address} on the way to the {noun}.", "Bring the {noun} to {address}. It is heavy.", "The {noun} was at {address} for years.", "Somebody took the {noun} to {address}.",
    "With kind regards, {name}", "{name} said no.", "Please ask {name} for the key.", "Yesterday {name} sang.", "Signed, {name}\nPhone {phone}", "Signed, {name} It rained.", "Dear {name}, the boat is late.", "{name} called the office twice.",
    "My neighbour {name} mended the fence.", "This was written by {name} in May.", "{name} wrote back. It was short.", "Many thanks to {name} for the lamp.", "Cheers, {name}", "Signed, {name} Good morning, the boat is late.", "Thank {name}. {name} drew the map.", "As {name} said before, it rained.", "As {name} said, nobody came.", "Signed, {name} Nobody came.", "Signed, {name} Every {noun} was late.", "I gave it to {name}. {name} called back.", "Is it late?\n{name} called back.", "I lent the ladder to {name}.", "I owe the ladder to {name}. It was kind.", "As {name} told us, the {noun} is over.", "The garden of {name} is green.", "Ask {name} for the {noun}. Phone {phone} before.", "Ask {name} how the {noun} went.", "Ask {name}.",
    "Cheers, {given}", "Cheers, {given}\nIt rained.", "{given} said no.", "Please ask {given} for the key.", "Signed, {given} B.", "Ask {given} M.", "Many thanks to {given} D.", "Many thanks to {given} for the lamp.", "As {given} told us, the {noun} is over.", "{given} is a nice word.", "{given} without wind is a dull {noun}.",
    "{given} you, this {noun} is old.", "{given} the {noun} last {num} weeks?", "{given} Flower Show opens the {noun}.", "A {given} Evening closes the {noun}.", "A {given} Lantern needs oil for the {noun}.", "The {given} Market is shut.", "An old {given} Compass shows the {noun}.", "This {given} Parade was short.", "Every {given} Window faces the {noun}.", "A {given} Ladder stood by.",
    "The {noun} was half-baked. It rained.", "My well-worn {noun} looks second-rate.", "One home-made {noun} is worth two.", '{"kettle_{num}":null,"ladder_{num}":true,"choir_{num}":"4c1f9a"}', '[{"parcel_{num}":{num},"lamp_{num}":null}]', "kettle_{num}=null ladder_{num}=true choir.{num}=4c1f9a", "{given} River Walk has {num} Bridge stops.",
    "Station Road sounds {num} times better at night.", "{num} Square Dance evenings made a {noun}.", "The Lane swimmers did {num} rounds.", "Our {num} Highway signs were new.", "Park Avenue shows the {noun} twice.",
    "{firm} opened a {noun} in May, and a second {noun} came after.", "A third of the {noun} was made by {firm}, and the rest by hand.", "We gave the {noun} to {firm} v3.{num} and slept.", "As {firm} told us, the {noun} is over.", "Many thanks to {firm} for the lamp.", "Please ask the {firm} counter for the key.", "By noon the Music Group had seen {firm} again.",
    "The {noun} was {money}, the other {noun} {money} more.", "It took {num} weeks until the {noun} was ready.", "{code} is for the {noun}.", "The {code} stopped the {noun}.", "{code} arrived broken.", "Look for {code} in the register.", "The {noun} has {code}.", "On page {num} the {noun} names {code}.", "{code}\n{code}", "{code} on the {noun} was wrong.", "Date: 20{num}-03-07\nThe {noun} was late.", "Ask {firm} for the {noun}.",
    "Hello @{noun}, see the {noun}.", "Type name@ into the {noun} box.", "Install paint@4.{num}.1 before the {noun}.", "On Sunday every {noun} in town was shut.", "About {num}% of the {noun} was sold.", "What I saw on Sunday: first a {noun}, then a {noun}.", "The Office asked for {money}, the {noun} cost {money}.",
)
TEMPLATE_WORDS = frozenset(w for s in SENTENCES for w in re.findall(r"[^\W\d_]+", re.sub(r"\{\w+\}", " ", s)) if w.islower())


def labelled(copies: int = 5, seed: int = 20, sentences: tuple[str, ...] = SENTENCES) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The labelled table: (text, items as (begin, end, kind)), some in capitals, lower or title case."""
    r = np.random.default_rng(seed)
    out = []
    for sentence in sentences:
        times = copies * 2 if re.search(r"\{(?:phone|id_number|address|email|code|name)\}", sentence) else copies
        for _ in range(times):
            text, items = "", []
            if r.random() < 0.3:
                text = "They built the " + _fill(r, "noun") + " in autumn. "
            for part in re.split(r"(\{\w+\})", sentence):
                if re.fullmatch(r"\{\w+\}", part):
                    what = part[1:-1]
                    value = _fill(r, what)
                    if what in KINDS:
                        items.append((len(text), len(text) + len(value), what))
                    part = value
                text += part
            if r.random() < 0.3:
                text += " The " + _fill(r, "noun") + " took long, so some went home."
            change = r.random()
            cased = text.upper() if change < 0.05 else text.lower() if change < 0.1 else text
            out.append((cased if len(cased) == len(text) else text, items))
    return out


ALLOWED = np.array([[not (b.startswith("I-") and (a == "O" or a[2:] != b[2:])) for b in LABELS] for a in LABELS])
NEVER = -1e4


class Known(dict):
    """Rows of the field's table by token and form; a token without form by itself."""

    def __init__(self, field: "Field"):
        self.field = field

    def __missing__(self, key: str | tuple[str, str]) -> int:
        spaced, form = (key, "") if isinstance(key, str) else key
        i = self[key] = self.field.row(*bare(spaced), form)
        return i


class Field:
    """Weights of features by distance and label, and of label pairs."""

    MOST = 200_000  # rows of the table before it starts anew

    def __init__(self, tokens: Tokens, index: dict[str, int], weights: np.ndarray, pairs: np.ndarray):
        self.tokens, self.index, self.weights, self.pairs = tokens, index, weights, pairs
        self.kinds, self.known = Kinds(tokens.plain), Known(self)
        self.table, self.rows = np.zeros((2 * REACH + 1, 4096, len(LABELS)), np.float32), 1
        # what transitions can add to an item of each kind over O in its place: at its ends, and between its tokens
        t, labels = pairs.astype(np.float64), range(len(KINDS))
        out = [0, *(1 + 2 * k for k in labels)]
        enter = np.array([max(0.0, (t[:, 1 + 2 * k] - t[:, 0]).max()) for k in labels])
        leave = np.array([max(0.0, max((t[x, out] - t[0, out]).max() for x in (1 + 2 * k, 2 + 2 * k))) for k in labels])
        self.step = np.array([max(t[1 + 2 * k, 2 + 2 * k], t[2 + 2 * k, 2 + 2 * k]) - t[0, 0] for k in labels])
        self.ends = enter + leave - self.step

    def row(self, tok: str, glued: bool, form: str) -> int:
        i = self.rows
        if i >= self.table.shape[1]:
            self.table = np.concatenate((self.table, np.zeros_like(self.table)), axis=1)
        at = [self.index[f] for f in self.tokens(tok, glued, form) if f in self.index]
        self.table[:, i] = self.weights[at].sum(0) if at else 0
        self.rows += 1
        return i

    def ids(self, text: str, where: Gate) -> list[int]:
        """Rows of the table for the tokens of a text."""
        toks = split(text)
        out = list(map(self.known.__getitem__, toks))
        for j, form in forms(text, toks, self.kinds, where).items():
            out[j] = self.known[toks[j], form]
        return out

    def labels(self, texts: list, where: Gate):
        """(place of a text, place of a token, label) of all tokens of all texts whose label isn't O, as arrays, text by text."""
        part, n = [], 0
        for i, t in enumerate(texts):
            if t:
                if not part and self.rows > self.MOST:
                    self.known.clear()
                    self.kinds.clear()
                    self.rows = 1
                x = self.ids(t, where)
                part.append((i, x))
                n += len(x)
                if n > CHUNK:
                    yield self.decode(part)
                    part, n = [], 0
        if n:
            yield self.decode(part)

    def decode(self, part: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The labels of the best paths of some texts, given by the rows of their tokens."""
        size = np.array([len(x) for _, x in part])
        start = np.cumsum(size + REACH) - size  # rows of zeros before, between and after the texts
        ids = np.zeros(int(start[-1] + size[-1]) + REACH, np.int64)
        live = np.zeros(len(ids), bool)
        for a, (_, x) in zip(start.tolist(), part):
            ids[a : a + len(x)] = x
            live[a : a + len(x)] = True
        e = np.zeros((len(ids), len(LABELS)), np.float32)
        for o in range(2 * REACH + 1):
            e[REACH:-REACH] += self.table[o].take(ids[o : o + len(ids) - 2 * REACH], axis=0)
        open_ = live & self.possible(e, live)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], open_, [False]))))
        begin, end = edge[::2], edge[1::2]
        label = np.zeros(len(ids), np.int8)
        order = np.argsort(end - begin, kind="stable")
        a = 0
        while a < len(order):
            b = min(len(order), a + 512)
            while b - a > 1 and (b - a) * int((end - begin)[order[b - 1]]) > CHUNK:
                b = (a + b) // 2
            self._viterbi(e, live, begin[order[a:b]], end[order[a:b]], label)
            a = b
        at = np.flatnonzero(label)
        text = np.searchsorted(start, at, "right") - 1
        return np.array([i for i, _ in part])[text], at - start[text], label[at]

    def possible(self, e: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Where an item can lie on the best path.

        An item is on it only if it adds at least what O in its place would. Over all items of a kind that contain a
        token, what one adds is at most the largest sum of neighbours' advantages around the token, plus the ends.
        """
        out = np.zeros(len(e), bool)
        for k in range(len(KINDS)):
            gain = np.maximum(e[:, 1 + 2 * k], e[:, 2 + 2 * k]).astype(np.float64) - e[:, 0] + self.step[k]
            gain[~live] = -1e4
            total = np.concatenate(([0.0], np.cumsum(gain)))
            left = total[1:] - np.minimum.accumulate(total)[:-1]
            right = np.maximum.accumulate(total[::-1])[::-1][1:] - total[:-1]
            out |= left + right - gain + self.ends[k] > -1e-3
        return out

    def _viterbi(self, e: np.ndarray, live: np.ndarray, begin: np.ndarray, end: np.ndarray, label: np.ndarray) -> None:
        """Write the best labels of runs of like length, given that the tokens beside a run have label O, if there are any."""
        n, size = len(begin), end - begin
        longest = int(size.max())
        first = np.where(live[begin - 1][:, None], self.pairs[0], np.where(ALLOWED[0], 0, NEVER).astype(np.float32))
        after = np.where(live[end][:, None], self.pairs[:, 0], np.float32(0))
        scores = np.empty((longest, n, len(LABELS)), np.float32)
        scores[0] = e[begin] + first
        step = self.pairs[:, None, :]
        for t in range(1, longest):
            new = (scores[t - 1].T[:, :, None] + step).max(0) + e[np.minimum(begin + t, len(e) - 1)]
            scores[t] = np.where((t < size)[:, None], new, scores[t - 1])
        best = (scores[-1] + after).argmax(1)
        into = self.pairs.T
        for t in range(longest - 1, -1, -1):
            inside = t < size
            label[(begin + t)[inside]] = best[inside]
            if t:
                best = np.where(inside, (scores[t - 1] + into[best]).argmax(1), best)


def train(names: frozenset, lower: frozenset, common: frozenset, table=None, rounds: int = 60, decay: float = 0.15) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam; every quantity is exact, by forward and backward sums.

    In the labelled table its own lower-case words count as ordinary ones, whatever the corpus writes.
    """
    table = table or labelled()
    sample_names = frozenset(names | {"anna", "daniel", "clara", "erik", "rose", "may", "hope", "grace", "mark", "will"})
    own = TEMPLATE_WORDS | frozenset("harvest choir ferry kiln museum bakery weather report timetable repair guide concert parcel lesson".split())
    tokens = Tokens(sample_names, lower | own, common)
    index: dict[str, int] = {}
    seqs = []
    kinds, where = Kinds(tokens.plain), Gate()
    for text, items in table:
        toks, at = split(text), bounds(text)
        y = np.zeros(len(toks), int)
        for b, e, kind in items:
            inside = [i for i in range(len(toks)) if at[i][0] >= b and at[i][1] <= e]
            for n, i in enumerate(inside):
                y[i] = LABELS.index(("I-" if n else "B-") + kind)
        form = forms(text, toks, kinds, where)
        feats = [[index.setdefault(f, len(index)) for f in tokens(*bare(x), form.get(i, ""))] for i, x in enumerate(toks)]
        seqs.append((feats, y))
    n, longest, width, k = len(seqs), max(len(y) for _, y in seqs), 4, len(LABELS)
    none = len(index)
    grid = np.full((n, longest + 2 * REACH, width), none)
    y = np.zeros((n, longest), int)
    size = np.array([len(y_) for _, y_ in seqs])
    for i, (f, yy) in enumerate(seqs):
        for t, x in enumerate(f):
            grid[i, REACH + t, : len(x)] = x
        y[i, : len(yy)] = yy
    live = np.arange(longest) < size[:, None]
    offs = 2 * REACH + 1
    w, pairs = np.zeros((none + 1, offs, k)), np.where(ALLOWED, 0.0, NEVER)
    gold = np.zeros((n, longest, k))
    gold[np.arange(n)[:, None], np.arange(longest), y] = 1
    gold *= live[:, :, None]
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (y[:, :-1][live[:, 1:]], y[:, 1:][live[:, 1:]]), 1)
    m1, m2, q1, q2 = np.zeros_like(w), np.zeros_like(w), np.zeros((k, k)), np.zeros((k, k))
    # for each distance, the places of each feature side by side, so that gradients are sums of neighbours
    plans = []
    seen = [grid[:, o : o + longest][live] for o in range(offs)]  # without the padding
    for o in range(offs):
        flat = seen[o].reshape(-1)
        order = np.argsort(flat, kind="stable")
        order = order[flat[order] != none]
        heads = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1])))
        plans.append((order // width, heads, flat[order][heads]))
    first = np.where(ALLOWED[0], 1.0, 0.0)
    for it in range(1, rounds + 1):
        e = np.zeros((n, longest, k))
        for o in range(offs):
            e[live] += w[:, o][seen[o]].sum(1)
        x = np.exp(e - e.max(2, keepdims=True)) * live[:, :, None] + (~live)[:, :, None]
        trans = np.exp(pairs) * ALLOWED
        alpha, beta, scale = np.zeros_like(x), np.ones_like(x), np.ones((n, longest))
        alpha[:, 0] = x[:, 0] * first
        for t in range(longest):
            if t:
                alpha[:, t] = np.where(live[:, [t]], (alpha[:, t - 1] @ trans) * x[:, t], alpha[:, t - 1])
            scale[:, t] = alpha[:, t].sum(1)
            alpha[:, t] /= scale[:, [t]]
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(live[:, [t + 1]], (x[:, t + 1] * beta[:, t + 1]) @ trans.T, beta[:, t + 1])
            beta[:, t] /= beta[:, t].sum(1, keepdims=True)
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        diff = (gold - post)[live]
        g = -decay * w
        for o, (where, heads, feats) in enumerate(plans):
            g[feats, o] += np.add.reduceat(diff[where], heads)
        g[none] = 0
        joint = np.zeros((k, k))
        for t in range(1, longest):
            m = live[:, t]
            part = alpha[m, t - 1][:, :, None] * trans * (x[m, t] * beta[m, t])[:, None, :]
            joint += (part / part.sum((1, 2), keepdims=True)).sum(0)
        gp = np.where(ALLOWED, gold_pairs - joint - decay * np.where(ALLOWED, pairs, 0), 0)
        rate = 0.12 if it < rounds * 0.7 else 0.04
        for value, grad, one, two in ((w, g, m1, m2), (pairs, gp, q1, q2)):
            one += 0.1 * (grad - one)
            two += 0.01 * (grad * grad - two)
            value += rate * (one / (1 - 0.9**it)) / (np.sqrt(two / (1 - 0.99**it)) + 1e-8)
    tokens = Tokens(sample_names, lower, common)
    return Field(tokens, index, w[:none].astype(np.float32), np.where(ALLOWED, pairs, NEVER).astype(np.float32))


DIGIT_WORDS = re.compile(rf"\b{NUMBER_WORD}\b", re.I)
EMAIL = re.compile(r"[\w.+'-]+\s*(?:@|[\[({]\s*(?:at|@)\s*[\])}]|\bat\b)\s*[\w-]+(?:\s*(?:\.|[\[({]\s*dot\s*[\])}]|\bdot\b)\s*[\w-]+)+", re.I)
SHAPES = re.compile(
    r"\b\d{3}[- ]\d{2}[- ]\d{4}\b|\b[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b|\b[A-Z]{1,2}\d{6,8}\b|\b\d{4}[ -]\d{4}[ -]\d{4}\b|\b\d{9,11}\b|\b\d{8}[A-Z]\b", re.I
)
STREET = re.compile(
    rf"\b(?:{'|'.join(LEXICON['street'].split())})\b|(?:straße|strasse|str\.?|allee|weg|gasse|platz|ring|damm|ufer)\s*,?\s*\d|\b(?:am|an der|rue|calle|via|avenida|plaza)\b", re.I
)
NOT_PHONE = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}$|(?:19|20)\d\d[-./]\d{1,2}[-./]\d{1,2}|.*\b000 000\b")


GOODS = re.compile(rf"(?:^|\b)(?:{'|'.join(LEXICON['goods'].split())})\b[\W_]*(?:no\b\W*)?$", re.I)
HOUSE = re.compile(
    rf"\d+\s?[a-z]?,?\s+(?:[\w'’-]+\.?\s+){{1,3}}(?:{'|'.join(LEXICON['street'].split())})\b|(?:straße|strasse|str\.?|allee|weg|gasse|platz|ring|damm|ufer)\s*,?\s*\d|"
    r"\b(?:am|an der|rue|calle|via|avenida|plaza)\s+[\w' ]+?,?\s+\d",
    re.I,
)


NAME = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*(?:(?:,[^\S\n]*|[^\S\n]+)[^\W\d_]+(?:[-'’][^\W\d_]+)*){1,5}")


def passes(kind: str, item: str, before: str) -> bool:
    """Whether an item has the form of its kind; before is what stands in front of it."""
    if kind == "email":
        return EMAIL.search(item) is not None and not re.search(r"@\s*\d[\d.]*$", item)
    if kind == "address":
        return HOUSE.search(item) is not None
    if kind == "name":
        words = [w for w in LETTERS.findall(item) if w.lower() not in PARTICLES]
        return NAME.fullmatch(item) is not None and sum(len(w) > 1 for w in words) >= 2
    head = re.match(r"[^\d+(]*", item)[0]
    if GOODS.search(before + head if kind == "phone" else before) or GOODS.search(head):
        return False
    if kind == "phone":
        n = sum(c.isdigit() for c in item)
        if re.search(r"[\d,.$€£%]$", before) or (re.search(r"\d\s{2,}\d|\t", item) and not re.match(r"\W*[+(]", item)):
            return False
        return not NOT_PHONE.match(item[len(head) :]) and (7 <= n <= 18 or n + len(DIGIT_WORDS.findall(item)) >= 7)
    return SHAPES.search(item) is not None


def items_in(field: Field, where: Gate, texts: list) -> list[list[tuple[int, int, str]]]:
    """(begin, end, kind) of the items of each text; every token of every text is looked at."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for of, at, labels in field.labels(texts, where):
        if not len(at):
            continue
        kind_of = (labels - 1) // 2
        heads = np.flatnonzero((labels % 2 == 1) | np.concatenate(([True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1) | (kind_of[1:] != kind_of[:-1]))))
        last, spans = -1, []
        for i, first, final, label in zip(of[heads].tolist(), at[heads].tolist(), at[np.append(heads[1:], len(at)) - 1].tolist(), labels[heads].tolist()):
            if i != last:
                last, spans = i, bounds(texts[i])
            b, e, kind = spans[first][0], spans[final][1], LABELS[label][2:]
            if passes(kind, texts[i][b:e], texts[i][max(0, b - 40) : b]):
                out[i].append((b, e, kind))
    return out


def ordinary_words(texts: list[DataFrame]) -> frozenset:
    """Words that the texts, given as tables of one column, write in lower case: in at least ORDINARY_SHARE of them.

    All texts are counted, copies within a task once. As each word takes a share of the texts, there are at most
    1 / ORDINARY_SHARE times as many words as a text has on average, whatever the number of texts.
    """

    def make():
        seen: set[int] = set()

        def f(b: pa.RecordBatch):
            counts: dict[str, int] = {}
            n = 0
            for t in b.column(0).to_pylist():
                if not t or (h := hash(t)) in seen:
                    continue
                seen.add(h)
                n += 1
                for w in set(LOWER.findall(t)):
                    counts[w] = counts.get(w, 0) + 1
            return record(word=pa.array([None, *counts], pa.string()), n=pa.array([n, *counts.values()], pa.int64()))

        return f

    parts = None
    for t in texts:
        one = map_batches(t, make, "word string, n bigint")
        parts = one if parts is None else parts.unionByName(one)
    counted = written(parts.groupBy("word").agg(F.sum("n").alias("n")), "lower-words")
    total = counted.where("word is null").agg(F.sum("n")).head()[0] or 0
    rows = counted.where(F.col("word").isNotNull() & (F.col("n") >= max(ORDINARY_TEXTS, ORDINARY_SHARE * total)))
    return frozenset(r[0] for r in rows.select("word").collect())


def fit(names: DataFrame, texts: list[DataFrame]) -> tuple[Field, Gate]:
    """Train with the given names of names(given_name) and the ordinary words of texts, tables of one text column."""
    rows = names.select(F.lower(F.trim("given_name")).alias("n")).where("n <> ''").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} given names")
    given = frozenset(r[0] for r in rows)
    return train(given, ordinary_words(texts), stop_words()), gate(given)


def found(df: DataFrame, key: str, text: str, model: tuple[Field, Gate]) -> DataFrame:
    """(key, kind, begin, end) of every item."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind_of = dict(df.dtypes)[key]

    def make():
        field, where = sent.value

        def f(b: pa.RecordBatch):
            keys, got = b.column(0), items_in(field, where, b.column(1).to_pylist())
            at = [i for i, x in enumerate(got) for _ in x]
            flat = [y for x in got for y in x]
            return record(**{
                key: keys.take(pa.array(at, pa.int64())), "kind": pa.array([x[2] for x in flat], pa.string()),
                "begin": pa.array([x[0] for x in flat], pa.int32()), "end": pa.array([x[1] for x in flat], pa.int32()),
            })

        return f

    return map_batches(df.select(key, text), make, f"`{key}` {kind_of}, kind string, begin int, end int")


def redacted(df: DataFrame, key: str, text: str, model: tuple[Field, Gate]) -> DataFrame:
    """(key, text, items): each text with placeholders in place of its items, and how many there were."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind_of = dict(df.dtypes)[key]

    def make():
        field, where = sent.value

        def f(b: pa.RecordBatch):
            texts = b.column(1).to_pylist()
            got = items_in(field, where, texts)
            out = []
            for t, spans in zip(texts, got):
                for x, y, kind in sorted(spans, reverse=True):
                    t = t[:x] + PLACEHOLDER[kind] + t[y:]
                out.append(t)
            return record(**{key: b.column(0), text: pa.array(out, pa.string()), "items": pa.array([len(x) for x in got], pa.int32())})

        return f

    return map_batches(df.select(key, text), make, f"`{key}` {kind_of}, `{text}` string, items int")
