"""Operators that rewrite text. What built-in functions can't say runs as plain functions of one text in Arrow batches."""

from __future__ import annotations

import html
import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

HAS_MARKUP = r"</?[a-zA-Z][^>]*>|<style"
BLOCKS = frozenset("address article aside blockquote dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
WORD = re.compile(r"[A-Za-z0-9]+(?:['’][A-Za-z0-9]+)?")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
QUOTES = "\"“”"


class _Blocks(HTMLParser):
    """Text with breaks between blocks; style is dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "style":
            self.skip += 1
        elif tag == "br":
            self.out.append("\n")
        elif tag in BLOCKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag == "style":
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCKS:
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data.strip())


class _Chunks(HTMLParser):
    """Stripped chunks of text, one a line; script and style stay in, as ingest keeps them."""

    CDATA_CONTENT_ELEMENTS = ()

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out = []

    def handle_data(self, data):
        if data.strip():
            self.out.append(data.strip())


def normalize_text(text: str | None) -> str:
    """Line ends, style rules and tags gone, quotes around lines unwrapped, blank runs made one."""
    t = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    if re.search(HAS_MARKUP, t):
        t = re.sub(r"(?is)<style\b.*?</style\s*>", "", t)
        before = None
        while before != t:  # rules may hold rules
            before = t
            t = re.sub(r"[^{}<>\n]*\{[^{}]*\}", "", t)
        p = _Blocks()
        p.feed(t)
        p.close()
        t = "".join(p.out)
    t = t.replace('\\"', '"')
    out: list[str] = []
    for line in t.split("\n"):
        s = line.strip()
        s = s[1:] if s[:1] and s[0] in QUOTES else s
        s = (s[:-1] if s[-1:] and s[-1] in QUOTES else s).strip()
        if set(s) <= set(QUOTES):
            s = ""
        if s or (out and out[-1]):
            out.append(s)
    return "\n".join(out).strip()


def html_lines(text: str | None) -> str:
    p = _Chunks()
    try:
        p.feed(text or "")
        p.close()
        return "\n".join(p.out)
    except Exception:
        return html.unescape(re.sub(r"<[^>]+>", " ", text or "")).strip()


BLANKS = r"[\t\x0b\f\x1c-\x1f\x{85}\p{Z}]"
#: Sentences and phrases that go, the plain words that replace showy ones, and repairs of white space, in this order.
TELLS = (
    (r"(?is)\b(?:moreover|furthermore|additionally)[, ]+[^.?!]{0,120}?(?:testament to(?:\s+vibrant)?|unlock(?:ing)?\s+nestled|leverage(?:\s+robust)?\s+synergies)[^.?!]*[.?!]\s*", ""),
    (r"(?is)\bunlock(?:ing)?\s+nestled\s+opportunities\s+is\s+a\s+testament\s+to\s+vibrant\s+\w+[^.?!]*[.?!]\s*", ""),
    (r"(?i)\bIn today's (?:fast-paced\s+)?(?:digital\s+)?(?:fast-paced\s+)?(?:digital\s+)?(?:world|landscape),?\s*", ""),
    (r"(?i)\bIt is important to note that\s*", ""), (r"(?i)\bMoreover,\s*furthermore,?\s*", ""), (r"(?i)\bMoreover,\s*", ""), (r"(?i)\bFurthermore,\s*", ""),
    (r"(?i)\bAdditionally,\s*", ""), (r"(?i)\bleverage(?:\s+robust)?\s+synergies\b", "make real connections"),
    (r"(?i)\bunlock(?:ing)?\s+nestled\s+opportunities\b", "find real opportunities"), (r"(?i)\ba testament to\s+vibrant\s+\w+\b", ""),
    (r"(?i)\ba testament to\s+", ""), (r"(?i)\bdelve into\b", "talk about"), (r"(?i)\butilize\b", "use"), (r"(?i)\bleverage\b", "use"), (r"(?i)\brobust\b", "real"),
    (r"(?i)\bsynergies\b", "connections"), (r"(?i)\bsynergias\b", "connections"), (r"(?i)\bunlock(?:ing)?\b", "find"), (r"(?i)\bnestled\b", ""), (r"(?i)\bvibrant\b", ""),
    (r"(?i)\bis\s+(?:innovation|excellence)\b", ""), (r"(?i)\bfind real opportunities\s+is\b", "find real opportunities"),
    (BLANKS + "{2,}", " "), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (T.WS + r"+([,.])", "$1"),
)


def first_raised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def strip_tells(c: Column) -> Column:
    """Natively: sentences and clauses out, words swapped, white space repaired, first letter raised; line breaks stay."""
    c = T.body(c)
    for p, r in TELLS:
        c = F.regexp_replace(c, p, r)
    return first_raised(T.trim_all(F.regexp_replace(c, r"^[ \t,;]+|[ \t,;]+$", "")))


def tokens(text: str) -> list[str]:
    return [w.lower().replace("’", "'") for w in WORD.findall(text or "")]


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def paragraphs(text: str) -> list[str]:
    return [p.strip() for p in re.split(r"\n\s*\n", text or "") if p.strip()]


def drop_repeats(text: str, ratio: float = 0.8) -> str:
    """Paragraphs whose words are like those of one kept before go."""
    kept: list[tuple[str, set]] = []
    for p in paragraphs(text):
        w = set(tokens(p))
        if w and not any(jaccard(w, x) >= ratio for _, x in kept):
            kept.append((p, w))
    return "\n\n".join(p for p, _ in kept)


def drop_restated(sections: list[str], like: float = 0.55, within: float = 0.62) -> list[str]:
    """Sections like one kept before, or mostly made of words of all kept before, go."""
    kept: list[tuple[str, set]] = []
    for s in sections:
        w = set(tokens(s))
        known = set().union(*(x for _, x in kept)) if kept else set()
        if w and not any(jaccard(w, x) >= like for _, x in kept) and not (kept and len(w & known) / len(w) >= within):
            kept.append((s.strip(), w))
    return [s for s, _ in kept]


def trim_words(text: str, most: int) -> str:
    """Whole paragraphs while they fit; the first always stays."""
    out, n = [], 0
    for p in paragraphs(text):
        k = len(tokens(p))
        if out and most > 0 and n + k > most:
            break
        out.append(p)
        n += k
    return "\n\n".join(out)


def windows(text: str, most: int = 320) -> list[str]:
    """Pieces of at most so many characters by paragraph, then sentence, then hard cut."""
    out: list[str] = []
    for p in paragraphs(text):
        line = ""
        for s in re.split(r"(?<=[.!?])\s+", p):
            while len(s) > most:
                if line:
                    out.append(line)
                    line = ""
                at = s.rfind(" ", 0, most + 1)
                at = at if at > most // 3 else most
                out.append(s[:at].strip())
                s = s[at:].strip()
            if line and len(line) + 1 + len(s) > most:
                out.append(line)
                line = s
            else:
                line = f"{line} {s}".strip()
        if line:
            out.append(line)
    return out


#: Expansions, second person made third, and words that notes leave out.
EXPAND = {
    "i'm": "I am", "i've": "I have", "i'd": "I would", "i'll": "I will", "you're": "they are", "you've": "they have", "you'll": "they will", "we're": "we are", "we've": "we have",
    "we'll": "we will", "they're": "they are", "it's": "it is", "that's": "that is", "what's": "what is", "there's": "there is", "here's": "here is", "isn't": "is not",
    "aren't": "are not", "wasn't": "was not", "weren't": "were not", "don't": "do not", "doesn't": "does not", "didn't": "did not", "can't": "cannot", "couldn't": "could not",
    "won't": "will not", "wouldn't": "would not", "shouldn't": "should not", "haven't": "have not", "hasn't": "has not", "hadn't": "had not",
    "you": "they", "your": "their", "yours": "theirs", "yourself": "themselves",
}
NOTE_OUT = frozenset("a an the very really just so well actually basically honestly simply quite".split())
LEAD_OUT = frozenset("and but so or because still yet however meanwhile anyway".split())
CAPITAL = re.compile(r"[A-Z][A-Za-z0-9&'-]+")
FIGURE = re.compile(r"\d")


def weight(sentence: str) -> int:
    """Facts in a sentence: inner capitals count two, figures three."""
    w = sentence.split()
    return sum(2 for x in w[1:] if CAPITAL.match(x)) + sum(3 for x in w if FIGURE.search(x))


def devoiced(text: str, floor: float = 0.55, clause_words: int = 16) -> list[str]:
    """Notes of a text in clauses: links, tags and marks out, cheap short sentences out down to the floor, second person made third."""
    t = re.sub(r"https?://\S+|[#@]\w+|[•▪●✅🚀🙏✨]|(?m:^\s*[-*]\s+)", "", normalize_text(text))
    s = [x.strip() for x in SENTENCE.split(t) if x.strip()]
    size = [len(tokens(x)) for x in s]
    left, least = sum(size), floor * sum(size)
    gone = set()
    for i in sorted(range(len(s)), key=lambda i: (weight(s[i]), size[i], i)):
        # one that costs too much is passed over, later ones are still tried
        if size[i] <= 6 and weight(s[i]) == 0 and left - size[i] >= least:
            gone.add(i)
            left -= size[i]
    out: list[str] = []
    for i, x in enumerate(s):
        if i in gone:
            continue
        x = re.sub(r"[A-Za-z]+(?:['’][A-Za-z]+)*", lambda m: EXPAND.get(m[0].lower().replace("’", "'"), m[0]), x)
        w = x.rstrip(".!?…").split()
        while w and w[0].lower().strip(",") in LEAD_OUT:
            w = w[1:]
        w = [y for y in w if y.lower().strip(",;:") not in NOTE_OUT]
        if not w:
            continue
        note = " ".join(w)
        if out and len(out[-1].split()) < clause_words:
            out[-1] += "; " + note
        else:
            out.append(note)
    return out


def overlap(brief: str, source: str) -> float:
    """Words of the brief, with multiplicity, over words of the source."""
    b, s = Counter(tokens(brief)), Counter(tokens(source))
    return sum(min(n, s[w]) for w, n in b.items()) / max(1, sum(s.values()))


#: Words that end no phrase.
DANGLING = frozenset("a an the and or but of to in on at by for from with as is was were are be than that which who when where if not no so".split())


def fit_phrase(sentence: str, most: int) -> str:
    w = sentence.rstrip(".!?…;:,").split()[:most]
    while w and (w[-1].lower().strip(",;") in DANGLING or w[-1].isdigit()):
        w.pop()
    return " ".join(w).rstrip(",;:")


def mined_brief(text: str, kind: str) -> dict:
    """A lossy brief: topic and bullets of the sentences with most facts, in document order; errors as data."""
    source = normalize_text(text)
    s = [x.strip() for x in SENTENCE.split(source) if x.strip()]
    total = len(tokens(source))
    least, budget, cap, most = (32, min(40, total // 4), 0.25, 3) if kind == "post" else (200, min(60, total // 10), 0.10, 6)
    fail = lambda why: {"ok": False, "reason": why, "topic": "", "points": [], "overlap": 0.0}
    if total < least:
        return fail(f"{kind}_too_short")
    if len(s) < 3:
        return fail("too_few_sentences")
    if kind == "post":
        pick = sorted(sorted(range(1, len(s)), key=lambda i: (-weight(s[i]), i))[:most])
    else:
        k = min(most, max(3, len(s) // 4))
        pick = [max(range(i * len(s) // k, max((i + 1) * len(s) // k, i * len(s) // k + 1)), key=lambda j: (weight(s[j]), -j)) for i in range(k)]
    topic = fit_phrase(s[0], 10)
    points, used = [], len(tokens(topic))
    each = max(4, min(12, (budget - used) // max(1, len(pick)))) if budget > used else 4
    for i in pick:
        p = fit_phrase(s[i], each)
        if p and p != topic and used + len(tokens(p)) <= budget:
            points.append(p)
            used += len(tokens(p))
    if len(points) < (2 if kind == "post" else 3):
        return fail("unbriefable")
    share = overlap(" ".join([topic, *points]), source)
    if share > cap:
        return fail("brief_too_close")
    return {"ok": True, "reason": "kept", "topic": topic, "points": ["- " + p for p in points], "overlap": round(share, 4)}


def masked(text: str, keep: frozenset = frozenset()) -> str:
    """Names cut out with their possessives, then tidied."""
    from corpusloom.operators.guards import ENTITY, PLAIN_CAPS

    def cut(m):
        key = re.sub(r"\s+", " ", m[0]).lower()
        words = key.split(" ")
        return m[0] if key in keep or all(w in PLAIN_CAPS for w in words) else ""

    t = re.sub("(?:" + ENTITY + ")(?:['’]s\\b)?", lambda m: cut(m), text or "")
    return tidied(t)


#: Repairs of a text from which names or sentences were cut, in this order.
TIDY = (
    (r"[ \t]{2,}", " "), (r"[ \t]+([,.;:!?%)\]])", r"\1"), (r"([(\[#@])[ \t]+", r"\1"), (r"\(\s*\)|\[\s*\]", ""), (r"(?m)^[ \t]+|[ \t]+$", ""),
    (r"(?m)^[#@][#@ \t]*$\n?", ""), (r"(?m)^[-—–:,.!?][-—–:,.!? \t]*$\n?", ""), (r"\n{3,}", "\n\n"),
)


def tidy(c: Column) -> Column:
    """tidied() natively."""
    for p, r in TIDY:
        c = F.regexp_replace(c, p.replace("(?m)", "(?md)"), r.replace("\\1", "$1"))
    return T.trim_all(c)


def tidied(t: str) -> str:
    for p, r in TIDY:
        t = re.sub(p, r, t)
    return t.strip()


def source_sections(text: str, seq: int = 1024) -> list[str]:
    """A lossless cut into sections of at most max(320, 0.9 seq) characters."""
    return windows(text, max(320, int(0.9 * seq)))


def by_text(f, kind: str):
    """A function of one text as an Arrow-batched column function."""
    return F.pandas_udf(lambda s: pd.Series([f(x) for x in s], dtype=object), kind)


BRIEF = "struct<ok:boolean,reason:string,topic:string,points:array<string>,overlap:double>"


def post_brief(c: Column) -> Column:
    return F.pandas_udf(lambda s: pd.DataFrame([mined_brief(x, "post") for x in s], columns=["ok", "reason", "topic", "points", "overlap"]), BRIEF)(c)


def article_brief(c: Column) -> Column:
    return F.pandas_udf(lambda s: pd.DataFrame([mined_brief(x, "article") for x in s], columns=["ok", "reason", "topic", "points", "overlap"]), BRIEF)(c)


def plain_normalized(c: Column) -> Column:
    """normalize_text without its branch for markup, natively."""
    t = F.replace(F.regexp_replace(T.body(c), "\r\n|\r", "\n"), F.lit('\\"'), F.lit('"'))
    strip = lambda s: T.trim_all(F.regexp_replace(F.regexp_replace(T.trim_all(s), '^["“”]', ""), '["“”]$', ""))
    rows = F.transform(F.transform(F.split(t, "\n"), strip), lambda s: F.when(s.rlike('^["“”]+$'), "").otherwise(s))
    return T.trim_all(F.regexp_replace(F.array_join(rows, "\n"), "\n{3,}", "\n\n"))


def normalized(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the cleaned text. Only rows with markup go through Python: a Python function inside a condition would see all rows."""
    marked = F.coalesce(F.col(text).rlike(HAS_MARKUP), F.lit(False))
    plain = df.where(~marked).withColumn(out, plain_normalized(F.col(text)))
    return plain.unionByName(df.where(marked).withColumn(out, by_text(normalize_text, "string")(F.col(text))))
