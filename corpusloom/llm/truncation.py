"""Texts that stop before their author did.

Two kinds of evidence:

* A longer copy. Hashes of prefixes of fixed lengths (powers of LEVEL) are met with hashes of stems, which are texts
  without a mark of omission at their end; that leaves the few stems that may be prefixes of others. Only those, each
  different stem once, are sorted by value: whatever has a stem as a strict prefix follows it directly, so each is
  compared with its successor. Ends of ranges are settled through one row per range. A stem counts as cut off if its
  longer copy goes on within the word or sentence.
* The ending itself, of every text. Broken characters, tags and entities tell by rule. For the rest a classifier says
  whether the last segment is a finished one. It is trained on the corpus: sentences and lines that others follow are
  finished, the same cut at any place are not. Its sample is bounded by TRAIN_DOCS; the words and closing lines that it
  asks for are counted over all texts.

Defined cases: null, blank and letterless texts are complete; a complete text may end in tags, signature, address,
list, emoji, closing remark or a sentence without its full stop; a longer copy that starts a new line or sentence
after the stem shows nothing.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.codepoints import BASE_1, MIX_1, U64, Codes, mix, powers
from corpusloom.llm.frames import map_batches, record
from corpusloom.runtime import checked_broadcast, near_small, salted_join, written

#: Texts at most that the classifier is trained on; examples per text; size of the hashed feature space; examples a step.
TRAIN_DOCS, PER_DOC, FEATURES, BATCH = 6000, 8, 1 << 18, 256
#: Lengths of hashed prefixes are its powers.
LEVEL = 4

#: One mark of omission at the end of a text; none is longer than TAIL but for runs of dots or angles.
MARK = re.compile(
    r"(?:\[\s{0,9}(?:…|\.{3,9})\s{0,9}\]|\(\s{0,9}(?:…|\.{3,9}|more)\s{0,9}\)|…|\.{3,}|(?<![\w.])(?:read|see|show)\s{1,9}more|(?<=…)\s{0,9}more|>>+|»)$", re.I
)
TAIL = 40
REMARK = re.compile(r"\s*\((?:[^()\n]{1,40})\)$")
SMILE = re.compile(r"(?:[:;8]-?[)(DPp]|<3|\^\^|[←-⯿\U0001f000-\U0001faff️‍])$")
TAG = re.compile(r"<(?:/?[A-Za-z][\w-]*(?:\s[^<>]*)?|!--[^<>]*--)/?>$")
OPEN_TAG = re.compile(r"<(?:/?[A-Za-z!][^<>]*|/)?$")
#: Entity names whose strict prefixes at the end of a text show a cut.
ENTITIES = (
    "amp lt gt quot apos nbsp hellip mdash ndash rsquo lsquo rdquo ldquo laquo raquo bull middot copy reg trade euro pound "
    "yen cent sect para deg times auml ouml uuml Auml Ouml Uuml szlig eacute egrave ecirc agrave acirc ccedil ntilde iacute "
    "oacute uacute aacute shy zwnj"
).split()
OPEN_ENTITY = re.compile(r"&(#[0-9]{0,6}|#x[0-9A-Fa-f]{0,5}|[A-Za-z]{1,7})?$")
ENDED = re.compile(r"[.!?。！？][\"'”’»)\]*_]*$")
SENTENCE = re.compile(r"(?<=[.!?])[\"'”’»)\]]*\s+")
ITEM = re.compile(r"\s*(?:[-*•–]|\d+[.)]|\[.?\])\s")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def without_marks(t: str) -> str:
    """t without the marks of omission at its end; only the end of a text is looked at, however long it is."""
    while t and t[-1] in "])….eE>»" and (m := MARK.search(t[-TAIL:])):
        t = t[: len(t) - len(m[0])]
        if m[0][0] in ".>":
            t = t.rstrip(m[0][0])  # a run that is longer than the tail
        t = t.rstrip()
    return t


def without_tags(t: str) -> str:
    while t.endswith(">") and (at := t.rfind("<")) >= 0 and TAG.match(t, at):
        t = t[:at].rstrip()
    return t


def without_smiles(t: str) -> str:
    while t and (m := SMILE.search(t[-3:])):
        t = t[: len(t) - len(m[0])].rstrip()
    return t


def stem(text: str) -> str:
    """The text without white space and marks of omission at its end."""
    return without_marks((text or "").rstrip())


def verdict(text: str) -> tuple[str, str]:
    """(`cut` | `done` | `ask`, last segment)."""
    t = (text or "").rstrip()
    if not WORD.search(t):
        return "done", ""
    if t.endswith("�"):
        return "cut", t[-40:]
    at = t.rfind("<")
    if at >= 0 and len(t) - at < 400 and (m := OPEN_TAG.match(t, at)) and not re.fullmatch(r"<\d?", m[0]):
        return "cut", m[0]
    at = t.rfind("&", max(0, len(t) - 10))
    if at >= 0 and (m := OPEN_ENTITY.match(t, at)) and m[1] is not None and (m[1].startswith("#") or any(e.startswith(m[1]) for e in ENTITIES)):
        return "cut", m[0]
    before = None
    smiled = False
    while before != t:
        before = t
        t = without_tags(t)
        if (s := without_smiles(t)) != t:
            t, smiled = s, True
    if smiled or not t:
        return "done", t[-40:]
    t = without_tags(without_marks(t))
    if ENDED.search(t[-60:]):
        return "done", t[-40:]
    if t.endswith(")") and (m := REMARK.search(t[-80:])) and ENDED.search(t[: len(t) - len(m[0])].rstrip()[-60:]):
        return "done", t[-40:]
    line = re.sub(r"<[^<>]*>", " ", t.rsplit("\n", 1)[-1]).strip()
    tokens = line.split()
    if tokens and (all(x.startswith("#") and len(x) > 1 for x in tokens) or re.fullmatch(r"(?:https?://|www\.)\S+", tokens[-1])):
        return "done", line
    return "ask", segment(line)


def segment(line: str) -> str:
    parts = SENTENCE.split(line)
    return parts[-1].strip() if parts else ""


def last_word(seg: str) -> str:
    w = WORD.findall(seg)
    return w[-1].lower() if w else ""


def closing_line(text: str) -> str | None:
    """The last of several lines if it is short."""
    t = text.rstrip()
    last = t.rsplit("\n", 1)[-1].strip().lower()
    return last if len(last) <= 40 and "\n" in t else None


def features(seg: str, known: bool, closing: bool) -> list[str]:
    """known: whether the corpus has the last word; closing: whether the segment is one of its closing lines."""
    w = [x.lower() for x in WORD.findall(seg)]
    if not w:
        return ["none"]
    n, last = len(w), w[-1]
    two, three = " ".join(w[-2:]), " ".join(w[-3:])
    start, start2 = w[0], " ".join(w[:2])
    tail = re.search(r"[^\w\s]*$", seg)[0]
    k = "known" if known else "digits" if last.isdigit() else "new"
    bullet = bool(ITEM.match(seg))
    comma = min(seg.count(","), 3)
    out = [
        "b", f"k={k}", f"l={last}", f"2={two}", f"3={three}", f"n={min(n, 25)}", f"s={start}|n={min(n, 25)}", f"S={start2}|l={last}",
        f"s={start}|l={last}", f"S={start2}|n={min(n, 25)}", f"c={comma}|s={start}", f"S={start2}|c={comma}|k={k}", f"t={tail}", f"i={bullet}|k={k}",
        f"line={closing}", f"p={len(last)}|{k}", f"S={start2}|2={w[-2] if n > 1 else ''}", f"e={last[-2:]}", f"low={seg[:1].islower()}|{min(n, 6)}",
    ]
    for cue in ("but", "and", "that", "because", "when", "than", "so", "from", "not", "or", "first", "it", "was", "dass", "que", "et", "und", "y"):
        if cue in w[:-1]:
            out.append(f"q={start}|{cue}|{min(n - 1 - (len(w) - 1 - w[::-1].index(cue)), 9)}")
            out.append(f"S={start2}|{cue}|{min(len(w) - 1 - w[::-1].index(cue, 1), 30)}|{min(n, 30)}")
    return out


def _slots(names: list[str]) -> np.ndarray:
    return (pd.util.hash_array(np.array(names, object), categorize=False) % np.uint64(FEATURES)).astype(np.int64)


class Endings:
    """A logistic regression over hashed features of a last segment."""

    def __init__(self, known: frozenset, lines: frozenset, weights: np.ndarray):
        self.known, self.lines, self.weights = known, lines, weights
        self.beginnings = frozenset(w[:i] for w in known for i in range(1, len(w)))

    def flags(self, seg: str) -> tuple[bool, bool, bool]:
        """Whether the last word is known, whether it begins a known word, whether the segment is a closing line; by the training texts."""
        last = last_word(seg)
        return last in self.known, last in self.beginnings, seg.strip().lower() in self.lines

    def cut_odds(self, segs: list[str], flags: list[tuple[bool, bool, bool]] | None = None) -> np.ndarray:
        flags = [self.flags(s) for s in segs] if flags is None else flags
        names, owner = [], []
        for i, (s, (known, _, closing)) in enumerate(zip(segs, flags)):
            f = features(s, known, closing)
            names += f
            owner += [i] * len(f)
        if not names:
            return np.empty(0)
        odds = np.bincount(owner, self.weights[_slots(names)], minlength=len(segs))
        for i, (s, (known, begins, _)) in enumerate(zip(segs, flags)):
            if ITEM.match(s):  # an item of a list ends anywhere, but not within a word
                odds[i] = 1.0 if not known and begins else -1.0
        return odds


def examples(texts: list[str], per_doc: int, seed: int = 5) -> tuple[list[str], list[bool]]:
    """Segments and whether each is cut. Of each text, only what others follow is taken for finished."""
    rng = np.random.default_rng(seed)
    segs: list[str] = []
    cut: list[bool] = []
    for t in texts:
        t = re.sub(r"<[^<>]*>", " ", t)
        lines = [x.strip() for x in t.split("\n") if x.strip()]
        done: list[str] = []
        for i, x in enumerate(lines):
            parts = [p.strip() for p in SENTENCE.split(x) if p.strip()]
            done += [p for p in parts[:-1]]
            if parts and (i < len(lines) - 1 or ENDED.search(parts[-1])):
                done.append(parts[-1])
        if len(done) > per_doc:
            done = [done[i] for i in rng.choice(len(done), per_doc, replace=False)]
        for s in done:
            bare = re.sub(r"[.!?…]+[\"'”’»)\]]*$", "", s).rstrip()
            if not WORD.search(bare):
                continue
            segs.append(bare)
            cut.append(False)
            w = [m.end() for m in WORD.finditer(bare)]
            if len(w) > 1:
                for e in rng.choice(w[:-1], min(2, len(w) - 1), replace=False):
                    segs.append(bare[:e])
                    cut.append(True)
            # anywhere, mostly within a word
            e = int(rng.integers(1, max(2, len(bare))))
            piece = bare[:e].rstrip()
            if e < len(bare) and WORD.search(piece):
                segs.append(piece)
                cut.append(True)
    return segs, cut


def counts_of(texts: list[str]) -> tuple[dict[str, int], dict[str, int]]:
    """How often each word stands before another, and each short line closes a text."""
    counts: dict[str, int] = {}
    closing: dict[str, int] = {}
    for t in texts:
        for w in WORD.findall(t.lower())[:-1]:
            counts[w] = counts.get(w, 0) + 1
        if (last := closing_line(t)) is not None:
            closing[last] = closing.get(last, 0) + 1
    return counts, closing


#: A word is known if counted so often at least, a line is a closing one.
KNOWN, CLOSING = 2, 3


def train(texts: list[str], per_doc: int = PER_DOC, epochs: int = 4, lexicon=None) -> Endings:
    """lexicon(words, lines): those of the words and lines that the whole corpus has often enough; without it, texts are the corpus."""
    segs, cut = examples(texts, per_doc)
    counts, closing = counts_of(texts)
    if lexicon is None:
        known = frozenset(w for w, n in counts.items() if n >= KNOWN)
        lines = frozenset(x for x, n in closing.items() if n >= CLOSING)
    else:
        known, lines = lexicon({last_word(s) for s in segs} | {last_word(x) for x in closing}, {s.strip().lower() for s in segs} | set(closing))
    for x in sorted(lines & set(closing)):  # closing lines are finished though nothing follows
        segs += [x] * 3
        cut += [False] * 3
    names = [features(s, last_word(s) in known, s.strip().lower() in lines) for s in segs]
    size = np.array([len(x) for x in names])
    slots, start = _slots([y for x in names for y in x]), np.concatenate(([0], np.cumsum(size)))
    y = np.array(cut, float)
    weights = np.zeros(FEATURES)
    squares = np.full(FEATURES, 1e-6)
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(len(names))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            own = np.repeat(np.arange(len(part)), size[part])
            idx = slots[np.repeat(start[part] - np.concatenate(([0], np.cumsum(size[part])[:-1])), size[part]) + np.arange(len(own))]
            p = 1 / (1 + np.exp(-np.clip(np.bincount(own, weights[idx], minlength=len(part)), -30, 30)))
            at, back = np.unique(idx, return_inverse=True)
            g = np.bincount(back, (p - y[part])[own])
            squares[at] += g**2
            weights[at] -= 0.3 * g / np.sqrt(squares[at])
    return Endings(known, lines, weights)


def prefix_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, hash of the whole text, level, hash of its prefix of that level, whether the level is its highest)."""
    c = Codes(texts)
    n = np.diff(c.start)
    place = np.arange(len(c.codes)) - np.repeat(c.start[:-1], n)
    sums = np.zeros(len(c.codes) + 1, U64)
    if len(c.codes):
        np.cumsum(mix(c.codes.astype(U64)) * powers(BASE_1, int(n.max()) + 1)[place], out=sums[1:])
    upto = lambda i, size: mix(sums[c.start[i] + size] - sums[c.start[i]] + size.astype(U64) * MIX_1)
    whole = upto(np.arange(c.n), n)
    out = [[] for _ in range(3)]
    level, size = 0, 1
    while size <= (int(n.max()) if len(n) else 0):
        i = np.flatnonzero(n >= size)
        for o, x in zip(out, (i, np.full(len(i), level, np.int32), upto(i, np.full(len(i), size)))):
            o.append(x)
        level, size = level + 1, size * LEVEL
    i, lev, pre = (np.concatenate(o) if o else np.empty(0, np.int64) for o in out)
    return i, whole[i], lev.astype(np.int32), pre.astype(U64), n[i] < LEVEL ** (lev + 1)


def goes_on(short: str, long: str) -> bool:
    """Whether a longer copy goes on within the word or sentence at which the shorter one stops."""
    rest = long[len(short) :]
    if short[-1].isalnum() and rest[0].isalnum():
        return True
    return not ENDED.search(short[-60:]) and not short.endswith(":") and "\n" not in rest[: len(rest) - len(rest.lstrip())]


def longer_copies(df: DataFrame, key: str, text: str, parts: int | None = None) -> DataFrame:
    """(key, goes_on) of rows whose stem is a strict prefix of another row's stem, of any length. Rows of one key count once."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    df = df.select(key, text).where(F.col(key).isNotNull())

    def hashed():
        def f(b: pa.RecordBatch):
            i, whole, level, prefix, own = prefix_hashes([stem(t) for t in b.column(1).to_pylist()])
            return record(**{key: b.column(0).take(pa.array(i)), "whole": whole.view(np.int64), "level": level, "prefix": prefix.view(np.int64), "own": own})

        return f

    rows = written(map_batches(df, hashed, f"`{key}` {kind}, whole bigint, level int, prefix bigint, own boolean"), "prefixes")
    groups = rows.groupBy("level", "prefix").agg(F.min("whole").alias("lo"), F.max("whole").alias("hi"), F.max("own").alias("stops"))
    groups = written(groups.where("stops and lo <> hi").select("level", "prefix"), "prefix-groups")
    maybe = near_small(rows.select(key, "whole", "level", "prefix"), groups, ["level", "prefix"], spread="whole")
    maybe = written(maybe.groupBy("whole").agg(F.min(key).alias(key)), "maybe-prefixes")

    def stems():
        def f(b: pa.RecordBatch):
            return record(whole=b.column(0), stem=pa.array([stem(t) for t in b.column(1).to_pylist()], pa.string()))

        return f

    texts = df.join(checked_broadcast(maybe), key).dropDuplicates(["whole"]).select("whole", text)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = map_batches(texts, stems, "whole bigint, stem string").repartitionByRange(n, "stem").sortWithinPartitions("stem")

    def compare(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first = whole = held = None
        for b in batches:
            got, on = [], []
            for w, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if first is None:
                    first = s
                elif s != held and s.startswith(held):
                    got.append(whole)
                    on.append(goes_on(held, s))
                whole, held = w, s
            none = len(got)
            yield record(whole=pa.array(got, pa.int64()), goes_on=pa.array(on, pa.bool_()), part=pa.array([None] * none, pa.int32()), first=pa.array([None] * none, pa.string()), last=pa.array([None] * none, pa.string()))
        if first is not None:
            yield record(whole=pa.array([whole], pa.int64()), goes_on=pa.array([None], pa.bool_()), part=pa.array([part], pa.int32()), first=pa.array([first], pa.string()), last=pa.array([held], pa.string()))

    out = written(ranged.mapInArrow(compare, "whole bigint, goes_on boolean, part int, first string, last string"), "prefix-pairs")
    ends = out.where("part is not null")  # one row per range
    after = ends.select(F.col("part").alias("p"), F.col("first").alias("next"))
    ends = ends.join(F.broadcast(after), F.col("p") > F.col("part")).groupBy("whole", "last").agg(F.min_by("next", "p").alias("next"))
    ends = ends.where(F.startswith("next", "last") & (F.length("next") > F.length("last")))
    ends = ends.select("whole", F.udf(goes_on, "boolean", useArrow=False)("last", "next").alias("goes_on"))  # at most one row per range
    found = out.where("part is null").select("whole", "goes_on").unionByName(ends)
    own = rows.where("own").select(key, "whole")
    return near_small(own, found, ["whole"], spread=key).groupBy(key).agg(F.max("goes_on").alias("goes_on"))


def lexicon(df: DataFrame, text: str) -> DataFrame:
    """(kind, item) of the words and closing lines that all texts together have often enough."""

    def make():
        def f(b: pa.RecordBatch):
            words, lines = counts_of([t for t in b.column(0).to_pylist() if t])
            return record(kind=["w"] * len(words) + ["l"] * len(lines), item=pa.array([*words, *lines], pa.string()), n=pa.array([*words.values(), *lines.values()], pa.int64()))

        return f

    parts = map_batches(df.select(text), make, "kind string, item string, n bigint").groupBy("kind", "item").agg(F.sum("n").alias("n"))
    return written(parts.where(F.col("n") >= F.when(F.col("kind") == "w", KNOWN).otherwise(CLOSING)).select("kind", "item"), "lexicon")


def sampled(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows, or all if there are no more: those whose hash of the key lies under a bound, so nothing is sorted and few rows are sent."""
    n = df.select(key).count()
    bound = 2**63 - 1 if n <= most else int(2**63 * most / n)
    h = F.shiftrightunsigned(F.xxhash64(F.lit(3), key), 1)
    return df.withColumn("__h", h).where(F.col("__h") <= bound)


def fit(df: DataFrame, key: str, text: str, max_docs: int = TRAIN_DOCS, known: DataFrame | None = None) -> Endings:
    """Train on at most max_docs texts, chosen by a hash of the key; all of them if there are fewer. known: the lexicon of all texts."""
    known = lexicon(df, text) if known is None else known
    rows = sampled(df.where(F.length(text) > 0), key, max_docs).select(F.col(text).alias("t"), "__h").collect()
    rows = sorted(rows, key=lambda r: (r[1], r[0]))[:max_docs]

    def ask(words: set, lines: set) -> tuple[frozenset, frozenset]:
        asked = df.sparkSession.createDataFrame(pd.DataFrame([("w", x) for x in words] + [("l", x) for x in lines], columns=["kind", "item"]), "kind string, item string")
        got = known.join(asked, ["kind", "item"], "left_semi").collect()
        return frozenset(r[1] for r in got if r[0] == "w"), frozenset(r[1] for r in got if r[0] == "l")

    return train([r[0] for r in rows], lexicon=ask)


def _flagged(asked: DataFrame, known: DataFrame, spread: str) -> DataFrame:
    """asked with the flags of each segment: known and begins of its last word, closing of its line; by joins, whatever the lexicon's size."""
    words = known.where("kind = 'w'").select(F.col("item").alias("last"))
    lasts = asked.select("last").distinct().join(words.withColumn("known", F.lit(True)), "last", "left")
    lasts = written(lasts.select("last", F.coalesce("known", F.lit(False)).alias("known")), "last-words")
    new = lasts.where("not known and last <> ''").select(F.col("last").alias("p"))
    longest = F.broadcast(new.agg(F.coalesce(F.max(F.length("p")), F.lit(0)).alias("longest")))
    heads = words.crossJoin(longest).withColumn("m", F.least(F.length("last") - 1, F.col("longest"))).where("m > 0")
    heads = heads.select(F.explode(F.transform(F.sequence(F.lit(1), F.col("m")), lambda n: F.substring(F.col("last"), F.lit(1), n))).alias("p"))
    begins = heads.join(checked_broadcast(new), "p", "left_semi").distinct().select(F.col("p").alias("last"), F.lit(True).alias("begins"))
    lasts = lasts.join(begins, "last", "left").select("last", "known", F.coalesce("begins", F.lit(False)).alias("begins"))
    lines = known.where("kind = 'l'").select(F.col("item").alias("line"), F.lit(True).alias("closing"))
    out = salted_join(asked, lasts, ["last"], how="left", spread=spread)
    return salted_join(out, lines, ["line"], how="left", spread=spread).withColumn("closing", F.coalesce("closing", F.lit(False)))


def truncated(df: DataFrame, key: str, text: str, model: Endings | None = None) -> DataFrame:
    """(key, reason, longer_copy) of each text that was cut off, by its ending or by a longer copy; every text is judged whole."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    known = lexicon(df, text)
    sent = spark.sparkContext.broadcast((model or fit(df, key, text, known=known)).weights)

    def look():
        def f(b: pa.RecordBatch):
            got = [verdict(t) for t in b.column(1).to_pylist()]
            at = [i for i, (v, _) in enumerate(got) if v != "done"]
            segs = [got[i][1] for i in at]
            return record(**{
                key: b.column(0).take(pa.array(at, pa.int64())), "verdict": pa.array([got[i][0] for i in at], pa.string()), "seg": pa.array(segs, pa.string()),
                "last": pa.array([last_word(s) for s in segs], pa.string()), "line": pa.array([s.strip().lower() for s in segs], pa.string()),
            })

        return f

    def judge():
        m = Endings(frozenset(), frozenset(), sent.value)

        def f(b: pa.RecordBatch):
            ok = pa.array(m.cut_odds(b.column(1).to_pylist(), list(zip(*[b.column(i).to_pylist() for i in (2, 3, 4)]))) > 0)
            return record(**{key: b.column(0).filter(ok), "reason": pa.array(["ending"] * ok.true_count, pa.string())})

        return f

    seen = written(map_batches(df.select(key, text).where(F.col(key).isNotNull()), look, f"`{key}` {kind}, verdict string, seg string, last string, line string"), "endings")
    asked = _flagged(seen.where("verdict = 'ask'"), known, key).select(key, "seg", "known", "begins", "closing")
    ended = map_batches(asked, judge, f"`{key}` {kind}, reason string").unionByName(seen.where("verdict = 'cut'").select(key, F.lit("broken").alias("reason")))
    copies = written(longer_copies(df, key, text), "longer-copies")
    ended = ended.unionByName(copies.where("goes_on").select(key, F.lit("longer copy").alias("reason"))).groupBy(key).agg(F.min("reason").alias("reason"))
    return ended.join(copies.select(key, F.lit(True).alias("longer_copy")), key, "left").select(key, "reason", F.coalesce("longer_copy", F.lit(False)).alias("longer_copy"))
