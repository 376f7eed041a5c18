"""Per-document statistics of texts, and a mixture model that tells prose from lists, tables and junk.

1. Statistics: one pass per text, each its own numbers only (STATS names them).
2. Model: a Gaussian mixture on standardized statistics, fitted by expectation-maximization over all texts. Every round
   is one job that sums each component's moments in the tasks; only those sums come to the driver. The components
   start at inspected examples, one kind of text each.
3. Names: a component gets the name of the inspected examples for which it is responsible; a text gets the name of its
   likeliest component, and nothing overrules that.

Defined cases: null, empty and letterless texts have no name (and are left out of the fit); very long texts are
measured whole; a wrong word count is found for any text that isn't null.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.frames import map_batches, record
from corpusloom.llm.stopwords import stop_words
from corpusloom.runtime import written

STATS = (
    "words", "mean_word_length", "symbol_ratio", "digit_ratio", "ended_lines", "common_words", "distinct_words", "item_share",
    "row_share", "language_share", "odd_words", "garbled", "line_words",
)
#: Statistics the mixture is fitted on; shares are sharpened around one half first.
FITTED = ("mean_word_length", "symbol_ratio", "digit_ratio", "ended_lines", "common_words", "distinct_words", "item_share",
          "row_share", "language_share", "odd_words", "garbled", "line_words")
SHARPENED = ("item_share", "row_share", "language_share")
MARKER = re.compile(r"\s*(?:[-*+•–·‣▪◦○●✓✔☐☑→»]|\(?\d{1,3}[.):]|\(?[A-Za-z][.)]|\[[ xX✓]?\])\s+\S")
KEYED = re.compile(r"\s*[^\W\d_][\w -]{0,24}: \S")
RULE = re.compile(r"[\s|:+=\-]*-{2,}[\s|:+=\-]*$")
CELLS = re.compile(r"\s*\|\s*|\t|\s{2,}")
TAG = re.compile(r"<[^<>]{1,200}>")
NOT_GIVEN = re.compile(r"\bn/a\b")
VOWELS = "aeiouyäöüáéíóúàèùâêîôûæøåœ"
ODD = re.compile(rf"[^\W\d_{VOWELS}]{{5,}}|^[^\W\d_{VOWELS}]{{3,}}$", re.I)
GARBLED = re.compile(r"�+|[ÃÂ][-¿‘-›€™]|â[€‚][^\s]?|ï»¿")
WORD = re.compile(r"[^\W_]+")


@lru_cache(1 << 16)
def is_odd(word: str) -> bool:
    return ODD.search(word) is not None


def _rows(lines: list[str], common: frozenset) -> list[int]:
    """Cells of each line that looks like a row of columns, else 0."""
    out = []
    for x in lines:
        s = x.strip()
        if RULE.match(s) and ("|" in s or len(s) > 3):
            out.append(-1)  # a ruling line belongs to the rows around it
            continue
        sure = s.endswith((".", "!", "?")) and "|" not in s and "\t" not in s and "," not in s and ";" not in s
        if sure:
            out.append(0)  # nothing below takes a line for a row that ends a sentence and holds no separator
            continue
        w = [y for y in WORD.findall(NOT_GIVEN.sub(" ", s.lower())) if y.isalpha()]
        if len(w) >= 5 and sum(y in common for y in w) >= 0.25 * len(w):
            out.append(0)  # a sentence with odd white space
            continue
        bars, tabs = s.count("|"), x.count("\t")
        if bars >= 2 or tabs >= 1:
            out.append(max(bars, tabs + 1))
            continue
        cells = [c for c in CELLS.split(s) if c]
        wide = len(s.split()) / max(1, len(cells))
        if len(cells) >= 2 and wide <= 3.2 and not s.endswith((".", "!", "?")):
            out.append(len(cells))
            continue
        n = max(s.count(","), s.count(";"))
        sep = "," if s.count(",") == n else ";"
        parts = s.split(sep)
        if n >= 2 and len(s.split()) / len(parts) <= 3.2 and not s.endswith((".", "!", "?", ";")) and sep + " " not in s:
            out.append(len(parts))
        else:
            out.append(0)
    return out


def _enumerates(line: str, common: frozenset) -> bool:
    """Whether a line is an enumeration: six or more different short items between commas or the like."""
    if sum(map(line.count, ",;·•/|")) < 5:
        return False
    parts = [x.split() for x in re.split(r"\s*[,;·•/|]\s+", line.strip(" .;,")) if x.strip()]
    sizes = [len(x) for x in parts]
    if len(parts) < 6 or max(sizes) > 7 or sum(sizes) > 4.5 * len(parts) or 2 * len({" ".join(x).lower() for x in parts}) < len(parts):
        return False
    w = WORD.findall(line.lower())
    return sum(y in common for y in w) < 0.2 * len(w) and sum(y.isalpha() for y in w) > 0.6 * len(w)


def statistics(text: str, common: frozenset) -> list[float]:
    """The numbers of STATS; common holds frequent words; item_share, row_share and language_share are shares of the characters in lines."""
    text = text or ""
    bare = TAG.sub(" ", text) if "<" in text else text
    lines = [x for x in bare.splitlines() if x.strip()]
    tokens = bare.split()
    words = WORD.findall(bare.lower())
    dense = sum(map(len, tokens))
    if not words or not lines:
        return [float(len(text.split()))] + [0.0] * (len(STATS) - 1)
    weight = [len(x.strip()) for x in lines]
    total = sum(weight)
    cells = _rows(lines, common)
    solid = [bool(c) for c in cells]
    if sum(solid) < 3:
        solid = [False] * len(lines)
    items = []
    for x, row in zip(lines, solid):
        s = x.strip()
        n = len(s.split())
        if row:
            items.append(0)
        elif MARKER.match(x) or _enumerates(s, common):
            items.append(2)
        elif n <= 6 and (KEYED.match(x) or (s[0].isupper() and not s.endswith((".", "!", "?", ",", ":")))) and 4 * (sum(map(str.isalpha, s)) + s.count(" ")) >= 3 * len(s):
            items.append(1)
        else:
            items.append(0)
    # lines without a marker are items only where at least four such follow each other
    run = 0
    for i in range(len(items) + 1):
        if i < len(items) and items[i] == 1:
            run += 1
            continue
        if run < 4 or len({lines[j].strip().lower() for j in range(i - run, i)}) * 2 < run:
            for j in range(i - run, i):
                items[j] = 0
        run = 0
    frequent = sum(w in common for w in words)
    language = ended = 0
    for x, n, row, item in zip(lines, weight, solid, items):
        w = WORD.findall(NOT_GIVEN.sub(" ", x.lower()))
        if not row and not item and len(w) >= 3 and sum(y in common for y in w) >= 0.12 * len(w):
            language += n
        ended += x.rstrip().endswith((".", "!", "?", "…", ":", '"', "”"))
    letters = [w for w in words if w.isalpha()]
    odd = sum(map(is_odd, letters))
    alnum = sum(map(len, words))
    return [
        float(len(text.split())), dense / len(tokens), 1 - alnum / dense, sum(map(str.isdigit, bare)) / dense, ended / len(lines),
        frequent / len(words), len(set(words)) / len(words), sum(n for n, i in zip(weight, items) if i) / total,
        sum(n for n, r in zip(weight, solid) if r) / total, language / total, odd / max(1, len(letters)),
        sum(len(m) for m in GARBLED.findall(text)) / max(1, len(text)), len(words) / len(lines),
    ]


def fitted(stats: np.ndarray) -> np.ndarray:
    """The columns of FITTED of rows of STATS, shares sharpened, sizes as logarithms."""
    x = stats[:, [STATS.index(s) for s in FITTED]].copy()
    for s in SHARPENED:
        i = FITTED.index(s)
        x[:, i] = 1 / (1 + np.exp(-14 * (x[:, i] - 0.5)))
    for s in ("mean_word_length", "line_words"):
        i = FITTED.index(s)
        x[:, i] = np.log1p(x[:, i])
    return x


def _noise(seed: int, alphabet: str, sizes) -> str:
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list(alphabet), n)) for n in sizes)


def inspected() -> list[tuple[str, str, str]]:
    """(name, kind, text): examples in the likeness of what inspection of the corpus showed, written for this purpose."""
    p1 = "We moved the release to Friday because the build was slow, and nobody noticed. Half of the team had left by then."
    p2 = "When you read a plan twice, you see what it leaves out. I kept mine on one page for that reason."
    p3 = "Das Team sagte gestern, dass die Vorlage nicht reicht. Wir haben den Ablauf neu gedacht, weil die Liste zu lang war."
    verse = "we cut the plan in two\nand nobody asked us why\nthe rest of it was quiet\nso we read it again in spring"
    marked = [f"{m} {x}" for m, x in zip(["-"] * 9, ["sales plan", "garden rule", "open the archive", "slow meeting", "weekly map", "trim the budget", "tired sample", "Blue Harbor note", "survey desk"])]
    plain = "Sales plan\nGarden rule\nOpen the archive\nSlow meeting\nWeekly map\nTrim the budget\nTired sample\nBlue harbor note"
    keyed = "plan: sales desk\nrule: garden walk\nmap: open archive\nnote: slow meeting\ntool: weekly survey\nteam: Blue Harbor"
    r = np.random.default_rng(3)
    num = lambda: str(int(r.integers(10, 99999)))
    piped = "| item | plan | rule |\n|---|---|---|\n" + "\n".join(f"| garden desk | {num()} | €{num()} |" for _ in range(6))
    spaced = "item            plan      rule\n" + "\n".join(f"garden desk     {num():10}{num()}%" for _ in range(7))
    numbers = "\n".join(f"{num()}  {num()}  n/a  {num()}" for _ in range(8))
    commas = "item,plan,rule\n" + "\n".join(f'garden desk,{num()},"{num()}"' for _ in range(6))
    logs = "\n".join(f"2021-03-0{i} 10:1{i}:22 INFO plan[{num()}]: rule={num()}{num()} rc={i}" for i in range(1, 8))
    css = "\n".join(f".zed-{x}{{width:{num()}px;color:#0a{num()}}}" for x in ("plan", "rule", "map", "note", "tool"))
    code = "{" + ",".join(f'"plan_{i}":{num()},"rule_{i}":null,"map_{i}":"{num()}ab"' for i in range(12)) + "}"
    base = _noise(5, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", [300])
    signs = "zorimu " + _noise(6, "<>@#$%^&*=~|°§¬_-", [220])
    broken = "ï»¿Ã©Ã¼Â â‚¬Ã¢â‚¬â„¢zor�Ã©â‚¬Ã¼" * 12
    letters = _noise(7, "abcdefghijklmnopqrstuvwxyz", r.integers(2, 12, 60))
    return [
        ("prose", "sentences", f"{p1} {p2} {p1}"), ("prose", "paragraphs", f"Hi all,\n\n{p2}\n\n{p1}\n\nBest,\nthe desk"), ("prose", "german", p3),
        ("prose", "one line", p1), ("prose", "verse", verse), ("prose", "with items", f"{p1} {p2} {p1}\n\n- sales plan\n- garden rule"),
        ("list", "marked", "\n".join(marked)), ("list", "numbered", "\n".join(f"{i + 1}. {x[2:]}" for i, x in enumerate(marked))), ("list", "plain", plain),
        ("list", "inline", ", ".join(x[2:] for x in marked)),
        ("list", "keyed", keyed), ("table", "piped", piped), ("table", "spaced", spaced), ("table", "numbers", numbers), ("table", "commas", commas),
        ("junk", "log", logs), ("junk", "style", css), ("junk", "code", code), ("junk", "base64", base), ("junk", "signs", signs), ("junk", "broken", broken),
        ("junk", "letters", letters), ("junk", "repeated lines", "zorimutaga\n" * 40), ("junk", "repeated", "zorimutaga " * 40),
    ]


class Mixture:
    """Gaussians with full covariances over standardized statistics."""

    def __init__(self, mean, scale, weights, means, covs):
        self.mean, self.scale = mean, scale
        self.weights, self.means, self.covs = weights, means, covs
        self.chol = np.linalg.cholesky(covs)
        self.inverse = np.linalg.inv(self.chol)
        self.half = np.log(np.einsum("kii->ki", self.chol)).sum(1)

    def standardized(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def log_parts(self, z: np.ndarray) -> np.ndarray:
        out = np.empty((len(z), len(self.weights)))
        for k in range(len(self.weights)):
            y = (z - self.means[k]) @ self.inverse[k].T
            out[:, k] = np.log(self.weights[k] + 1e-12) - self.half[k] - 0.5 * np.einsum("ij,ij->i", y, y)
        return out

    def responsibilities(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lp = self.log_parts(z)
        top = lp.max(1, keepdims=True)
        p = np.exp(lp - top)
        s = p.sum(1, keepdims=True)
        return p / s, (top + np.log(s))[:, 0]


#: Ridge on the covariances in units of the standardized statistics; rounds at most; least gain in mean log likelihood.
RIDGE, ROUNDS, GAIN = 0.02, 12, 0.01


def _moments(x: DataFrame, model: Mixture | None, d: int) -> dict[tuple[int, int], float]:
    """Sums over all rows, by (component, place): weight, first and second moments, log likelihood last."""
    sent = x.sparkSession.sparkContext.broadcast(model)

    def sums(batches):
        m, acc = sent.value, None
        for b in batches:
            v = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1)
            if not len(v):
                continue
            if m is None:
                part = np.concatenate(([len(v)], v.sum(0), (v * v).sum(0)))[None]
            else:
                z = m.standardized(v)
                r, ll = m.responsibilities(z)
                second = np.einsum("nk,nij->kij", r, z[:, :, None] * z[:, None, :], optimize=True) if len(z) < 50 else np.stack([(z * r[:, [k]]).T @ z for k in range(r.shape[1])])
                part = np.concatenate((r.sum(0)[:, None], r.T @ z, second.reshape(r.shape[1], -1), np.full((r.shape[1], 1), ll.sum() / r.shape[1])), 1)
            acc = part if acc is None else acc + part
        if acc is not None:
            k, p = np.indices(acc.shape)
            yield record(k=k.ravel().astype(np.int32), p=p.ravel().astype(np.int32), v=acc.ravel())

    out = x.mapInArrow(sums, "k int, p int, v double").groupBy("k", "p").agg(F.sum("v").alias("v")).collect()  # components x moments
    return {(r.k, r.p): r.v for r in out}


def fit(x: DataFrame) -> tuple[Mixture | None, list[str]]:
    """The mixture over all rows of x (columns of FITTED), and the name of each component."""
    d = len(FITTED)
    first = _moments(x, None, d)
    n = first.get((0, 0), 0.0)
    if not n:
        return None, []
    mean = np.array([first[0, 1 + i] for i in range(d)]) / n
    scale = np.sqrt(np.maximum(np.array([first[0, 1 + d + i] for i in range(d)]) / n - mean**2, 1e-4))
    shown = inspected()
    common = stop_words()
    z = (fitted(np.array([statistics(t, common) for _, _, t in shown])) - mean) / scale
    k = len(shown)
    model = Mixture(mean, scale, np.full(k, 1 / k), z, np.tile(np.eye(d) * 0.5, (k, 1, 1)))
    last = -np.inf
    for _ in range(ROUNDS):
        s = _moments(x, model, d)
        a = np.array([[s[i, p] for p in range(2 + d + d * d)] for i in range(k)])
        size = a[:, 0]
        # a component that lost its rows stays where it was
        live = size > 1e-6 * n + 1
        means, covs = model.means.copy(), model.covs.copy()
        means[live] = a[live, 1 : 1 + d] / size[live, None]
        second = a[live, 1 + d : 1 + d + d * d].reshape(-1, d, d) / size[live, None, None]
        covs[live] = second - means[live][:, :, None] * means[live][:, None, :] + RIDGE * np.eye(d)
        covs[live] = (covs[live] + covs[live].transpose(0, 2, 1)) / 2
        weights = np.maximum(size, 1e-3) / np.maximum(size, 1e-3).sum()
        model = Mixture(mean, scale, weights, means, covs)
        like = a[:, -1].sum() / n
        if like - last < GAIN:
            break
        last = like
    r, _ = Mixture(mean, scale, np.full(k, 1 / k), model.means, model.covs).responsibilities(z)
    names = []
    for i in range(k):
        by: dict[str, float] = {}
        for (name, _, _), share in zip(shown, r[:, i]):
            by[name] = by.get(name, 0.0) + share
        best = max(by, key=by.get)
        if by[best] < 1e-3:  # responsible for no example: the name of the nearest
            gap = ((z - model.means[i]) ** 2).sum(1)
            best = shown[int(gap.argmin())][0]
        names.append(best)
    return model, names


def measured(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., is_text, STATS...) of every row; statistics are null for null texts."""
    rows = df.select(F.col(key), *keep, F.col(text))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    common = stop_words()

    def make():
        def f(b: pa.RecordBatch):
            texts = b.column(b.num_columns - 1).to_pylist()
            s = np.array([statistics(t, common) for t in texts]).reshape(-1, len(STATS))
            none = np.array([t is None for t in texts])
            is_text = np.array([bool(t) and WORD.search(t) is not None for t in texts])
            cols = {b.schema.names[i]: b.column(i) for i in range(b.num_columns - 1)}
            return record(**cols, is_text=pa.array(is_text), **{n: pa.array(s[:, i], mask=none) for i, n in enumerate(STATS)})

        return f

    return map_batches(rows, make, f"{head}, is_text boolean, " + ", ".join(f"{s} double" for s in STATS))


def named(stats: DataFrame) -> DataFrame:
    """Add column kind (prose, list, table, junk or null) to a written table of measured()."""
    spark = stats.sparkSession
    x = stats.where("is_text").select(*STATS)

    def columns():
        def f(b: pa.RecordBatch):
            v = fitted(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1))
            return record(**{n: v[:, i] for i, n in enumerate(FITTED)})

        return f

    x = written(map_batches(x, columns, ", ".join(f"{s} double" for s in FITTED)), "features")
    model, names = fit(x)
    sent = spark.sparkContext.broadcast((model, names))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields) + ", kind string"
    at = [stats.columns.index(s) for s in STATS]
    is_text = stats.columns.index("is_text")

    def make():
        m, name = sent.value
        name = np.array(name, object)

        def f(b: pa.RecordBatch):
            s = np.nan_to_num(np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in at], 1).astype(float))
            kind = np.full(len(s), None, object)
            ok = np.array(b.column(is_text).to_pylist(), bool)
            if m is not None and ok.any():
                kind[ok] = name[m.log_parts(m.standardized(fitted(s[ok]))).argmax(1)]
            return record(**{n: b.column(i) for i, n in enumerate(b.schema.names)}, kind=pa.array(kind.tolist(), pa.string()))

        return f

    return map_batches(stats, make, schema)


def findings(df: DataFrame, key: str = "id", text: str = "text", count: str = "word_count") -> DataFrame:
    """(key, finding): list, table, junk and wrong_count."""
    stats = written(measured(df, key, text, (count,)), "statistics")
    kinds = named(stats).where(F.col("kind").isin("list", "table", "junk")).select(key, F.col("kind").alias("finding"))
    wrong = stats.where((F.col(count) != 0) & (F.col(count) != F.col("words"))).select(key, F.lit("wrong_count").alias("finding"))
    return kinds.unionByName(wrong)
