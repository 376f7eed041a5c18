"""Operators for training text against brute force on small fixtures."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import formatdup, leak, mixing, neardup, packing, pii, quality, queries, spans, truncation
from corpusloom.llm.stopwords import stop_words
from corpusloom.runtime import written

W = re.compile(r"[^\W_]+")


def words(t):
    return W.findall((t or "").lower())


@pytest.fixture(scope="module")
def texts(spark):
    r = np.random.default_rng(4)
    vocab = [f"{a}{b}" for a in ("ba", "ko", "ri", "mel", "tan", "sor") for b in ("du", "vi", "lek", "pra", "no")]
    make = lambda n: " ".join(r.choice(vocab, n))
    base = [make(60) for _ in range(40)]
    out = [(f"p{i:03}", t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:15]):
        w = t.split()
        w[10:12] = ["new", "words"]
        out.append((f"e{i:03}", " ".join(w)))
        out.append((f"s{i:03}", make(20) + " — " + t[50:300] + " " + make(20)))
    out += [("c1", base[0]), ("c2", base[0].upper() + "!!"), ("z1", ""), ("z2", None), ("z3", "…"), ("z4", "one"), ("z5", "a" * 5000)]
    return out, spark.createDataFrame(out, "id string, text string").repartition(3)


def test_shared_spans(spark, texts):
    rows, df = texts
    own = {}
    for i, t in rows:
        for a in range(len(t or "") - 199):
            own.setdefault(t[a : a + 200], set()).add(i)
    want = {}
    for i, t in rows:
        last = n = 0
        for a in range(len(t or "") - 199):
            if len(own[t[a : a + 200]]) > 1:
                s = max(a, last)
                n, last = n + a + 200 - s, a + 200
        if n:
            want[i] = n
    index = spans.FingerprintIndex(spark)
    name = index.append(df)
    chars = lambda x: {r.id: r.shared_chars for r in x.collect()}
    assert chars(spans.shared_chars(df, index, name)) == want and len(want) > 10
    assert chars(spans.shared_by_id(index, spans.batch_stretches(df, index, name, hot=1))) == want


def test_shared_spans_batch_by_batch(spark, texts, tmp_path):
    rows, df = texts
    df = df.unionByName(spark.createDataFrame([("zz", rows[0][1]), ("p000", rows[0][1])], "id string, text string"))
    whole = spans.FingerprintIndex(spark)
    chars = lambda x: {r.id: r.shared_chars for r in x.collect()}
    want = chars(spans.shared_chars(df, whole, whole.append(df)))
    path = "file://" + str(tmp_path / "index")
    got = None
    for i in range(3):
        index = spans.FingerprintIndex(spark, path)  # opened anew for each batch
        if i == 2:
            index.compact()
            assert len(index.runs) == 1
        part = df.where(F.pmod(F.xxhash64("id"), F.lit(3)) == i)
        new = spans.batch_stretches(df, index, index.append(part))
        got = new if got is None else got.unionByName(new)
    assert chars(spans.shared_by_id(index, got)) == want
    # old records that share only among themselves aren't listed with a batch that has no part in it
    a, b, c = ("x" * 30 + " ".join(f"{k}{i}" for i in range(90)) for k in "abc")
    old = spark.createDataFrame([("o1", a), ("o2", a), ("o3", b)], "id string, text string")
    late = spark.createDataFrame([("n1", b + "!"), ("n2", c)], "id string, text string")
    index = spans.FingerprintIndex(spark)
    index.append(old)
    assert set(chars(spans.shared_chars(old.unionByName(late), index, index.append(late)))) == {"o3", "n1"}
    plan = index.run(index.runs[0]).unionByName(index.run(index.runs[1])).dropDuplicates(["hash", "cls", "pos"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_shared_spans_of_a_hot_stretch(spark):
    r = np.random.default_rng(6)
    foot = "Sent from the desk of nobody in particular: " + " ".join(f"w{i}" for i in range(80))
    rows = [(f"h{i:03}", " ".join(f"{x}" for x in r.integers(0, 10**6, 40)) + foot) for i in range(60)]
    rows += [(f"o{i:03}", " ".join(f"{x}" for x in r.integers(0, 10**6, 60))) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, text string").repartition(4)
    index = spans.FingerprintIndex(spark)
    name = index.append(df)
    cold, hot = (spans.shared_by_id(index, spans.batch_stretches(df, index, name, hot=h)) for h in (10**6, 20))
    a, b = ({x.id: x.shared_chars for x in y.collect()} for y in (cold, hot))
    assert a == b and set(a) == {f"h{i:03}" for i in range(60)} and set(a.values()) <= set(range(len(foot), len(foot) + 6))


def test_near_duplicates(spark, texts):
    rows, df = texts
    sets = {i: {tuple(words(t)[k : k + 3]) for k in range(len(words(t)) - 2)} for i, t in rows}
    ids = sorted(i for i in sets if sets[i])
    want = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    members, links = neardup.similar(df, 0.6, 3)
    assert {tuple(r) for r in neardup.similar_ids(members, links).collect()} == want
    assert {tuple(r) for r in neardup.similar_ids(members, links, share=2).collect()} == want
    for hot, block in ((2, 3), (5, 100)):  # buckets above hot are cut into blocks
        assert {tuple(r) for r in neardup.similar_ids(*neardup.similar(df, 0.6, 3, hot=hot, block=block)).collect()} == want
    g = {r.id: r.grp for r in neardup.groups(members, links).collect()}
    assert all(g[a] == g[b] for a, b in want) and set(g) == set(ids)
    assert neardup.similar(df.limit(0), 0.6, 3)[1].count() == 0


def test_large_bucket():
    r = np.random.default_rng(1)
    n = 700
    low, high = (r.integers(0, 2**63, n).astype(np.uint64) for _ in range(2))
    low[1::2], high[1::2] = low[::2] ^ np.uint64(5), high[::2]
    cls = np.arange(n) * 3 - 900
    key = np.where(np.arange(n) < 20, 1, 7)
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array(x) for x in (key[i : i + 90], cls[i : i + 90], low[i : i + 90].view(np.int64), high[i : i + 90].view(np.int64))], names=list("abcd")) for i in range(0, n, 90)])
    for hot in (50, 100, 699, 10_000):
        pairs, rows = set(), set()
        for b in neardup.bucket_pairs(10, hot)(batches()):
            for x in b.to_pylist():
                pairs.add((x["a"], x["b"])) if x["b"] is not None else rows.add((x["bucket"], x["a"]))
        want = {(c, c + 3) for c in cls[::2].tolist()}
        small = {p for p in want if p[0] < cls[20]}
        assert pairs == (want if hot > 680 else small)
        assert rows == (set() if hot > 680 else {(7, c) for c in cls[20:].tolist()})


def test_groups_of_long_chains(spark):
    r = np.random.default_rng(8)
    keys = np.unique(r.integers(-(2**62), 2**62, 1500))
    r.shuffle(keys)
    chains = [[int(x) for x in keys[:1000]], [int(x) for x in sorted(keys[1000:1200])]]
    links = [(min(a, b), max(a, b), 0.9) for c in chains for a, b in zip(c, c[1:])]
    order = r.permutation(len(links))
    members = spark.createDataFrame([(f"m{k}", int(k)) for k in keys], "id string, cls bigint")
    g = {x.id: x.grp for x in neardup.groups(members, spark.createDataFrame([links[i] for i in order], "a bigint, b bigint, similarity double")).collect()}
    want = {k: min(c) for c in chains for k in c}
    assert g == {f"m{k}": want.get(int(k), int(k)) for k in keys}


def test_groups_have_every_row(spark, tmp_path):
    long = "one two three four five six seven"
    rows = [("a", "One two, three four"), ("b", "one two three FOUR!"), ("c", "two"), ("d", None), ("e", ""), ("f", "…"), ("g", long), ("h", long.upper()), ("i", "other")]
    spark.createDataFrame(rows, "id string, text string").write.parquet(str(tmp_path / "pieces.parquet"))
    got = queries.p7_groups(spark, str(tmp_path)).collect()
    g = {r.id: r.grp for r in got}
    assert len(got) == len(rows) and set(g) == {i for i, _ in rows} and all(r.links == 0 for r in got)
    assert g["a"] == g["b"] and g["g"] == g["h"] and len(set(g.values())) == 7


def test_leaks(spark, texts):
    rows, df = texts
    items = [(1, " ".join(rows[2][1].split()[5:40]).upper()), (2, "too short"), (3, None), (4, rows[7][1])]
    it = spark.createDataFrame(items, "item_id bigint, text string")
    grams = lambda t: {tuple(words(t)[k : k + 20]) for k in range(len(words(t)) - 19)}
    want = {(n, i) for n, t in items for i, x in rows if grams(t) & grams(x)}
    found = leak.leaked_spans(df, it)
    assert {(r.item_id, r.id) for r in found.collect()} == want and len(want) > 2
    clean = {r.id: r for r in leak.without_spans(df, found).collect()}
    assert clean["p007"].removed_chars > 0 and clean["p020"].removed_chars == 0


def test_format_copies(spark):
    rows = [("a", "Note", "One, two."), ("b", " note", "one two"), ("c", "note.", "ONE  TWO!"), ("d", "doc", "one two"), ("e", None, "x"), ("f", "", "X"), ("g", "doc", "…"), ("h", "doc", "!"), ("i", "doc", None)]
    df = spark.createDataFrame(rows, "id string, source string, text string").withColumn("key", F.lit("clash"))
    got = {tuple(r) for r in formatdup.format_copies(df, "id", ["source", "text"], "record").collect()}
    assert got == {("a", "b"), ("a", "c"), ("e", "f")}
    lines = [("1", '{"source":"a","text":"Hi there","title":null}'), ("2", '{"text" : "hi  there" , "source":"A"}'), ("3", '{"text":"hi there","source":"b"}'), ("4", "{broken"), ("5", None), ("6", "[1]")]
    ld = spark.createDataFrame(lines, "line_id string, line string")
    assert {tuple(r) for r in formatdup.format_copies(ld, "line_id", ["line"], "line").collect()} == {("1", "2")}
    assert formatdup.same_folded(["a-b", "a", ""], ["A B", "b", "!"]).tolist() == [True, False, True]


def test_quality(spark):
    s = lambda t: dict(zip(quality.STATS, quality.statistics(t, stop_words())))
    shown = quality.inspected()
    for name, kind, t in shown:
        x = s(t)
        assert (x["item_share"] > 0.5) == (name == "list"), kind
        assert (x["row_share"] > 0.5) == (name == "table"), kind
        if name == "junk":
            assert x["language_share"] < 0.5, kind
    assert s(None)["words"] == 0 and s("")["language_share"] == 0 and s("…")["common_words"] == 0


def test_quality_mixture(spark):
    rows = [(f"{n}{i}", t, 7) for i in range(6) for n, _, t in quality.inspected()] + [("nul", None, 3), ("emp", "", 3), ("ok", "two words", 2)]
    df = spark.createDataFrame([(f"{i}-{a}", b, c) for i, (a, b, c) in enumerate(rows)], "id string, text string, word_count int")
    got = quality.findings(df).collect()
    kinds = {r.id: r.finding for r in got if r.finding != "wrong_count"}
    right = sum(kinds.get(i, "prose") == re.sub(r"^\d+-|\d+$", "", i) for i in [r.id for r in df.collect()] if re.search(r"\d$", i))
    assert right >= 0.85 * 6 * len(quality.inspected())
    wrong = {r.id.split("-")[1] for r in got if r.finding == "wrong_count"}
    assert "emp" in wrong and "nul" not in wrong and "ok" not in wrong


def test_personal_items(spark):
    names = frozenset({"anna", "daniel", "rose"})
    field, gate = pii.train(names, frozenset({"plan", "budget", "review"}), stop_words()), pii.gate(names)
    table = pii.labelled(2, seed=77)
    got = pii.items_in(field, gate, [t for t, _ in table])
    kinds = lambda x: {k for _, _, k in x}
    right = sum(kinds(a) == kinds(b) for (_, a), b in zip(table, got))
    assert right >= 0.92 * len(table)
    df = spark.createDataFrame([("1", "Call 212-555-0166 before noon."), ("2", None), ("3", ""), ("4", "Order 4027 7711 1122 paid for it.")], "k string, t string")
    red = {r.k: (r.t, r["items"]) for r in pii.redacted(df, "k", "t", (field, gate)).collect()}
    assert red["1"] == ("Call [PHONE] before noon.", 1) and red["2"] == (None, 0) and red["4"][1] == 0


def test_personal_items_of_sentences_held_out(spark):
    names = frozenset("anna daniel clara erik rose may hope grace mark will".split())
    hit, want = {k: 0 for k in pii.KINDS}, {k: 0 for k in pii.KINDS}
    for fold in range(2):
        out = pii.SENTENCES[fold::4]
        field = pii.train(names, frozenset(), stop_words(), table=pii.labelled(sentences=tuple(x for x in pii.SENTENCES if x not in out)))
        table = pii.labelled(3, seed=99, sentences=out)
        for (_, items), got in zip(table, pii.items_in(field, pii.gate(names), [t for t, _ in table])):
            for k in pii.KINDS:
                n, m = sum(x[2] == k for x in items), sum(x[2] == k for x in got)
                want[k] += n
                hit[k] += min(n, m)
    assert all(want[k] > 10 and hit[k] >= 0.8 * want[k] for k in pii.KINDS), (hit, want)


def test_personal_items_anywhere(spark):
    """No sign is needed near an item, and the labels are those of Viterbi over whole texts."""
    names = frozenset({"anna", "daniel", "rose"})
    field, gate = pii.train(names, frozenset({"plan", "budget", "review"}), stop_words()), pii.gate(names)
    shown = ["My neighbour |Erik Duprafeez-Gubaard| mended the fence.", "I lent the ladder to |Grace Riduova-Vilek|.", "Her mailbox is |tanlektan at mail (dot) tanri-works (dot) org|.", "The garden of |Gutanba, Omar| is green."]
    far = "They built the harvest guide in autumn. " * 300
    for t in shown:
        a, item, b = t.split("|")
        assert [(x, y) for x, y, _ in pii.items_in(field, gate, [far + a + item + b + " " + far])[0]] == [(len(far + a), len(far + a + item))], t
    table = [t for t, _ in pii.labelled(1, seed=5)]
    texts = table + [" ".join(table[i : i + 9]) for i in range(0, len(table), 9)] + [None, "", " ", "\n", "\t Anna\xa0 Melin", "a" * 3000, "Rose", "12", "_", far]
    got = [np.zeros(len(pii.split(t or "")), int) for t in texts]
    for of, at, labels in field.labels(texts, gate):
        for i, a, label in zip(of, at, labels):
            got[i][a] = label
    for t, have in zip(texts, got):
        ids = [0] * pii.REACH + (field.ids(t, gate) if t else []) + [0] * pii.REACH
        e = np.array([sum(field.table[o, ids[j + o]] for o in range(2 * pii.REACH + 1)) for j in range(len(have))], np.float64).reshape(-1, len(pii.LABELS))
        if len(e):
            score, back = e[0] + np.where(pii.ALLOWED[0], 0, pii.NEVER), []
            for x in e[1:]:
                back.append((score[:, None] + field.pairs).argmax(0))
                score = (score[:, None] + field.pairs).max(0) + x
            path = [int(score.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            assert have.tolist() == path[::-1], t


def test_forms_of_tokens(spark):
    """What is sought by signs and digits alone is what one pattern of all forms finds."""
    everything = pii.form_pattern(tuple(pii.FORMS))
    texts = [t for t, _ in pii.labelled(2, seed=8)] + ["x12 AB 12 34 56 C,QQ123456A X1234567 +4915112345678(030) 1234 5678", "(12) 3456-7890 12345 Main Street; 00491234567890", "straße 5 Hafenstraße 5, am Tor 7", "AB 12 1AB 12 34 56 D", "one two three four five six seven's"]
    for t in texts:
        toks, kinds = pii.split(t), pii.Kinds(frozenset())
        want = [(m.span(), m.lastgroup) for m in everything.finditer(t)]
        held = pii.Gate()(t, sum(kinds[x] in "dD" for x in toks))
        got = (pii.by_digits(t) if held == ("digit",) else list(pii.form_pattern(held).finditer(t))) if held else []
        assert [(m.span(), m.lastgroup) for m in got] == want, t


def test_ordinary_words(spark):
    texts = spark.createDataFrame([("The plan went on",), ("the plan of Plan B",), ("rare",), (None,), ("",)] + [("copy copy rare2x",)] * 5, "t string")
    assert pii.ordinary_words([texts.coalesce(1)]) == {"plan"}
    assert pii.ordinary_words([texts.limit(0)]) == frozenset()
    with pytest.raises(ValueError, match="given names"):
        pii.fit(spark.range(pii.MAX_NAMES + 1).select(F.col("id").cast("string").alias("given_name")), [texts])


def test_packing(spark):
    r = np.random.default_rng(1)
    sizes = [(int(i), int(n)) for i, n in enumerate(r.integers(0, 300, 400))] + [(900, 2500), (901, 1024), (902, 0), (903, None)]
    frame = spark.createDataFrame(sizes, "id bigint, n_tokens int")
    placed = packing.packed(frame, "id", cell=7).toPandas()
    assert len(packing.packed(frame, "id").toPandas()) == len(placed)
    assert packing.packed(frame.limit(0), "id").count() == 0
    assert placed[placed.n_tokens > 0].sequence.notna().all() and placed[placed.n_tokens == 0].sequence.isna().all()
    used = placed.dropna().sort_values(["sequence", "at"])
    for _, g in used.groupby("sequence"):
        assert g["at"].iloc[0] == 0 and (g["at"].iloc[1:].values == (g["at"] + g.n_tokens).iloc[:-1].values).all() and (g["at"] + g.n_tokens).max() <= 1024
    assert used.n_tokens.sum() == sum(n or 0 for _, n in sizes) and used.n_tokens.sum() / (used.sequence.nunique() * 1024) > 0.97
    assert sorted(placed[placed.id == 900].n_tokens) == [452, 1024, 1024]


def test_mixing(spark):
    rows = [(i, "a", 10) for i in range(3000)] + [(i + 3000, "b", 10) for i in range(600)] + [(9998, "x", 5), (9999, None, 5)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.4, 4), ("none", 0.0, 3)], "source string, target_share double, max_repeats int")
    used = mixing.uses(sizes, targets).persist()
    by = {r.source: r for r in mixing.shares(used, targets).collect()}
    assert abs(by["b"].share - 0.4) < 0.03 and by["a"].most_uses <= 2 and by["b"].most_uses <= 4 and by["x"].used_tokens == 0
    assert mixing.mixture(used).count() == used.agg(F.sum("uses")).head()[0]
    again = mixing.uses(sizes.repartition(5), targets)
    assert used.exceptAll(again).count() == 0


def test_truncation(spark):
    v = lambda t: truncation.verdict(t)[0]
    assert [v(x) for x in ("It ended.", "It ended.</p>", "It ended 🙏", "half &nbs", "half <p style", "the la�", None, "…", "x\n\n#tag #more", "see https://x.test/a")] == [
        "done", "done", "done", "cut", "cut", "cut", "done", "done", "done", "done",
    ]
    full = "The board moved the yearly budget review to Friday and nobody asked why it was late."
    rows = [(1, full), (2, full[:60]), (3, full[:60]), (4, "another text that is quite long and stands alone here"), (5, None), (6, ""), (7, "The"), (8, full + " Then it rained.")]
    rows += [(9, "First line\nsecond"), (10, "First line"), (11, "x" * 5000 + " end"), (12, "x" * 5000), (13, full[:40] + " […]")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {1: False, 2: True, 3: True, 7: True, 10: False, 12: True, 13: True}
    for parts in (1, 4, 9):
        assert {r.doc_id: r.goes_on for r in truncation.longer_copies(df, "doc_id", "text", parts).collect()} == want
    assert truncation.longer_copies(df.limit(0), "doc_id", "text").count() == 0
    got = {r.doc_id for r in truncation.truncated(df, "doc_id", "text").collect() if r.longer_copy}
    assert {i for i, on in want.items() if on} <= got
    subj, verb, obj = ("The board", "My team", "A reader"), ("moved", "closed", "wrote"), ("the yearly budget", "the garden plan", "a survey memo")
    body = [f"{s} {x} {o} because the old rule was slow." for s in subj for x in verb for o in obj]
    m = truncation.train([" ".join(body[i:] + body[:i]) for i in range(27)])
    odds = m.cut_odds(["My team closed the garden plan because the old rule was slow", "My team closed the garden", "A reader wro"])
    assert odds[0] < 0 < odds[1] and odds[2] > 0


def test_longer_copies_of_a_hot_stem(spark):
    # a third of all rows is one cut text; brute force agrees
    r = np.random.default_rng(2)
    body = [" ".join(r.choice(["plan", "desk", "rule", "map", "note", "tool"], 12)) for _ in range(60)]
    rows = list(enumerate(body + [t[: int(r.integers(1, len(t)))] for t in body] + [body[0][:31]] * 60))
    stems = {i: truncation.stem(t) for i, t in rows}
    want = {i for i, s in stems.items() if s and any(x != s and x.startswith(s) for x in stems.values())}
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert {x.doc_id for x in truncation.longer_copies(df.repartition(5), "doc_id", "text").collect()} == want


def test_endings_count_the_whole_corpus(spark, monkeypatch):
    subj, verb = ("The board", "My team", "A reader"), ("moved", "closed", "wrote")
    body = " ".join(f"{s} {x} the yearly budget because the old rule was slow." for s in subj for x in verb)
    rows = [(i, body) for i in range(20)] + [(100 + i, "We met Quillfeather again today. The zanzibar opened.") for i in range(3)]
    rows += [(200, body + "\n- ask Quillfea"), (201, body + "\n- ask Quillfeather"), (202, body + "\n- see the zanzibar"), (203, body + "\n- other thing")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = {tuple(r) for r in truncation.lexicon(df, "text").collect()}
    assert ("w", "quillfeather") in known and ("w", "thing") not in known
    # the classifier sees texts without these words
    model = truncation.train([body] * 20)
    assert {r.doc_id for r in truncation.truncated(df, "doc_id", "text", model).collect()} == {200}
    assert {r.doc_id for r in truncation.truncated(df.repartition(5), "doc_id", "text").collect() if r.doc_id >= 200} == {200}


def test_near_duplicates_hold_folded_copies(spark, tmp_path):
    rows = [("a", "Can't."), ("b", "cant"), ("c", "CAN T!"), ("d", "We paid 44,000 and can't say why it's so"), ("e", "we paid 44000 and cant say why its so"), ("f", "…"), ("g", "!"), ("h", None), ("i", "other words")]
    spark.createDataFrame(rows, "id string, text string").write.parquet(str(tmp_path / "pieces.parquet"))
    got = sorted(tuple(r) for r in queries.p7_found(spark, str(tmp_path)).collect())
    assert got == [("a", "b"), ("a", "c"), ("b", "c"), ("d", "e")]


def test_counts_of_every_record(spark, tmp_path):
    rows = [("a", "Note", "One, two."), ("b", " note", "one two"), ("d", "doc", "one two"), ("g", "doc", "…"), ("i", "doc", None)]
    spark.createDataFrame(rows, "id string, source string, text string").write.parquet(str(tmp_path / "pieces.parquet"))
    lines = [("1", '{"source":"a","text":"Hi there"}'), ("2", '{"text" : "hi  there" , "source":"A"}'), ("3", '{"text":"hi","source":"b"}'), ("4", "{broken")]
    spark.createDataFrame(lines, "line_id string, line string").write.parquet(str(tmp_path / "index_lines.parquet"))
    got = sorted(tuple(r) for r in queries.p6_counts(spark, str(tmp_path)).collect())
    assert got == [("index_lines", "1", 2), ("index_lines", "3", 1), ("pieces", "a", 2), ("pieces", "d", 1)]


def two_batches(df, hot):
    index = spans.FingerprintIndex(df.sparkSession)
    parts = [spans.batch_stretches(df, index, index.append(df.where(F.pmod(F.xxhash64("id"), F.lit(2)) == i)), hot=hot) for i in range(2)]
    return spans.shared_by_id(index, parts[0].unionByName(parts[1]))


def test_shared_spans_of_an_anchor_hot_in_all_batches_together(spark):
    # three records have the stretch: too few in each batch, enough in both to be hot
    foot = " ".join(f"w{i}" for i in range(90))
    df = spark.createDataFrame([(f"r{i}", f"{i} {foot}") for i in range(3)], "id string, text string")
    assert df.select(F.pmod(F.xxhash64("id"), F.lit(2))).distinct().count() == 2
    cold, hot = ({r.id: r.shared_chars for r in two_batches(df, h).collect()} for h in (10**6, 2))
    assert hot == cold == {f"r{i}": len(foot) + 1 for i in range(3)}


def test_shared_spans_broadcast_nothing_that_grows(spark, texts, monkeypatch):
    plans = []
    plan = lambda x: plans.append(x._jdf.queryExecution().executedPlan().toString()) or x
    monkeypatch.setattr(spans, "written", lambda x, name: written(plan(x), name))
    spark.conf.set("spark.corpusloom.broadcastRows", "0")  # every side is too large, whatever Spark takes its size for
    try:
        got = plan(two_batches(texts[1], 0)).count()
    finally:
        spark.conf.unset("spark.corpusloom.broadcastRows")
    assert got > 10 and len(plans) > 8 and not any("Broadcast" in p for p in plans)
