"""Operators outside the llm subpackage on small fixtures of our own."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import corpus, dedupe, evaluate, guards, pairs, retrieve, rewrite, style
from corpusloom.operators.timestamps import normalize_stamps
from corpusloom.plans import corpus_queries
from corpusloom.sources import readers, writers
from corpusloom.streaming import ingest

PIECE = "id string, source string, text string, date string, year int, word_count int, title string, meta map<string,string>"


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("x")).head()["x"]


STAMPS = [
        ("2018-08-13", None, None, "2018-08-13"), (" 2018-8-3\t", None, None, "2018-08-03"), ("2019-02-30", None, None, None), ("20200229", None, None, "2020-02-29"),
        ("07/04/2020", "mdy", None, "2020-07-04"), ("07/04/2020", "dmy", None, "2020-04-07"), ("07/04/2020", None, None, None), ("07/24/2020", None, None, "2020-07-24"),
        ("31.12.2021 23:30", "mdy", "Europe/Berlin", "2021-12-31T22:30:00Z"), ("31.12.2021 23:30", "mdy", None, None), ("1611392664659", None, None, "2021-01-23T09:04:24Z"),
        ("1677729998", None, None, "2023-03-02T04:06:38Z"), ("2021-03-28 02:30", None, "Europe/Berlin", None), ("2021-10-31 02:30", None, "Europe/Berlin", None),
        ("2021-10-31 02:30 CET", None, None, "2021-10-31T01:30:00Z"), ("2021-10-31T02:30:00.999+02:00", None, None, "2021-10-31T00:30:00Z"),
        ("Thu, 03 Mar 2016 19:18:17 -0800", None, None, "2016-03-04T03:18:17Z"), ("May 8, 2020 12:05 AM EDT", None, None, "2020-05-08T04:05:00Z"),
        ("2014-02-15T01:40:02[Asia/Kolkata]", None, "Europe/Berlin", "2014-02-14T20:10:02Z"), ("2014-04-15T16:52:11 America/New_York", None, None, "2014-04-15T20:52:11Z"),
        ("2020", None, None, None), ("March 2021", None, None, None), ("25:61", None, None, None), ("", None, None, None), (None, None, None, None), ("2020-01-01 24:00", None, "UTC", None),
    ]


def test_stamps(spark):
    rows = [(i, *s[:3], "kept") for i, s in enumerate(STAMPS)]
    df = spark.createDataFrame(rows, "i int, s string, o string, z string, norm_extra string")
    got = {r.i: r for r in normalize_stamps(df, "s", "o", "z").collect()}
    assert [(s[0], got[i]["norm"]) for i, s in enumerate(STAMPS)] == [(s[0], s[3]) for s in STAMPS]
    assert got[0]["norm_extra"] == "kept" and normalize_stamps(df.limit(0), "s", "o", "z").count() == 0


def test_tokens(spark):
    t = "Don’t stop now.  It's 3 o'clock\n\nshort line"
    assert one(spark, T.word_count(F.col("t")), t=t) == 8
    assert one(spark, T.guard_words(F.col("t")), t=t)[:2] == ["don't", "stop"]
    assert one(spark, T.sentence_words(F.col("t")), t=t) == [4, 3, 2]
    assert one(spark, F.size(T.paragraphs(F.col("t"))), t=t) == 2
    for none in (None, "", " \n "):
        assert one(spark, T.sentence_words(F.col("t")), t=none) == [] and one(spark, T.short_line_ratio(F.col("t")), t=none) == 0
    assert one(spark, F.size(T.grams(T.guard_words(F.col("t")), 3)), t="one two") == 0


def test_select_and_append(spark):
    rows = [("a", "doc", 60, 2023), ("b", "doc", 10, 2023), ("c", "doc", 60, 2025), ("d", "doc", 60, None), ("e", "other", 60, 2023), ("f", None, 60, 2023)]
    df = spark.createDataFrame(rows, "id string, source string, word_count int, year int")
    ids = lambda x: sorted(r.id for r in x.collect())
    one_col = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert ids(corpus.select_pieces(df, ["doc"], 40, 2024)) == ["a"]
    assert ids(corpus.select_pieces(df, ["doc"], 40, 2024, True)) == ["a", "d"]
    assert ids(corpus.select_pieces(df, ["doc"], 40, 2024, False, one_col("b", "e"), one_col("a", "e"))) == ["b"]
    batch = spark.createDataFrame([("a", 1), ("x", 2), ("x", 3)], "id string, pos int")
    assert [(r.id, r.pos) for r in corpus.new_rows(df, batch).collect()] == [("x", 2)]
    assert corpus.new_rows(batch, batch).count() == 0


def test_dedupe(spark):
    rows = [
        ("b", "linkedin_post", "Same  text here", "2020-01-01", None, 3, "", {}), ("a", "doc", "<p>same text HERE</p>", None, None, 3, "", {}), ("c", "linkedin_article", '"Same text here"', None, None, 3, "", {}),
        ("d", "doc", "", None, None, 0, "", {}), ("e", "doc", None, None, None, 0, "", {}), ("f", "doc", "x" * 300 + " #a", None, None, 1, "", {}), ("g", "doc", "x" * 300 + " #ab", None, None, 1, "", {}),
    ]
    df = spark.createDataFrame(rows, PIECE)
    assert [(r.keeper, r.members) for r in dedupe.exact_groups(df).collect()] == [("c", 3)]
    assert sorted(r.id for r in dedupe.deduped(df).collect()) == ["c", "d", "e", "f", "g"]
    held = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert [r.keeper for r in dedupe.exact_groups(df, held("a")).collect()] == ["a"]
    with pytest.raises(Exception, match="two holdouts"):
        dedupe.dropped(df, held("a", "b")).collect()
    assert [(r.left, r.right) for r in dedupe.near_links(df).collect()] == [("f", "g")]
    assert dedupe.report(df.limit(0)).head()["groups"] == 0


def test_near_dedupe(spark, tmp_path):
    body = " ".join(f"word{i} went to town{i}" for i in range(30))
    post = lambda i, text, source="linkedin_post", date="2020-01-01": (i, source, text, date, None, 3, "", {})
    rows = [post("a", body), post("b", body + " #a"), post("c", body + " #a #b"), post("d", body.upper(), "doc", None), post("e", body + " #a #bc", "doc", None), post("f", "Other words"), post("g", "other  words"), post("h", "alone")]
    spark.createDataFrame(rows, PIECE).write.parquet(str(tmp_path / "pieces.parquet"))
    kept = sorted(r.id for r in corpus_queries.QUERIES["dedupe_keepers"](spark, str(tmp_path)).collect())
    # posts a, b, c are near; d has the key of a and is near e
    assert kept == ["c", "f", "h"]
    r = corpus_queries.QUERIES["dedupe_report"](spark, str(tmp_path)).head()
    assert (r.groups, r.exact_groups, r.near_groups, r.dropped, r.cross_source) == (2, 1, 1, 5, 1)
    assert r.dropped_by_source == {"doc": 2, "linkedin_post": 3}
    exact = dedupe.report(spark.createDataFrame(rows, PIECE)).head()
    assert (exact.groups, exact.near_groups, exact.dropped) == (2, 0, 2)
    with pytest.raises(Exception, match="two holdouts"):
        dedupe.dropped(spark.createDataFrame(rows, PIECE), spark.createDataFrame([("b",), ("e",)], "id string"), dedupe.NEAR_RATIO).collect()


def test_near_links_of_either_order(spark, monkeypatch):
    # the matcher isn't symmetric: a later copy of a key brings the other order of the two texts
    one, two = "ab" * 150 + "c", "ab" * 150 + "d"
    monkeypatch.setattr(dedupe, "sequence_ratio", lambda left, right: (left > right).astype(float))
    rows = [("1", "doc", one, None, None, 1, "", {}), ("2", "doc", two, None, None, 1, "", {}), ("3", "doc", one, None, None, 1, "", {})]
    assert dedupe.near_links(spark.createDataFrame(rows[:2], PIECE)).count() == 0
    assert [(r.left, r.right) for r in dedupe.near_links(spark.createDataFrame(rows, PIECE)).collect()] == [("2", "3")]


def test_style(spark):
    df = spark.createDataFrame([("linkedin_post", "You and I. We are here now."), ("doc", None), ("doc", "")], "source string, text string")
    s = style.corpus_stats(df).head()
    assert (s.pieces, s.words, s.you_count, s.i_count, s.median_sentence_words) == (1, 7, 1, 1, 3.5)
    assert style.corpus_stats(df.limit(0)).head()["words"] == 0
    v = spark.createDataFrame([(x,) for x in range(1, 11)], "n int")
    assert style.nearest_ranks(v, "n", {"q": 0.25})["q"] is not None and style.nearest_ranks(v, "n", {"q": 0.25}).head()["q"] == 3
    assert tuple(style.audit_quantiles(v, "n").head()) == (6, 10, 10)
    assert style.length_stats(df, "post").head()["post_length_samples"] == 1 and style.length_stats(df, "article").head()["median_article_words"] == 0


def test_guards(spark):
    d = spark.createDataFrame([(1, "a b c d e, f g h i j"), (2, "nothing like it"), (3, None)], "k int, text string")
    e = spark.createDataFrame([("x a b c d e f g h y",), (None,)], "text string")
    assert [r.gram for r in guards.parroted(d, e, "k", "text").collect()] == ["a b c d e f g h"]
    assert sorted(map(tuple, guards.copied_ratio(d, e, "k", "text").collect())) == [(1, 10, 8), (2, 3, 0), (3, 0, 0)]
    assert one(spark, guards.scaffold_markers(F.col("t")), t="[ENTITY NAME]\n---\nBRIEF: x") == ["block_separator", "brief_header", "placeholder"]
    assert one(spark, guards.evidence_figures(F.col("t")), t="seven years and 7 years, category 12, T+4, 3,000 invoices, 45%") == ["7 years", "3000 invoices", "45%"]
    x = one(spark, guards.invented(F.col("b"), F.col("d")), b="Contoso Ledger grew 5%", d="Ledger grew 5% at Fabrikam in 9 weeks")
    assert (x["names"], x["figures"], x["passed"]) == (["fabrikam"], ["9 weeks"], False)
    words = " ".join(f"w{i}" for i in range(40))
    assert one(spark, guards.brief_echo(F.col("d"), F.col("b")), d=words, b=words) and not one(spark, guards.brief_echo(F.col("d"), F.col("b")), d="a b", b="a b")


def test_pairs(spark):
    rows = [(1, "same text", "same text", {"channel": "post"}), (2, None, "", {}), (3, "Plain long sentence that goes on and on for a while.", "x", {"section_role": "opener"})]
    g = {r.pos: r for r in pairs.gate(spark.createDataFrame(rows, "pos int, input string, output string, meta map<string,string>")).collect()}
    assert g[1].failed == ["min_frag_gap_ratio", "min_median_sentence_gap"] and g[1].channel == "post"
    assert g[2].failed[:2] == ["empty_input", "empty_output"] and g[3].channel == "article"


def test_evaluate(spark):
    df = spark.createDataFrame([(3, 0), (0, 0), (15, 5), (10, 10)], "w int, l int")
    assert [r.p for r in df.select(evaluate.sign_test(F.col("w"), F.col("l")).alias("p")).collect()] == [0.125, 1.0, 0.0207, 0.5881]
    sizes = spark.createDataFrame([(n,) for n in (0, 8, 40, 80, 400)], "n int").select(evaluate.carve_size(F.col("n")).alias("c"))
    assert [r.c for r in sizes.collect()] == [0, 8, 12, 20, 24]
    pool = spark.createDataFrame([(f"i{n}",) for n in range(50)], "id string")
    a = [r.id for r in evaluate.carve(pool, 10, spark.createDataFrame([("i7",)], "id string")).collect()]
    b = [r.id for r in evaluate.carve(pool.repartition(7), 10, spark.createDataFrame([("i7",)], "id string")).collect()]
    assert a == b and a[0] == "i7" and len(a) == 10
    with pytest.raises(ValueError):
        evaluate.safe_receipt(spark.createDataFrame([(("x",),)], "a struct<draft:string>"))
    t = spark.createDataFrame([(20, 15, 5, 0, 0, 0, 0), (3, 2, 1, 0, 0, 0, 0)], "items int, wins int, losses int, ties int, a_out int, b_out int, both_out int")
    assert [(r.verdict, r.reasons) for r in evaluate.verdict(t).collect()] == [("keep", []), ("archive", ["not_beyond_chance"])]


def test_rewrite():
    assert rewrite.normalize_text("<style>p{a:b}</style><article><p>One two</p><p>three</p></article>") == "One two\n\nthree"
    assert rewrite.normalize_text(None) == "" and rewrite.normalize_text('"quoted"\r\n\r\n\r\n\r\nx') == "quoted\n\nx"
    assert rewrite.trim_words("a b c d\n\ne f g h\n\ni j k l", 8) == "a b c d\n\ne f g h" and rewrite.trim_words("a b c d e", 3) == "a b c d e"
    assert rewrite.drop_repeats("one two three\n\none two three\n\nfour") == "one two three\n\nfour"
    assert all(len(w) <= 50 for w in rewrite.windows("word " * 200 + "x" * 300, 50))
    notes = " ".join(rewrite.devoiced("You don't need Contoso. We cut it by 45% in May. #tag https://x.test/a"))
    assert "you" not in notes.lower().split() and "Contoso" in notes and "45%" in notes and "#" not in notes
    assert not rewrite.mined_brief("too short", "post")["ok"]
    assert rewrite.masked("We met Fabrikam's team.") == "We met team."


def test_retrieval(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", None)], "id string, vector array<double>")
    assert [r.id for r in retrieve.top_k(v, [1.0, 0.0], 2).collect()] == ["a", "b"] and retrieve.top_k(v, [1.0, 0.0], 0).count() == 0
    q = v.where("id in ('a','c')").select(F.col("id").alias("query"), "vector")
    got = {(r.query, r["rank"]): r.id for r in retrieve.top_k_per_query(v, q, 2).collect()}
    assert got[("a", 1)] == "a" and got[("a", 2)] == "b" and got[("c", 1)] == "c"
    e = spark.createDataFrame([("data tools",), ("",), (None,)], "t string").select(retrieve.embedding(F.col("t")).alias("v")).collect()
    assert abs(sum(x * x for x in e[0].v) - 1) < 1e-9 and not any(e[1].v) and not any(e[2].v)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "ex").mkdir()
    (tmp_path / "ex" / "Shares.csv").write_text('ShareCommentary,Date,ShareLink\n"a post, quoted",2023-04-01,http://x\n,2023-04-02,\n')
    (tmp_path / "ex" / "Comments.csv").write_text("Message;Date\nhello there;04/05/2023\n")
    got = {r.source: r for r in readers.read_export(spark, str(tmp_path / "ex")).collect()}
    assert got["linkedin_post"].text == "a post, quoted" and got["linkedin_comment"].date == "2023-04-05" and len(got) == 2
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "notes_x.md").write_text("Date: 2019-05-06\nbody of a note")
    (tmp_path / "docs" / "m.eml").write_text("From: a\n\nhello body")
    docs = {r.title: r for r in readers.read_documents(spark, str(tmp_path / "docs")).collect()}
    assert docs["notes_x"].source == "note" and docs["notes_x"].date == "2019-05-06" and docs["m"].text == "hello body" and docs["m"].source == "email"
    (tmp_path / "p.jsonl").write_text('{"not_you":"a","author":"b"}\n\n{"prompt":"c","completion":"d"}\n')
    assert [tuple(r)[:3] for r in readers.read_pairs(spark, str(tmp_path / "p.jsonl")).collect()] == [(0, "a", "b"), (2, "c", "d")]
    (tmp_path / "i.jsonl").write_text('{"id":"1","text":"a b","date":"2020-01-02"}\n\nbroken\n')
    assert [(r.id, r.source, r.word_count, r.year) for r in readers.read_index(spark, str(tmp_path / "i.jsonl")).collect()] == [("1", "doc", 2, 2020)]
    assert readers.read_index(spark, str(tmp_path / "none.jsonl")).count() == 0
    b = spark.createDataFrame([("1", 1), ("2", 2), ("2", 3)], "id string, pos int")
    assert [writers.append_new(str(tmp_path / "idx"), b), writers.append_new(str(tmp_path / "idx"), b)] == [2, 0]
    drops = str(tmp_path / "drops")
    spark.createDataFrame([("2", 1), ("9", 2)], "id string, pos int").write.parquet(drops)
    ingest.start_append(ingest.read_drops(spark, drops, "id string, pos int"), str(tmp_path / "idx"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "idx")).collect()) == ["1", "2", "9"]


def test_sinks_by_uri_and_after_a_crash(spark, tmp_path):
    b = spark.createDataFrame([("1", 1), ("2", 2), ("2", 3)], "id string, pos int")
    uri = "file://" + str(tmp_path / "idx")
    assert [writers.append_new(uri, b), writers.append_new(uri, b)] == [2, 0] and spark.read.parquet(uri).count() == 2
    writers.swap(spark.read.parquet(uri).where("id = '1'"), uri, "parquet", backup=True)
    assert spark.read.parquet(uri).count() == 1
    (tmp_path / "idx").rename(tmp_path / "gone")  # as if the second rename had not come
    assert spark.read.parquet(writers.recovered(spark, uri)).count() == 2
    assert writers.run_ingest(spark, str(tmp_path / "i2"), str(tmp_path / "reg"), {("csv", "a"): b.drop("pos"), ("doc", "b"): b.drop("pos")}) == (2, 6)
    assert writers.register(spark, str(tmp_path / "reg"), "csv", "a") == 0
    with pytest.raises(Exception):  # a broken index isn't an empty one
        (tmp_path / "bad").mkdir()
        (tmp_path / "bad" / "x.parquet").write_text("no")
        writers.append_new(str(tmp_path / "bad"), b)
    pieces = spark.createDataFrame([("b", "doc", "same text", None), ("a", "doc", "Same  text", None), ("c", "doc", "", None)], "id string, source string, text string, title string")
    pieces = pieces.selectExpr("*", "null as date", "map() as meta").withColumn("date", F.col("date").cast("string")).withColumn("meta", F.create_map().cast("map<string,string>"))
    writers.build_vector_index(pieces, uri + "-v", spark.createDataFrame([("b",)], "id string"))
    assert [r.id for r in writers.load_vector_index(spark, uri + "-v").collect()] == ["a"]
    pieces.write.parquet(uri + "-d")
    assert writers.apply_dedupe(spark, uri + "-d", near_ratio=1.0).head()["dropped"] == 1
    assert sorted(r.id for r in spark.read.parquet(uri + "-d").collect()) == ["a", "c"]


def test_readers_of_odd_files(spark, tmp_path):
    head = "ShareCommentary,Date,ShareLink\n"
    cut = head + "x" * (65535 - len(head)) + "é,2023-04-01,http://x\n"
    (tmp_path / "Shares.csv").write_bytes(cut.encode())
    assert readers.sniff(cut.encode()) == ("utf-8", ",") and readers.sniff("a;b\né".encode("latin-1")) == ("latin1", ";")
    assert "é" in readers.read_export(spark, "file://" + str(tmp_path)).head()["text"]
    import zipfile

    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.write(tmp_path / "Shares.csv", "in/Shares.csv")
    assert readers.read_export(spark, str(tmp_path / "e.zip")).count() == 1
    lines = [f'{{"input":"i{n}","output":"o{n}"}}' for n in range(3000)]
    lines[5] = ""
    (tmp_path / "p.jsonl").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    got = readers.read_pairs(spark, str(tmp_path / "p.jsonl"))
    assert got.rdd.getNumPartitions() > 2 and sorted((r.pos, r.input) for r in got.collect()) == [(n, f"i{n}") for n in range(3000) if n != 5]
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for bad, why in (("[1]", "no object in line 2"), ('{"x":1}', "no pair in line 2")):
        (tmp_path / "q.jsonl").write_text('{"input":"a","output":"b"}\n' + bad)
        with pytest.raises(Exception, match=why):
            readers.read_pairs(spark, str(tmp_path / "q.jsonl")).collect()
    (tmp_path / "h.json").write_text('{"holdout_ids": ["a", "b"]}')
    assert sorted(r.id for r in readers.read_ids(spark, str(tmp_path / "h.json")).collect()) == ["a", "b"]


def test_finishing(spark):
    from corpusloom.operators import drafting, finish, training
    from corpusloom.sources import samples

    c = F.col("text")
    kinds = {r.name: (r.a, r.b) for r in samples.drafts(spark).select("name", finish.sloppy(c).alias("a"), finish.soulless(c).alias("b")).collect()}
    assert kinds["slop_ledger"][0] and not kinds["clean_ledger"][0]
    assert one(spark, rewrite.strip_tells(F.col("t")), t="We delve into robust plans,  and utilize it .") == "We talk about real plans, and use it."
    assert finish.extracted("Hm.</think>\n### Rewritten\nShort text.\n### Draft\nx") == "Short text." and finish.extracted(None) == ""
    assert finish.collapsed("\n\n".join(["a b", "c d"] * 4)) == "a b\n\nc d" and finish.collapsed("a\n\nb") == "a\n\nb"
    draft = 'Last time I said it was late. Now it is.'
    assert finish.with_openers(draft, "Now it is.") == "Last time I said it was late. Now it is." and finish.with_openers("", "x") == "x"
    assert finish.with_openers('"Fast is slow."\n\nBody one.', "Body one.").startswith('"Fast is slow."')
    assert one(spark, finish.paragraphize(F.col("t")), t="This is a sentence of some length. Short one. And this is another longer sentence here.") == (
        "This is a sentence of some length. Short one.\n\nAnd this is another longer sentence here."
    )
    rows = spark.createDataFrame([(1, "We met Contoso in 9 weeks.", "They agree. Fabrikam left in 3 days.\n\nWe met Contoso."), (2, "x", "it was Fabrikam."), (3, None, None)], "k int, brief string, draft string")
    got = {r.k: r.draft for r in drafting.scrubbed(rows, "brief", "draft").collect()}
    assert got == {1: "They agree.\n\nWe met Contoso.", 2: "", 3: ""}
    vocabulary = spark.createDataFrame([("customers noticed it",), ("all customers left",), ("with managers and meetings",), ("managers like meetings",), ("we met Contoso",)], "text string")
    words = guards.ordinary_words(vocabulary, "text")
    assert {"customers", "managers", "meetings"} <= {r.word for r in words.collect()}
    d = spark.createDataFrame([(1, "b", "Customers noticed. Managers agreed. Meetings got shorter. Contoso left.")], "k int, b string, d string")
    assert guards.invented_names(d, "k", "b", "d", words.unionByName(spark.createDataFrame([("agreed",)], "word string"))).head()["names"] == ["contoso"]
    assert rewrite.masked("#Contoso @Fabrikam\n- Contoso\nplain") == "plain"
    assert training.fitted("a " * 2000, "b " * 50) is not None and training.fitted("", "x") is None
    t = "The harvest planning committee reviewed every single garden proposal yesterday evening"
    assert training.shared_words(training.distanced(t, t), t) < 0.72
    with pytest.raises(Exception, match="characters"):
        spark.createDataFrame([("a" * 4000, "b")], "i string, o string").select(training.translator_row(F.col("i"), F.col("o"))).collect()
    assert {r.kind: r["count"] for r in training.synthetic(spark).groupBy("kind").count().collect()} == {"short_cadence": 8, "clean_flat": 32, "multi_paragraph": 12}


def test_articles_and_arms(spark):
    from corpusloom.operators import drafting

    briefs = spark.createDataFrame([("a", "the plan", "- the plan has 9 weeks\n- nobody asked for the memo"), ("b", "", ""), ("c", "t", None)], "holdout_id string, topic string, points string")
    invent = lambda: lambda p: "it was Fabrikam that agreed." if "9 weeks" in p.split("only: ")[1].split("\n")[0] else "we saw that nobody asked for it."
    r = drafting.write_article(briefs, invent, 280).collect()
    assert [(x.holdout_id, x.sections, x.clean, x.repaired, x.scrubbed, x.dropped) for x in r] == [("a", 2, 1, 0, 0, 1)]
    empty = drafting.write_article(briefs, lambda: lambda p: "it was Fabrikam that agreed.", 280).head()
    assert empty.invented and empty.dropped == 2 and empty.words == 0
    s = evaluate.score(F.col("h"), F.col("d"), F.col("b"), F.lit(""))
    held = spark.createDataFrame([("Short. Lines.\n\nYou see it. You do.", "You see. Short lines.", "x")], "h string, d string, b string")
    assert not held.select(s.alias("s")).head()["s"].disqualified
    with pytest.raises(Exception, match="leaks"):
        evaluate.checked_receipt(spark.createDataFrame([("a", "Secret Firm")], "k string, note string"), ("secret",)).collect()
    pieces = spark.createDataFrame([("1", "x")], "id string, text string")
    with pytest.raises(Exception, match="no piece"):
        evaluate.holdouts(pieces, spark.createDataFrame([("2",)], "id string")).collect()
    art = spark.createDataFrame([(f"{i}", "linkedin_article", "<p>You and I went. We saw it all.</p>" * 3) for i in range(2)], "id string, source string, text string")
    row = style.article_cadence(art).head()
    assert row.article_cadence_samples == 2 and row.article_median_sentence_words is None
    assert style.directives(style.style_profile(art.limit(0).withColumn("text", F.col("text"))), banned=()).count() == 0


def test_near_links_of_a_hot_bucket(spark, monkeypatch):
    # a third of the rows without a date under one source; the split bucket gives what the whole one gives
    body = " ".join(f"word{i} went to town{i}" for i in range(40))
    rows = [(f"n{i:02}", "doc", f"{body} {i % 7}", None, None, 1, "", {}) for i in range(30)]
    rows += [(f"d{i:02}", "doc", f"{body} {i % 7}", f"2020-01-{i % 28 + 1:02}", None, 1, "", {}) for i in range(60)]
    df = spark.createDataFrame(rows, PIECE)
    whole = sorted(tuple(r) for r in dedupe.near_links(df).collect())
    monkeypatch.setattr(dedupe, "SHARE", 2)
    assert sorted(tuple(r) for r in dedupe.near_links(df).collect()) == whole and len(whole) > 20


def test_command_line(spark, tmp_path, capsys):
    from corpusloom.__main__ import main

    (tmp_path / "p.jsonl").write_text('{"input":"same text","output":"same text"}\n')
    assert main(["pair-gate", str(tmp_path / "p.jsonl"), "--kept", str(tmp_path / "kept")]) == 1
    assert main(["scorecard", "plain words without names"]) == 1 and main(["demo"]) == 0
    assert '"dropped"' in capsys.readouterr().out
    with pytest.raises(SystemExit) as e:
        main(["nothing"])
    assert e.value.code == 2


def test_entry_without_llm():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and "corpus_summary" in q
