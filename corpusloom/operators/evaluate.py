"""Paired evaluation: distances, arms, sign test, verdicts, carves, receipts. Text generation is an injected callable."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import guards, rewrite
from corpusloom.runtime import written

#: Units of the axes in a distance, and the distance below which arms tie.
UNITS = {"short_line_ratio": 1.0, "median_sentence_words": 20.0, "proper_per_1k": 50.0, "you_per_1k": 20.0, "i_per_1k": 20.0}
EPSILON, ALPHA = 0.05, 0.05


def axis_distance(a: Column, b: Column) -> Column:
    """Differences of two axes structs in their units, of which pronoun leads, and of the logarithms of their lengths; four digits."""
    parts = [F.abs(a[k] - b[k]) / F.lit(w) for k, w in UNITS.items()]
    lead = F.abs(a["you_gt_i"].cast("int") - b["you_gt_i"].cast("int"))
    length = F.abs(F.log(F.greatest(a["words"], F.lit(1)) / F.greatest(b["words"], F.lit(1)).cast("double")))
    return F.round(sum(parts[1:], parts[0]) + lead + length, 4)


def winner(left: Column, right: Column, left_out: Column, right_out: Column) -> Column:
    """Disqualification decides first, then distance beyond epsilon, else a tie."""
    return (
        F.when(left_out & right_out, "tie").when(left_out, "right").when(right_out, "left")
        .when(left < right - EPSILON, "left").when(right < left - EPSILON, "right").otherwise("tie")
    )


def sign_test(wins: Column, losses: Column) -> Column:
    """One-sided binomial tail, ties left out, four digits; 1 without decisive items. The tail is summed by its recurrence in logarithms."""
    n = wins + losses
    log_c = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda s, i: s + F.when(k > 0, F.log((n - k + i) / i.cast("double"))).otherwise(0.0))
    terms = F.transform(F.sequence(wins, n), lambda k: F.exp(log_c(k) - n * F.log(F.lit(2.0))))
    return F.when(n == 0, 1.0).otherwise(F.round(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), 4))


def tally(arms: DataFrame) -> DataFrame:
    """One row for arms(holdout_id, arm, distance, disqualified) with arms a and b."""
    side = lambda s: arms.where(F.col("arm") == s).select("holdout_id", F.col("distance").alias(s), F.col("disqualified").alias(s + "_out"))
    w = side("a").join(side("b"), "holdout_id").withColumn("winner", winner(F.col("a"), F.col("b"), F.col("a_out"), F.col("b_out")))
    return w.agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("winner") == "left").alias("wins"), F.count_if(F.col("winner") == "right").alias("losses"),
        F.count_if(F.col("winner") == "tie").alias("ties"), F.count_if("a_out").alias("a_out"), F.count_if("b_out").alias("b_out"),
        F.count_if(F.col("a_out") & F.col("b_out")).alias("both_out"),
    )


def verdict(t: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """keep or archive, with all reasons against."""
    p = sign_test(F.col("wins").cast("int"), F.col("losses").cast("int"))
    t = t.withColumn("p_value", p)
    reasons = F.array_compact(F.array(
        F.when(F.col("wins") <= F.col("losses"), F.lit("no_majority")), F.when(F.col("p_value") > alpha, F.lit("not_beyond_chance")),
        F.when(F.col("a_out") > F.col("b_out"), F.lit("disqualified_more_often")), F.when((F.col("items") > 0) & (F.col("both_out") == F.col("items")), F.lit("all_disqualified")),
    ))
    return t.withColumn("reasons", reasons).withColumn("verdict", F.when(F.size("reasons") == 0, "keep").otherwise("archive"))


def article_verdict(t: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """voice_supported or not_supported for a tally of articles (arm a) against a control (arm b), with all reasons against."""
    t = t.withColumn("p_value", sign_test(F.col("wins").cast("int"), F.col("losses").cast("int")))
    undecided = (F.col("items") > 0) & (F.col("both_out") >= F.col("items"))
    reasons = F.array_compact(F.array(
        F.when(undecided, F.lit("every_item_disqualified")), F.when(F.col("wins") <= F.col("losses"), F.lit("no_majority")), F.when(F.col("p_value") > alpha, F.lit("not_beyond_chance")),
        F.when(F.col("a_out") > F.col("b_out"), F.lit("disqualified_more_often")),
    ))
    return t.withColumns({"distance_decided": ~undecided, "reasons": reasons}).withColumn("verdict", F.when(F.size("reasons") == 0, "voice_supported").otherwise("not_supported"))


def sweep(verdicts: DataFrame, order: str = "checkpoint") -> DataFrame:
    """Rows of verdicts(checkpoint, verdict, ...) up to the first that is kept, oldest first, with `kept`; later ones count as not evaluated."""
    first = F.min(F.when(F.col("verdict") == "keep", F.col(order))).over(Window.partitionBy(F.lit(1)))  # one row per checkpoint
    rows = verdicts.withColumn("__first", first).where(F.col("__first").isNull() | (F.col(order) <= F.col("__first")))
    return rows.withColumn("kept", F.coalesce(F.col(order) == F.col("__first"), F.lit(False))).drop("__first")


def score(holdout: Column, draft: Column, facts: Column, exemplar: Column, shown: Column | None = None) -> Column:
    """Distance of a draft from its holdout, and the guards that disqualify it: copies, echoes of what was shown, inventions beyond facts."""
    from corpusloom.operators.drafting import sentence_case

    x = guards.invented(facts, sentence_case(draft))
    parrot, echo = guards.parrot_reject(draft, exemplar), guards.brief_echo(draft, facts if shown is None else shown)
    return F.struct(
        axis_distance(T.axes(holdout), T.axes(draft)).alias("distance"), parrot.alias("parrot"), echo.alias("echo"), (~x["passed"]).alias("invented"),
        F.size(x["names"]).alias("invented_names"), F.size(x["figures"]).alias("invented_figures"), (parrot | echo | ~x["passed"]).alias("disqualified"),
    )


def brief_guard(points: Column, text: Column, most: float = 0.25) -> Column:
    """(ok, reason): a brief must not be the text itself, nor return more than a share of its words."""
    t, b = T.guard_words(text), T.guard_words(points)
    n = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    both = F.aggregate(F.array_distinct(b), F.lit(0), lambda s, w: s + F.least(n(b, w), n(t, w)))
    share = both / F.greatest(F.size(t), F.lit(1))
    reason = F.when(T.trim_all(T.body(points)) == T.trim_all(T.body(text)), "verbatim").when(share > most, "too_close")
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"), F.round(share, 4).alias("overlap"))


def holdouts(pieces: DataFrame, ids: DataFrame) -> DataFrame:
    """The pieces of ids(id), in the order of their ids; an id without a piece fails."""
    from pyspark.sql.functions import raise_error

    got = ids.select("id").distinct().join(pieces.withColumn("__there", F.lit(True)), "id", "left")
    there = F.when(F.col("__there").isNull(), raise_error(F.concat(F.lit("no piece "), F.col("id")))).otherwise(F.col("id"))
    return got.withColumn("id", there).drop("__there").select(*pieces.columns).orderBy("id")


def run_arms(held: DataFrame, make_a: Callable[[], Generate], make_b: Callable[[], Generate], kind: str = "post", most_words: int = 550) -> DataFrame:
    """Receipts (holdout_id, arm, distance, flags, disqualified) of both arms for held(id, text, exemplar): brief mined, drafts trimmed alike.

    Arm a sees the exemplar, arm b doesn't. Posts are checked against the whole source, articles against the brief they
    were given. Holdouts that give no brief are left out.
    """
    mine = rewrite.post_brief if kind == "post" else rewrite.article_brief
    rows = rewrite.normalized(held, "text", "source").withColumn("b", mine(F.col("source"))).where("b.ok")
    shown = F.concat(F.lit("Topic: "), F.col("b.topic"), F.lit("\nPoints: "), F.array_join("b.points", "\n"))
    rows = rows.select(F.col("id").alias("holdout_id"), "source", "exemplar", shown.alias("brief"))
    trim = rewrite.by_text(lambda t: rewrite.trim_words(rewrite.drop_repeats(t), most_words), "string")
    out = None
    for arm, make, sample in (("a", make_a, F.concat(F.lit("\n\nStyle sample:\n"), rewrite.by_text(rewrite.masked, "string")(F.col("exemplar")))), ("b", make_b, F.lit(""))):
        d = generated(rows.withColumn("prompt", F.concat(F.col("brief"), sample)), "prompt", "draft", make).withColumn("draft", trim(F.col("draft")))
        facts = F.col("source") if kind == "post" else F.col("brief")
        s = d.select("holdout_id", F.lit(arm).alias("arm"), F.explode(F.array(score(F.col("source"), F.col("draft"), facts, F.col("exemplar"), F.col("brief")))).alias("s")).select("holdout_id", "arm", "s.*")
        out = s if out is None else out.unionByName(s)
    return out


def carve_size(pool: Column) -> Column:
    """A quarter of the pool, 12 to 24, but not more than there are."""
    return F.least(pool, F.least(F.lit(24), F.greatest(F.lit(12), F.bround(pool * 0.25)))).cast("int")


def article_carve_size(briefable: Column, total: Column) -> Column:
    want = F.least(F.lit(5), F.greatest(F.lit(4), F.bround(briefable * 0.3)))
    return F.greatest(F.lit(0), F.least(want, briefable, total - 5)).cast("int")


def order_key(ids: pd.Series) -> pd.Series:
    return ids.map(lambda x: hashlib.blake2b(str(x).encode(), digest_size=8).hexdigest())


def carve(pool: DataFrame, n: int, pinned: DataFrame | None = None) -> DataFrame:
    """n ids: pinned ones first, then by the hash of the id, whatever the order of the rows."""
    rows = pool.select("id").distinct()
    rows = rows.withColumn("pin", F.lit(1)) if pinned is None else rows.join(pinned.select("id").distinct().withColumn("pin", F.lit(0)), "id", "left").fillna(1, ["pin"])
    return rows.withColumn("k", F.pandas_udf(order_key, "string")(F.col("id"))).orderBy("pin", "k").limit(n).select("id")


Generate = Callable[[str], str]


def generated(df: DataFrame, prompt: str, out: str, make: Callable[[], Generate]) -> DataFrame:
    """Add drafts. make() runs once per partition, so a model is loaded once per task."""
    schema = df.select("*", F.lit("").alias(out)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make()
        for b in batches:
            yield b.assign(**{out: [f(p) for p in b[prompt]]})

    return df.mapInPandas(run, schema)


def write_posts(briefs: DataFrame, exemplars: DataFrame, make: Callable[[], Generate], most_words: int = 550) -> DataFrame:
    """Receipts for briefs(holdout_id, brief) beside exemplars(holdout_id, exemplar): the draft is trimmed and guarded.

    One that fails is drafted once more, told what to leave out; one that fails again is withheld. exemplars may come
    from drafting.retrieved().
    """
    e = exemplars.select("holdout_id", F.col("exemplar"))
    rows = briefs.select("holdout_id", "brief").join(e, "holdout_id", "left").withColumn("exemplar", F.coalesce("exemplar", F.lit("")))
    ask = F.concat(F.lit("BRIEF:\n"), F.col("brief"), F.lit("\n\nStyle sample:\n"), rewrite.by_text(rewrite.masked, "string")(F.col("exemplar")))
    trim = rewrite.by_text(lambda t: rewrite.trim_words(rewrite.drop_repeats(t), most_words), "string")

    def attempt(df: DataFrame, n: int) -> DataFrame:
        d = generated(df, "prompt", "draft", make).withColumn("draft", trim(F.col("draft")))
        x = guards.invented(F.col("brief"), F.col("draft"))
        flags = F.struct(
            guards.parrot_reject(F.col("draft"), F.col("exemplar")).alias("parrot"), guards.brief_echo(F.col("draft"), F.col("brief")).alias("echo"), (~x["passed"]).alias("invented"),
            F.concat(x["names"], x["figures"]).alias("found"),
        )
        d = d.select("holdout_id", "brief", "exemplar", F.size(T.words(F.col("draft"))).alias("words"), F.explode(F.array(flags)).alias("f"))
        return written(d.withColumns({"attempts": F.lit(n), "withheld": F.col("f.parrot") | F.col("f.echo") | F.col("f.invented")}), f"attempt-{n}")

    one = attempt(rows.withColumn("prompt", ask), 1)
    more = F.concat(ask, F.lit("\n\nLeave out: "), F.array_join("f.found", ", "), F.lit("\nSay it in other words."))
    two = attempt(one.where("withheld").select("holdout_id", "brief", "exemplar", more.alias("prompt")), 2)
    d = one.where("not withheld").unionByName(two)
    return d.select("holdout_id", "attempts", "words", "f.parrot", "f.echo", "f.invented", "withheld")


def safe_receipt(df: DataFrame, banned: tuple[str, ...] = ("text", "body", "draft", "prompt", "exemplar", "messages", "output", "input")) -> DataFrame:
    """df if no field anywhere in its schema carries body text; else an error."""

    def names(t) -> Iterator[str]:
        for f in getattr(t, "fields", ()):
            yield f.name
            yield from names(f.dataType)
        for inner in ("elementType", "valueType"):
            if hasattr(t, inner):
                yield from names(getattr(t, inner))

    if bad := sorted(set(names(df.schema)) & set(banned)):
        raise ValueError(f"a receipt must not hold {', '.join(bad)}")
    return df


def checked_receipt(df: DataFrame, banned: tuple[str, ...]) -> DataFrame:
    """df if it is safe by its fields and no value holds a banned word, whatever its case; a row that does fails."""
    blob = F.lower(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    hit = F.lit(None).cast("string")
    for w in banned:
        hit = F.coalesce(hit, F.when(blob.contains(w.lower()), F.lit(w)))
    first = df.columns[0]
    safe = F.when(hit.isNotNull(), F.raise_error(F.concat(F.lit("a receipt leaks "), hit)).cast(df.schema[first].dataType)).otherwise(F.col(f"`{first}`"))
    return safe_receipt(df).withColumn(first, safe)
