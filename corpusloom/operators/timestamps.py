"""Stamps in many notations, made one unambiguous day or moment each.

All notations are compiled into one regular expression whose alternatives carry named groups. A stamp is matched
once; the groups come out as one row of components, which are checked against the calendar and put together by
integer day arithmetic. Only a named zone needs the zone tables of the JVM. Everything stays in generated code.

Defined cases: null, blank, coarse (year, month, quarter) and impossible stamps give null, as do clock times whose
zone is unknown and local times that the zone's clock skipped or passed twice. A slash date whose reading order is
unknown counts only if a single reading is possible. Fractions of a second are cut off; missing seconds are 00.
"""

from __future__ import annotations

import zoneinfo
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAME = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|"
    "nov(?:ember)?|dec(?:ember)?"
)
#: Minutes east of Greenwich of the abbreviations that stamps carry.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "SGT": 480, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600,
    "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
#: Steps in seconds by which clocks have been set back; a second reading of a local time lies one of them away.
FOLDS = (1200, 1800, 2400, 3600, 5400, 7200, 10800, 86400)

#: One alternative per notation of the day; the number ends the names of its groups.
DAY_FORMS = (
    r"(?<y1>\d{4})(?<sep>[-/.])(?<m1>\d{1,2})\k<sep>(?<d1>\d{1,2})",
    r"(?<y2>\d{4})(?<m2>\d{2})(?<d2>\d{2})(?:T(?<h2>\d{2})(?<n2>\d{2})(?:(?<s2>\d{2})(?:[.,]\d+)?)?)?",
    r"(?<d3>\d{1,2})\.(?<m3>\d{1,2})\.(?<y3>\d{4})",
    r"(?<a4>\d{1,2})/(?<b4>\d{1,2})/(?<y4>\d{4})",
    rf"(?<d5>\d{{1,2}})(?:st|nd|rd|th)?[ \-.]+(?<t5>{MONTH_NAME})\.?,?[ \-]+(?<y5>\d{{4}})",
    rf"(?<t6>{MONTH_NAME})\.?[ \-]+(?<d6>\d{{1,2}})(?:st|nd|rd|th)?,?[ \-]+(?<y6>\d{{4}})",
)
CLOCK = r"(?:(?:T|,?\s+|,)(?:at\s+)?(?<h7>\d{1,2}):(?<n7>\d{2})(?::(?<s7>\d{2})(?:[.,]\d+)?)?(?:\s*(?<p7>[ap])\.?m(?![a-z])\.?)?)?"
ZONE = (
    r"(?:\s*(?:(?:UTC|GMT)?(?<o8>[+-]\d{2}(?::?\d{2})?)|(?<z8>z|[a-z]{3,4})(?![a-z/])))?"
    r"(?:\s*(?:\[(?<r8>[a-z]+(?:[/_+\-][a-z0-9]+)*)\]|(?<r9>[a-z]+(?:/[a-z0-9_+\-]+)+)|\([a-z ]+\)))?"
)
STAMP = (
    r"(?i)^\s*(?:(?<e0>\d{10})|(?<x0>\d{13})|(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+)?"
    rf"(?:{'|'.join(DAY_FORMS)}){CLOCK}{ZONE})\s*$"
)
MARK = "\u0001"
#: Where each component comes from; groups of one component never match together.
COMPONENTS = {
    "y": ("y1", "y2", "y3", "y4", "y5", "y6"), "m": ("m1", "m2", "m3"), "t": ("t5", "t6"),
    "d": ("d1", "d2", "d3", "d5", "d6"), "a": ("a4",), "b": ("b4",), "h": ("h7",), "n": ("n7",), "s": ("s7",),
    "h2": ("h2",), "n2": ("n2",), "s2": ("s2",), "p": ("p7",), "o": ("o8",), "z": ("z8",), "r": ("r8", "r9"),
    "e": ("e0",), "x": ("x0",),
}
REPLACEMENT = MARK + MARK.join("".join(f"${{{g}}}" for g in groups) for groups in COMPONENTS.values()) + MARK


def _settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later expressions use as it is.

    The optimizer merges projections by putting expressions in place of names, which would copy the components
    exponentially often; it doesn't merge across a generator of one row.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _settled_all(df: DataFrame, name: str, **values: Column) -> DataFrame:
    """The same for several columns name_key at once."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(f"{name}_{k}") for k, v in values.items()]))))


def components(df: DataFrame, stamp: str, name: str) -> DataFrame:
    """Add an array of the stamp's components in the order of COMPONENTS, empty where absent; null if nothing matches."""
    # white space beyond ASCII around a stamp counts as blank too
    pattern = STAMP.replace(r"\s", "[\\s\u00a0\u2002\u2003\u2009\u202f\u3000\ufeff]")
    raw = name + "_raw"
    df = _settled(df, raw, F.regexp_replace(F.col(stamp), pattern, REPLACEMENT))
    return _settled(df, name, F.when(F.startswith(F.col(raw), F.lit(MARK)), F.split(F.col(raw), MARK))).drop(raw)


def _int(c: Column) -> Column:
    return F.when(c != "", c.cast("int"))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a Gregorian date by integer arithmetic; years from 1."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(yy / F.lit(400))
    yoe = yy - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, F.lit(-3)).otherwise(F.lit(9))) + 2) / F.lit(5)) + d - 1
    doe = yoe * 365 + F.floor(yoe / F.lit(4)) - F.floor(yoe / F.lit(100)) + doy
    return (era * 146097 + doe - 719468).cast("bigint")


def days_in_month(y: Column, m: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return (
        F.when(m.isin(1, 3, 5, 7, 8, 10, 12), 31).when(m.isin(4, 6, 9, 11), 30).when((m == 2) & leap, 29).when(m == 2, 28)
    )


def _real_day(y: Column, m: Column, d: Column) -> Column:
    return F.coalesce((y >= 1) & (m.between(1, 12)) & (d >= 1) & (d <= days_in_month(y, m)), F.lit(False))


def known_zones() -> list[str]:
    """Names that both the IANA tables here and the JVM take; the rest would raise in the JVM."""
    return sorted(z for z in zoneinfo.available_timezones() if "/" in z or z in ("UTC", "GMT"))


def normalize_stamps(df: DataFrame, stamp: str, order: str, zone: str, out: str = "norm") -> DataFrame:
    """Add column out: `YYYY-MM-DD` as written for a bare day, `YYYY-MM-DDTHH:MM:SSZ` in UTC for a moment, else null.

    order and zone name columns with the reading order (`mdy`, `dmy`) and the IANA zone that hold for the row.
    Works row by row, so it neither shuffles nor depends on the size of any group.
    """
    tmp = lambda n: f"__stamp_{n}"
    c = lambda n: F.get(F.col(tmp("c")), F.lit([*COMPONENTS].index(n) + 1))
    v = lambda n: F.col(tmp("v_" + n))
    df = components(df, stamp, tmp("c"))
    df = _settled_all(df, tmp("i"), a=_int(c("a")), b=_int(c("b")), y=_int(c("y")))
    a, b, y = (F.col(tmp("i_" + k)) for k in "aby")
    df = _settled_all(df, tmp("j"), mdy=_real_day(y, a, b), dmy=_real_day(y, b, a))
    mdy, dmy = F.col(tmp("j_mdy")), F.col(tmp("j_dmy"))
    slash = c("a") != ""
    month_first = (
        F.when(F.lower(F.col(order)) == "mdy", True)
        .when(F.lower(F.col(order)) == "dmy", False)
        .when(mdy & dmy & (a != b), F.lit(None))
        .otherwise(mdy)
    )
    df = _settled(df, tmp("f"), F.when(slash, month_first))
    month_first = F.col(tmp("f"))
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(c("t"), 1, 3))).cast("int")
    hour, half = _int(F.concat(c("h"), c("h2"))), F.lower(c("p"))
    twice = (c("h") != "") & (c("h2") != "")
    h24 = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    sign = F.when(F.startswith(c("o"), F.lit("-")), -1).otherwise(1)
    digits = F.regexp_replace(c("o"), "[^0-9]", "")
    off = sign * (_int(F.substring(digits, 1, 2)) * 60 + F.coalesce(_int(F.substring(digits, 3, 2)), F.lit(0)))
    abbr = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    df = _settled_all(
        df,
        tmp("v"),
        y=y,
        m=F.when(slash, F.when(month_first, a).when(~month_first, b)).when(c("t") != "", named).otherwise(_int(c("m"))),
        d=F.when(slash, F.when(month_first, b).when(~month_first, a)).otherwise(_int(c("d"))),
        timed=((c("h") != "") | (c("h2") != "")),
        h=F.when(~twice, h24),
        n=_int(F.concat(c("n"), c("n2"))),
        s=F.coalesce(_int(F.concat(c("s"), c("s2"))), F.lit(0)),
        off=F.when(c("o") != "", F.when((F.abs(off) <= 1080) & (F.abs(off) % 60 < 60), off))
            .when(c("z") != "", F.try_element_at(abbr, F.upper(c("z")))),
        fixed=((c("o") != "") | (c("z") != "")),
        zone=F.when(c("r") != "", c("r")).otherwise(F.col(zone)),
        epoch=F.when(c("e") != "", c("e").cast("bigint")).when(c("x") != "", F.floor(c("x").cast("bigint") / F.lit(1000))),
    )
    real = _real_day(v("y"), v("m"), v("d"))
    days = days_from_civil(v("y"), v("m"), v("d"))
    clock = F.coalesce(v("h").between(0, 23) & v("n").between(0, 59) & v("s").between(0, 59), F.lit(False))
    local = days * 86400 + v("h") * 3600 + v("n") * 60 + v("s")
    df = _settled(df, tmp("r"), real)
    df = _settled(df, tmp("l"), F.when(F.col(tmp("r")) & clock, local))
    zone_ok = v("zone").isin(*known_zones())
    df = _settled(df, tmp("z"), F.when(v("timed") & ~v("fixed") & zone_ok, v("zone")))
    at = F.timestamp_seconds(F.col(tmp("l")))
    df = _settled(df, tmp("u"), F.when(F.col(tmp("z")).isNotNull(), F.unix_seconds(F.to_utc_timestamp(at, F.col(tmp("z"))))))
    shown = lambda k: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(F.col(tmp("u")) + k), F.col(tmp("z"))))
    passed_twice = reduce(lambda p, q: p | q, [shown(s * k) == F.col(tmp("l")) for k in FOLDS for s in (1, -1)])
    once = (shown(0) == F.col(tmp("l"))) & ~passed_twice
    moment = (
        F.when(v("epoch").isNotNull(), v("epoch"))
        .when(v("timed") & v("fixed"), F.col(tmp("l")) - v("off") * 60)
        .when(v("timed"), F.when(once, F.col(tmp("u"))))
    )
    df = _settled(df, tmp("k"), moment)
    df = _settled(df, tmp("t"), F.floor(F.col(tmp("k")) / F.lit(86400)))
    day = F.col(tmp("t"))
    sec = F.col(tmp("k")) - day * 86400
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    norm = F.when(
        F.col(tmp("k")).isNotNull(),
        F.concat(
            F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM-dd"), F.lit("T"),
            two(F.floor(sec / F.lit(3600))), F.lit(":"), two(F.floor(sec / F.lit(60)) % 60), F.lit(":"), two(sec % 60), F.lit("Z"),
        ),
    ).when(
        ~v("timed") & F.col(tmp("r")) & v("epoch").isNull() & ~v("fixed"),
        F.concat(F.lpad(v("y").cast("string"), 4, "0"), F.lit("-"), two(v("m")), F.lit("-"), two(v("d"))),
    )
    df = df.withColumn(out, norm)
    return df.drop(*[x for x in df.columns if x.startswith(tmp(""))])
