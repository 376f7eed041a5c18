"""DuckDB spellings of the text primitives, for the oracle queries."""

from __future__ import annotations

from corpusloom.functions import text as T

WS, NOT_WS, LINE_END = (x.replace(r"\x0b", r"\v") for x in (T.WS, T.NOT_WS, T.LINE_END))


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def body(t: str) -> str:
    return f"coalesce({t},'')"


def trim_all(t: str) -> str:
    return f"regexp_replace({t}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def every(t: str, pattern: str) -> str:
    return f"regexp_extract_all({t}, {q(pattern)})"


def count(t: str, pattern: str) -> str:
    return f"len({every(t, pattern)})"


def words(t: str) -> str:
    return every(body(t), T.WORD)


def guard_words(t: str) -> str:
    return every(f"replace(lower({body(t)}), '’', '''')", r"[a-z0-9]+(?:'[a-z0-9]+)?")


def sentence_words(t: str) -> str:
    marked = f"regexp_replace({trim_all(body(t))}, {q(f'([.!?…]){WS}+')}, '\\1' || chr(10), 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({marked}, '\\n+'), lambda s: {count('s', T.WORD)}), lambda n: n > 0)"


def lines(t: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({trim_all(body(t))}, {q(LINE_END)}), lambda s: {trim_all('s')}), lambda s: s <> '')"


def paragraphs(t: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({trim_all(body(t))}, {q(f'\\n{WS}*\\n')}), lambda s: {trim_all('s')}), lambda s: s <> '')"


def short_line_ratio(t: str) -> str:
    ls = lines(t)
    return f"(case when len({ls}) = 0 then 0.0 else len(list_filter({ls}, lambda s: {count('s', T.WORD)} <= {T.SHORT_LINE})) / len({ls})::double end)"


def median_of(a: str) -> str:
    return f"coalesce(list_aggregate({a}, 'median')::double, 0.0)"


def nearest_rank(a: str, f: float) -> str:
    return f"coalesce(list_sort({a})[(round_even({f}::double*(len({a})-1),0))::int + 1]::double, 0.0)"


def slop_score(t: str) -> str:
    return "(" + "+".join(f"regexp_matches(lower({body(t)}), {q(p)})::int" for p in T.SLOP) + ")"


def scaffolding_count(t: str) -> str:
    return "(" + "+".join(f"regexp_matches({body(t)}, {q(p)})::int" for p in T.SCAFFOLDING) + ")"


def contraction_rate(t: str) -> str:
    n = count(body(t), T.WORD)
    return f"(case when {n} = 0 then 0.0 else {count(body(t), T.CONTRACTION)} / {n}::double end)"


def grams(tokens: str, n: int) -> str:
    return f"list_transform(generate_series(1, len({tokens})-{n - 1}), lambda i: array_to_string({tokens}[i:i+{n - 1}], ' '))"


# Below, patterns are written out by hand instead of taken from the implementation, so that a wrong constant there shows.
SEP, SPACE = r"[^\p{L}\p{N}_]", r"[\s\v\x1c-\x1f\x{85}\p{Z}]"


def name_count(t: str) -> str:
    """Proper-noun proxies. Separators are doubled, so that neighbours needn't share one: this dialect has no lookaround."""
    doubled = f"regexp_replace({t}, '({SEP})', '\\1\\1', 'g')"
    whole = lambda p: f"len(regexp_extract_all({doubled}, {q(f'(?:^|{SEP}){p}(?:$|{SEP})')}))"
    toks = f"regexp_split_to_array({t}, '{SPACE}+')"
    plain = (
        "the a an and or but if when where what why how who this that these those then than for with from into onto over under after before because while although however "
        "therefore meanwhile also just only even still already here there was were are is be been being have has had do does did will would could should may might must can add "
        "most many some every each all none no not yes you your yours i we they he she it its our their"
    )
    word = "regexp_extract(w.k[i], '^([A-Z][a-zA-Z0-9''-]*[a-zA-Z0-9])(?:[^\\p{L}\\p{N}_]|$)', 1)"
    stop = "string_split('" + plain + "', ' ')"
    ok = f"regexp_matches(w.k[i-1], '[a-z0-9,;:\"''”’)\\]]$') and {word} <> '' and {word} <> upper({word}) and not list_contains({stop}, lower({word}))"
    inner = f"list_sum(list_transform([{{'k': {toks}}}], lambda w: len(list_filter(generate_series(2, greatest(len(w.k), 1)), lambda i: {ok}))))"
    return f"({whole('[A-Z]{2,}')} + {whole('[A-Z](?:&&[A-Z])+')} + {whole(f'[A-Z][a-z]+(?:{SPACE}+[A-Z][a-z]+)+')} + coalesce({inner}, 0))::int"


def axes(src: str, key: str, col: str) -> str:
    """A query: one row of axes for each row of src, under key columns."""
    t = trim_all(body("x"))
    return (
        f"(select {key}, words, names, round(names*1000::double/greatest(words,1),2) as proper_per_1k, round(med,2) as med, round(short,4) as short, you, i, "
        f"round(you*1000::double/greatest(words,1),2) as you_per_1k, round(i*1000::double/greatest(words,1),2) as i_per_1k, you > i as you_gt_i from "
        f"(select {key}, {count('t', '[A-Za-z0-9' + chr(39) + ']+')} as words, {name_count('t')} as names, {median_of(sentence_words('t'))} as med, {short_line_ratio('t')} as short, "
        f"len(regexp_extract_all(t, '(?i)\\byou\\b')) as you, len(regexp_extract_all(t, '\\bI\\b')) as i from (select {key}, {t} as t from (select {key}, {col} as x from {src}))))"
    )


#: Phrases that go and words that replace showy ones, in their order.
TELL_STEPS = (
    (r"(?is)\b(?:moreover|furthermore|additionally)[, ]+[^.?!]{0,120}?(?:testament to(?:\s+vibrant)?|unlock(?:ing)?\s+nestled|leverage(?:\s+robust)?\s+synergies)[^.?!]*[.?!]\s*", ""),
    (r"(?is)\bunlock(?:ing)?\s+nestled\s+opportunities\s+is\s+a\s+testament\s+to\s+vibrant\s+\w+[^.?!]*[.?!]\s*", ""),
    (r"(?i)\bIn today's (?:fast-paced\s+)?(?:digital\s+)?(?:fast-paced\s+)?(?:digital\s+)?(?:world|landscape),?\s*", ""), (r"(?i)\bIt is important to note that\s*", ""),
    (r"(?i)\bMoreover,\s*furthermore,?\s*", ""), (r"(?i)\bMoreover,\s*", ""), (r"(?i)\bFurthermore,\s*", ""), (r"(?i)\bAdditionally,\s*", ""),
    (r"(?i)\bleverage(?:\s+robust)?\s+synergies\b", "make real connections"), (r"(?i)\bunlock(?:ing)?\s+nestled\s+opportunities\b", "find real opportunities"),
    (r"(?i)\ba testament to\s+vibrant\s+\w+\b", ""), (r"(?i)\ba testament to\s+", ""), (r"(?i)\bdelve into\b", "talk about"), (r"(?i)\butilize\b", "use"), (r"(?i)\bleverage\b", "use"),
    (r"(?i)\brobust\b", "real"), (r"(?i)\bsynergies\b", "connections"), (r"(?i)\bsynergias\b", "connections"), (r"(?i)\bunlock(?:ing)?\b", "find"), (r"(?i)\bnestled\b", ""),
    (r"(?i)\bvibrant\b", ""), (r"(?i)\bis\s+(?:innovation|excellence)\b", ""), (r"(?i)\bfind real opportunities\s+is\b", "find real opportunities"),
    (r"[\t\v\f\x1c-\x1f\x{85}\p{Zs} ]{2,}", " "), (r"[ \t]+\n", r"\n"), (r"\n{3,}", r"\n\n"), (rf"{SPACE}+([,.])", r"\1"),
)


def strip_tells(t: str) -> str:
    for p, r in TELL_STEPS:
        t = f"regexp_replace({t}, {q(p)}, " + (f"chr(10){'||chr(10)' * (r.count(chr(92) + 'n') - 1)}" if r.startswith("\\n") else q(r)) + ", 'g')"
    t = trim_all(f"regexp_replace({t}, '^[ \\t,;]+|[ \\t,;]+$', '', 'g')")
    return f"list_aggregate(list_transform([{t}], lambda s: upper(s[1:1]) || s[2:]), 'min')"


def normalized(t: str) -> str:
    """The cleaned text: block tags are breaks, others nothing, chunks between tags are stripped; quotes around lines go."""
    lf = f"regexp_replace({body(t)}, '\\r\\n|\\r', chr(10), 'g')"
    blocks = "address|article|aside|blockquote|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
    cut = f"regexp_replace(regexp_replace({lf}, '(?i)</?(?:{blocks})(?:\\s[^>]*)?/?>', chr(2)||chr(3)||chr(2), 'g'), '</?[a-zA-Z][^>]*>', chr(2), 'g')"
    cut = f"replace({cut}, '<', chr(2)||'<'||chr(2))"  # a stray one is a chunk of its own
    page = f"replace(list_aggregate(list_transform(string_split({cut}, chr(2)), lambda s: {trim_all('s')}), 'string_agg', ''), chr(3), chr(10)||chr(10))"
    src = f"(case when regexp_matches({lf}, '</?[a-zA-Z][^>]*>|<style') then {page} else {lf} end)"
    line = f"{trim_all('s')}"
    bare = trim_all(f"regexp_replace(regexp_replace({line}, '^[\"“”]', ''), '[\"“”]$', '')")
    rows = f"list_transform(list_transform(string_split(replace({src}, chr(92)||'\"', '\"'), chr(10)), lambda s: {bare}), lambda s: case when regexp_matches(s, '^[\"“”]+$') then '' else s end)"
    return trim_all(f"regexp_replace(array_to_string({rows}, chr(10)), '\\n{{3,}}', chr(10)||chr(10), 'g')")


def duplicate_key(t: str) -> str:
    return f"replace(lower({trim_all(f'regexp_replace({normalized(t)}, {q(SPACE + chr(43))}, chr(32), {q(chr(103))})')}), 'ß', 'ss')"


#: Marks that only a prompt has.
MARK_SQL = (
    ("block_separator", r"(?m)^\s*(?:-{3,}|\*{3,}|={3,}|—{2,})\s*$"), ("brief_header", r"(?im)^\s*BRIEF\s*:"), ("examples_header", r"(?im)^\s*EXAMPLES\b.*:"),
    ("placeholder", r"\[[A-Z][A-Z0-9_ /-]{2,}\]|<[A-Z][A-Z0-9_ /-]{2,}>"), ("write_instruction", r"(?i)write the post now"),
)


def markers(t: str) -> str:
    return "list_filter([" + ", ".join(f"case when regexp_matches({body(t)}, {q(p)}) then '{k}' end" for k, p in MARK_SQL) + "], lambda m: m is not null)"
