"""Text patterns of headings, captions and references, as functions from Column to Column and as SQL text.

Patterns are written so that both engines read them alike: no lookaround, explicit word edges.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x00\x0b"
BULLETS = "•·–—\t "
MOST_HEADING = 120
# Titles and abbreviations that begin a sentence, not a numbered heading.
NOT_HEADINGS = (
    "M.", "MM.", "Mme", "Mlle", "Dr", "Pr", "Me", "Mr", "Mrs", "Ms",
    "cf.", "art.", "al.", "p.", "pp.", "fig.", "env.", "réf.",
)
# Pattern, level, kind, reliable; the first that fits decides.
NUMBERINGS = (
    (r"^\d+(?:\.\d+){3}[.)\s]", 4, "decimal", True),
    (r"^\d+(?:\.\d+){2}[.)\s]", 3, "decimal", True),
    (r"^\d+\.\d+[.)\s]", 2, "decimal", True),
    (r"^\d+\.\s", 1, "decimal", True),
    (r"^\d+\)\s", 1, "enumerated", False),
    (r"^(?:CHAPITRE|PARTIE|TITRE)\s+[IVXLCDM\d]+", 1, "keyword", True),
    (r"^(?:INTRODUCTION|CONCLUSION|RESUME|RÉSUMÉ|ABSTRACT|SOMMAIRE|REMERCIEMENTS|DEDICACE|DÉDICACE)(?:[^\p{L}\p{N}_]|$)", 1, "keyword", True),
    (r"^(?:BIBLIOGRAPHIE|ANNEXES?|GLOSSAIRE)(?:[^\p{L}\p{N}_]|$)", 1, "keyword", True),
    (r"^[IVXLCDM]+[.)]\s", 1, "roman", True),
    (r"^[A-Z][.)]\s", 2, "alpha", False),
)
SENTENCE_END = r"[.!?]\s*$"
# Keyword of a caption and its category.
CAPTION_WORDS = (("légende", "figure"), ("legende", "figure"), ("figure", "figure"), ("tableau", "table"), ("annexe", "annexe"), ("planche", "planche"))
CAPTION = r"(?is)^(légende|legende|figure|tableau|annexe|planche)\s+(\d+|[a-z])(.*)$"
CAPTION_BARE = r"(?is)^(légende|legende|figure|tableau|annexe|planche)\s*[:.\-–—]\s*\S"
SEPARATOR = r"^[:.\-–—]\s*"
LIST_ENTRY_START = r"(?i)^(?:figure|tableau|annexe|planche)\s+"
LIST_ENTRY_END = r"(?:\.{2,}|\t|\x{00A0}| {2,})\s*(?:\d{1,4}|[ivxlcdmIVXLCDM]{1,6})\.?$"
PAGE_END = r"(?:\t|\x{00A0}| {2,})(?:\d{1,3}|[ivxlcdmIVXLCDM]{1,6})\.?$"
PAGE_STRIP = r"[\t\s]+(?:\d{1,3}|[ivxlcdm]{1,6})\.?$"
EDGE_L, EDGE_R = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"
# Words that make a text a sentence, and those that speak against a heading.
SENTENCE_WORDS = (
    "est|sont|était|étaient|sera|seront|a été|ont été|permet|permettent|doit|doivent|peut|peuvent|nous|vous|il|elle|ils|elles|ce|cette|ces"
)
AGAINST_WORDS = "est|sont|était|étaient|a été|ont été|permet|permettent|doit|doivent|nous|nous avons"
# A reference to a caption; what follows it isn't part of it, so that it may begin the next.
REFERENCE_START = r"(?:^|[^\p{L}\p{N}_])((?i:figure|tableau|annexe|planche)\s+(?:\d+|[A-Z]))"
REFERENCE_AFTER = r"[^a-zA-Z\p{L}'’\d]|$"
REFERENCE = f"{REFERENCE_START}(?={REFERENCE_AFTER})"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` a bound variable: it is computed once, and the expression stays small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(text: Column, chars: str = BLANKS) -> Column:
    return F.btrim(text, F.lit(chars))


def ltrimmed(text: Column, chars: str = BLANKS) -> Column:
    return F.ltrim(text, F.lit(chars))


def heading_number(text: Column) -> Column:
    """struct(level, kind, reliable, matched), null where a text is not numbered."""
    return let(ltrimmed(ltrimmed(text), BULLETS), numbering_of)


def numbering_of(t: Column) -> Column:
    none = F.lit(None).cast("struct<level:int,kind:string,reliable:boolean,matched:string>")
    found = none
    for pattern, level, kind, reliable in reversed(NUMBERINGS):
        matched = F.regexp_extract(t, pattern, 0)
        rest = trimmed(F.substring(t, F.length(matched) + 1, F.length(t)))
        fits = t.rlike(pattern)
        if kind != "keyword":
            fits = fits & (F.length(rest) >= (4 if kind == "alpha" else 2))
        if not reliable:
            fits = fits & ~rest.rlike(SENTENCE_END)
        value = F.struct(
            F.lit(level).alias("level"), F.lit(kind).alias("kind"), F.lit(reliable).alias("reliable"), matched.alias("matched")
        )
        found = F.when(fits, value).otherwise(found)
    barred = (t == "") | (F.length(t) > MOST_HEADING)
    for prefix in NOT_HEADINGS:
        barred = barred | t.startswith(prefix + " ")
    # One pattern for all: most texts have no number and go no further.
    numbered = t.rlike("|".join(f"(?:{pattern})" for pattern, *_ in NUMBERINGS))
    return F.when(~barred & numbered, found)


def heading_number_sql(text: str, field: str) -> str:
    """One field of T8 as SQL; ``text`` is a column."""
    t = f"ltrim(ltrim({text}, {quoted(BLANKS)}), {quoted(BULLETS)})"
    cases = []
    for pattern, level, kind, reliable in NUMBERINGS:
        rest = f"trim(substr({t}, length(regexp_extract({t}, {quoted(pattern)}, 0)) + 1), {quoted(BLANKS)})"
        cond = f"regexp_matches({t}, {quoted(pattern)})"
        if kind != "keyword":
            cond += f" and length({rest}) >= {4 if kind == 'alpha' else 2}"
        if not reliable:
            cond += f" and not regexp_matches({rest}, {quoted(SENTENCE_END)})"
        value = {"level": level, "kind": f"'{kind}'", "reliable": str(reliable).lower(), "matched": f"regexp_extract({t}, {quoted(pattern)}, 0)"}[field]
        cases.append(f"when {cond} then {value}")
    barred = " or ".join([f"{t} = ''", f"length({t}) > {MOST_HEADING}", *(f"starts_with({t}, {quoted(p + ' ')})" for p in NOT_HEADINGS)])
    return f"(case when {text} is null or {barred} then null {' '.join(cases)} end)"


def quoted(x: str) -> str:
    """SQL literal for DuckDB; control characters by code."""
    parts, out = [], ""
    for c in x:
        if ord(c) < 32:
            parts += [f"'{out}'"] * bool(out) + [f"chr({ord(c)})"]
            out = ""
        else:
            out += "''" if c == "'" else c
    parts += [f"'{out}'"] * bool(out or not parts)
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def category_of(word: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, category in CAPTION_WORDS:
        found = F.when(F.lower(word) == name, category).otherwise(found)
    return found


def caption(text: Column) -> Column:
    """struct(category, number, source, label), null where a text is no caption.

    The number is digits or one upper-case letter; what follows begins with a separator.
    """
    return let(ltrimmed(text), caption_of)


def caption_of(t: Column) -> Column:
    word, number = F.regexp_extract(t, CAPTION, 1), F.regexp_extract(t, CAPTION, 2)
    rest = trimmed(F.regexp_extract(t, CAPTION, 3))
    fits = t.rlike(CAPTION) & number.rlike(r"^(?:\d+|[A-Z])$") & ((rest == "") | rest.rlike(SEPARATOR))
    value = F.struct(
        category_of(word).alias("category"), number.alias("number"),
        F.when(number.rlike(r"^\d+$"), "arabic").otherwise("letter").alias("source"),
        trimmed(F.regexp_replace(rest, SEPARATOR, "")).alias("label"),
    )
    return F.when(fits, value)


def caption_sql(text: str, field: str) -> str:
    t = f"ltrim({text}, {quoted(BLANKS)})"
    group = lambda i: f"regexp_extract({t}, {quoted(CAPTION)}, {i})"
    rest = f"trim({group(3)}, {quoted(BLANKS)})"
    words = " ".join(f"when '{w}' then '{c}'" for w, c in CAPTION_WORDS)
    value = {
        "category": f"case lower({group(1)}) {words} end", "number": group(2),
        "source": f"case when regexp_matches({group(2)}, '^\\d+$') then 'arabic' else 'letter' end",
        "label": f"trim(regexp_replace({rest}, {quoted(SEPARATOR)}, ''), {quoted(BLANKS)})",
    }[field]
    fits = f"regexp_matches({t}, {quoted(CAPTION)}) and regexp_matches({group(2)}, '^(?:\\d+|[A-Z])$') and ({rest} = '' or regexp_matches({rest}, {quoted(SEPARATOR)}))"
    return f"(case when {fits} then {value} end)"


def caption_without_number(text: Column) -> Column:
    """Category of a caption that has no number, else null."""
    t = ltrimmed(text)
    return F.when(t.rlike(CAPTION_BARE), category_of(F.regexp_extract(t, CAPTION_BARE, 1)))


def is_list_entry(text: Column) -> Column:
    """Is it a line of a list of figures or tables?"""
    t = trimmed(text)
    return t.rlike(LIST_ENTRY_START) & t.rlike(LIST_ENTRY_END)


def list_entry_sql(text: str) -> str:
    t = f"trim({text}, {quoted(BLANKS)})"
    return f"(regexp_matches({t}, {quoted(LIST_ENTRY_START)}) and regexp_matches({t}, {quoted(LIST_ENTRY_END)}))"


def cross_references(text: Column) -> Column:
    """array<struct<category, number, matched, position>> of the references in a text, in order; positions from 0."""
    pattern = F.lit(REFERENCE)

    def located(found: Column) -> Column:
        whole, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, REFERENCE)
        both = F.struct(whole.alias("whole"), between.alias("between"))
        return let(both, lambda b: placed(found, b))

    def placed(found: Column, b: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

        def step(s: Column, i: Column) -> Column:
            end = s["at"] + F.length(F.get(b["between"], i)) + F.length(F.get(b["whole"], i))
            return F.struct(end.alias("at"), F.array_append(s["out"], end - F.length(F.get(found, i))).alias("out"))

        spots = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step)["out"]
        return F.zip_with(found, spots, lambda m, at: F.struct(
            category_of(F.regexp_extract(m, r"^(\S+)\s", 1)).alias("category"), F.regexp_extract(m, r"(\d+|[A-Z])$", 1).alias("number"),
            m.alias("matched"), at.alias("position"),
        ))

    none = F.array().cast("array<struct<category:string,number:string,matched:string,position:int>>")
    return let(F.regexp_extract_all(text, pattern, F.lit(1)), lambda found: F.when(F.size(found) > 0, located(found)).otherwise(none))


def references_sql(source: str) -> str:
    """T12 as SQL over rows (doc_id, pos, text). The dialect has no lookahead: each mark between words is doubled, so that
    a reference may take one and leave one, and counted as half."""
    mark, pattern = quoted(r"[^\p{L}\p{N}_]"), quoted(f"{REFERENCE_START}(?:{REFERENCE_AFTER})")
    words = " ".join(f"when '{w}' then '{c}'" for w, c in CAPTION_WORDS)
    single = "replace(replace(replace(m, '  ', ' '), chr(9) || chr(9), chr(9)), chr(10) || chr(10), chr(10))"
    return f"""with d as (select doc_id, pos, regexp_replace(text, {quoted(r"([^\p{L}\p{N}_])")}, '\\1\\1', 'g') as t from {source}),
      f as (select doc_id, pos, regexp_extract_all(t, {pattern}, 1) as found, regexp_extract_all(t, {pattern}, 0) as whole, string_split_regex(t, {pattern}) as parts from d),
      u as (select *, unnest(found) as m, generate_subscripts(found, 1) as i from f),
      b as (select *, array_to_string(list_transform(range(1, i), lambda j: parts[j] || whole[j]), '') || parts[i]
        || case when regexp_matches(whole[i], {quoted(r"^[^\p{L}\p{N}_]")}) then left(whole[i], 1) else '' end as before from u)
      select doc_id, pos, (i - 1)::int as ref_no, case lower(regexp_extract(m, '^(\\S+)\\s', 1)) {words} end as category, regexp_extract(m, '(\\d+|[A-Z])$', 1) as number,
        {single} as matched, (length(regexp_replace(before, {mark}, '', 'g')) + (length(before) - length(regexp_replace(before, {mark}, '', 'g'))) // 2)::int as position from b"""


def ends_with_page(text: Column) -> Column:
    """Does a heading end in a page number, as in a table of contents?"""

    def of(t: Column) -> Column:
        before = trimmed(F.regexp_replace(t, PAGE_END, ""))
        return t.rlike(PAGE_END) & (F.length(before) >= 3) & before.rlike(r"\p{L}") & ~before.rlike(r"[;,.]$")

    return let(trimmed(text), of)


def ends_with_page_sql(text: str) -> str:
    t = f"trim({text}, {quoted(BLANKS)})"
    before = f"trim(regexp_replace({t}, {quoted(PAGE_END)}, ''), {quoted(BLANKS)})"
    return f"(regexp_matches({t}, {quoted(PAGE_END)}) and length({before}) >= 3 and regexp_matches({before}, '\\p{{L}}') and not regexp_matches({before}, '[;,.]$'))"


def without_page(text: Column) -> Column:
    return trimmed(F.regexp_replace(trimmed(text), PAGE_STRIP, ""))


def words_of(words: str) -> str:
    return f"(?i){EDGE_L}(?:{words}){EDGE_R}"


def sentence_shape(text: Column) -> Column:
    """At least 60 characters and two marks of a sentence."""
    return let(text, shape_of)


def shape_of(text: Column) -> Column:
    marks = (
        text.rlike(r"[.;!?]\s*$").cast("int") + text.rlike(words_of(SENTENCE_WORDS)).cast("int")
        + (F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))) >= 2).cast("int") + (F.length(text) > 160).cast("int")
    )
    return (F.length(text) >= 60) & (marks >= 2)


def sentence_shape_sql(t: str) -> str:
    marks = f"""regexp_matches({t}, '[.;!?]\\s*$')::int + regexp_matches({t}, {quoted(words_of(SENTENCE_WORDS))})::int
      + (length({t}) - length(replace({t}, ',', '')) >= 2)::int + (length({t}) > 160)::int"""
    return f"(length({t}) >= 60 and ({marks}) >= 2)"


def isolated_heading(text: Column) -> Column:
    """Not empty, at most 80 characters, nothing that speaks against a heading."""
    return (text != "") & (F.length(text) <= 80) & ~text.rlike(SENTENCE_END) & ~text.rlike(words_of(AGAINST_WORDS))


def isolated_heading_sql(t: str) -> str:
    return f"({t} <> '' and length({t}) <= 80 and not regexp_matches({t}, {quoted(SENTENCE_END)}) and not regexp_matches({t}, {quoted(words_of(AGAINST_WORDS))}))"


ACCENTS, PLAIN = "éèêëàâäîïôöùûüç", "eeeeaaaiioouuuc"


def folded(text: Column) -> Column:
    """Trimmed, lower case, without accents."""
    t = F.translate(F.lower(trimmed(text)), ACCENTS, PLAIN)
    return F.replace(F.replace(t, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))


def folded_sql(text: str) -> str:
    return f"replace(replace(translate(lower(trim({text}, {quoted(BLANKS)})), '{ACCENTS}', '{PLAIN}'), 'œ', 'oe'), 'æ', 'ae')"
