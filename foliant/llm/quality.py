"""Quality rules: a table of thresholds compiled into one Spark projection.

Every figure of a text comes from built-in expressions over its array of words and its array of lines; the verdict
compares integers only, so that no rounding decides. Cases:

* null text: as an empty text; no words, every count 0, ``base_failed`` (fewer than 20 words).
* very long text: one pass per figure; repeated windows are found by sorting 64-bit hashes of the windows, so time
  grows as n log n. Two different windows count as equal only if their 64-bit hashes collide.
* repeated rows: each row gets its own result. Empty table: empty result. Extra columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: what lies between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Words of a window whose repetition counts.
WINDOW = 8

# Frequent function words of the languages the rules are meant for.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with be this at by an from or a".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine er es".split(),
    "fr": "le la les de des et en un une du est que qui dans pour pas sur par au ne".split(),
    "es": "el la los de que y en un una del se las por con no para es al lo su".split(),
}


@dataclass(frozen=True)
class Threshold:
    """``low <= 100 * figure / base <= high``; a None side is open. Compared as integers: nothing is divided."""

    figure: str
    base: str
    low: int | None = None
    high: int | None = None

    def passes(self, figures: dict[str, Column]) -> Column:
        value, base = 100 * figures[self.figure], figures[self.base]
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (value >= self.low * base)
        if self.high is not None:
            ok = ok & (value <= self.high * base)
        return ok

    def sql(self) -> str:
        """The same comparison as SQL text."""
        sides = [f"100 * {self.figure} >= {self.low} * {self.base}"] * (self.low is not None)
        sides += [f"100 * {self.figure} <= {self.high} * {self.base}"] * (self.high is not None)
        return " and ".join(sides)


#: The production table: length, symbol, stop-word and line ratios, in hundredths.
THRESHOLDS = (
    Threshold("word_chars", "n_words", 200, 1600),
    Threshold("n_symbols", "n_words", None, 20),
    Threshold("n_shouts", "n_words", None, 30),
    Threshold("n_stop_words", "n_words", 2, None),
    Threshold("n_dup_lines", "n_lines", None, 40),
)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: inside a lambda a bound variable isn't evaluated again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def window_hashes(words: Column, window: int = WINDOW) -> Column:
    """A 64-bit hash of every window of ``window`` words, a power of two: hashes of halves are joined step by step."""

    def doubled(span: int):
        return lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - span, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + span)))

    hashes, span = F.transform(words, lambda w: F.xxhash64(w)), 1
    while span < window:
        hashes, span = let(hashes, doubled(span)), 2 * span
    return hashes


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of ``window`` words that the text has twice or more, the first included."""
    none = F.lit(0).cast("long")

    def covered(spots: Column) -> Column:
        step = F.transform(spots, lambda at, i: F.least(F.coalesce(F.get(spots, i + 1) - at, F.lit(window)), F.lit(window)))
        return F.aggregate(step, none, lambda total, x: total + x)

    def spots(ranked: Column) -> Column:
        def twin(e: Column, i: Column) -> Column:
            return F.get(ranked, i - 1)["h"].eqNullSafe(e["h"]) | F.get(ranked, i + 1)["h"].eqNullSafe(e["h"])

        return F.array_sort(F.transform(F.filter(ranked, twin), lambda e: e["at"]))

    def of(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(
            let(ranked, lambda r: let(spots(r), covered))
        )

    return F.when(F.size(words) <= window, none).otherwise(let(window_hashes(words, window), of))


def quality_figures(text: Column, stop_words: dict[str, list[str]] = STOP_WORDS) -> Column:
    """A struct of all figures of a text; computed once per row."""
    text = F.coalesce(text, F.lit(""))
    stops = sorted({w for ws in stop_words.values() for w in ws})
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def of(words: Column) -> Column:
        bare = F.transform(words, lambda w: F.rtrim(F.lower(w), F.lit("!.,;:?%&$#*|")))
        return let(
            lines,
            lambda ls: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                repeated_words(words).alias("n_repeat_words"),
                F.size(ls).cast("long").alias("n_lines"),
                (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
                F.size(F.filter(bare, lambda w: w.isin(stops))).cast("long").alias("n_stop_words"),
            ),
        )

    return let(word_array(text), of)


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 20) | (100 * f["n_repeat_words"] > 30 * f["n_words"])


def kept(f: Column, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> Column:
    figures = {k: f[k] for t in thresholds for k in (t.figure, t.base)}
    ok = ~base_failed(f)
    for t in thresholds:
        ok = ok & t.passes(figures)
    return ok


def quality_report(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """doc_id, the figures of its text, base_failed and kept."""
    f = F.col("f")
    return docs.select("doc_id", quality_figures(F.col("text")).alias("f")).select(
        "doc_id", "f.*", base_failed(f).alias("base_failed"), kept(f, thresholds).alias("kept")
    )


def quality_filter(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns."""
    return docs.where(let(quality_figures(F.col("text")), lambda f: kept(f, thresholds)))
