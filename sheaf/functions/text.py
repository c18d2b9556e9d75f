"""Text of pages as column expressions. Sets of character n-grams are Arrow functions, those of `grams`.

A null text gives null, but for `truncate` and the feature arrays, which take it as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import grams

WORD = r"[\p{L}\p{N}_]+"
PAGE_FEATURES = ["log_chars", "words_per_100_chars", "chars_per_word", "alpha_share", "digit_share", "upper_share", "punct_share", "first_line_share"]
CROSS_FEATURES = [
    *(f"head_{n}" for n in (50, 150, 300, 600)),
    *(f"foot_{n}" for n in (50, 150, 300, 600)),
    "full_4gram",
    "head_3gram",
    "foot_3gram",
    "head_words",
    "length_ratio",
    "log_length_gap",
    "prev_digit_runs",
    "curr_digit_runs",
    "digit_run_gap",
]


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row even where body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Without white space at both ends; Spark's trim would take blanks only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def char_ngrams(text: Column, n: int) -> Column:
    """The distinct n-character strings of the stripped text; of a shorter one itself, of an empty one nothing."""
    return grams.distinct(n)(text)


def gram_similarity(prev: Column, curr: Column, n: int) -> Column:
    """Jaccard similarity of two texts' sets of n-character strings, without making strings of them."""
    return grams.similarity(n)(prev, curr)


def head_words(text: Column, n: int = 300) -> Column:
    """The distinct lower-case words of the first n characters."""
    return F.array_distinct(F.filter(F.split(F.lower(F.left(text, F.lit(n))), r"(?U)\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def truncate(text: Column, cap: int = 4000) -> Column:
    """Both ends of a text that is longer than cap, with a blank between."""
    t, half = F.coalesce(text, F.lit("")), F.lit(cap // 2)
    return F.when(F.length(t) <= cap, t).otherwise(F.concat(F.left(t, half), F.lit(" "), F.right(t, half)))


def digit_runs(text: Column) -> Column:
    """How many runs of digits have four digits at most."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?<!\p{Nd})\p{Nd}{1,4}(?!\p{Nd})"), F.lit(0)))


def page_features(text: Column) -> Column:
    """Eight numbers about a page, as in PAGE_FEATURES; zeros for an empty one."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t).cast("double")
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
    # characters of a class are what goes with its runs: counting matches would make a string of each
    chars = lambda c: n - F.length(F.regexp_replace(t, f"[{c}]+", "")).cast("double")
    line = F.regexp_extract(t, r"^[^\n\r\x0B\f\x1C-\x1E\x85\x{2028}\x{2029}]*", 0)
    first = F.length(F.when(F.instr(t, "\n") > 0, line).otherwise(F.left(t, F.lit(100))))
    one = F.lit(1.0)
    found = {"n": n, "words": count(WORD), "alpha": chars(r"\p{L}"), "digits": chars(r"\p{Nd}"), "upper": chars(r"\p{IsUppercase}"), "punct": chars(r".,;:!?\-/"), "first": first}

    def values(c: Column) -> Column:
        share = lambda k: c[k] / F.greatest(c["n"], one)
        per_word = F.when(c["words"] > 0, c["n"] / F.greatest(c["words"], one)).otherwise(0.0)
        return F.array(F.log1p(c["n"]), share("words") * 100, per_word, share("alpha"), share("digits"), c["upper"] / F.greatest(c["alpha"], one), share("punct"), share("first"))

    # each count is made once, however often it is used
    return F.when(n == 0, F.array_repeat(F.lit(0.0), 8)).otherwise(let(F.struct(*(v.alias(k) for k, v in found.items())), values))


def cross_features(prev: Column, curr: Column) -> Column:
    """Seventeen numbers about two consecutive pages' texts, as in CROSS_FEATURES."""
    return grams.cross_features(prev, curr)
