"""Text functions (T1, T2, T4-T8) as built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop list of the indexed language, 108 words, alphabetical.
STOP_WORDS = (
    "a about above after again against all am an and "
    "any are as at be because been before being below "
    "between both but by can did do does doing down "
    "during each few for from further had has have he "
    "her here his how i if in into is it its me "
    "more most my no nor not of off on once only "
    "or other our out over own same she should so "
    "some such than that the their them then there these "
    "they this those through to too under until up very "
    "was we were what when where which while who whom "
    "why with would you your"
).split()

# A word is a maximal run of these characters after lower-casing.
WORD_PATTERN = "[a-z0-9]+"

# The whitespace class of the page text rules (ASCII blanks, vertical tab, no-break
# space, the Unicode space separators, line/paragraph separators, byte-order mark). The class is written
# so that Java regex (Spark) and RE2 (DuckDB) read it the same way.
WHITESPACE_CLASS = (
    r"[\t\n\f\r \x{000b}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)

SNIPPET_CHARS = 200


def words(text: Column) -> Column:
    """Raw words of a text: lower-case, maximal runs of [a-z0-9], order and duplicates kept."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), 0), F.array().cast("array<string>"))


def is_index_word(w: Column) -> Column:
    """Stop-word / length predicate (PF3): keep words longer than one character that are not stop words."""
    return (F.length(w) > 1) & ~w.isin(*STOP_WORDS)


def index_words(text: Column) -> Column:
    """Words that reach the index, before stemming (T1 without the stem step)."""
    return F.filter(words(text), is_index_word)


def query_words(text: Column) -> Column:
    """Query words (T2): the index words, or all raw words when none survives the filter (K6)."""
    raw = words(text)
    kept = F.filter(raw, is_index_word)
    return F.when(F.size(kept) > 0, kept).otherwise(raw)


def body_hash(text: Column) -> Column:
    """sha-256 hex of the body text, '' when missing (T5)."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def collapse_ws(text: Column) -> Column:
    """Every whitespace run becomes one blank, then leading/trailing blanks go."""
    return F.trim(F.regexp_replace(text, WHITESPACE_CLASS + "+", " "))


def trim_ws(text: Column) -> Column:
    """Strip the whitespace class at both ends, inner whitespace kept."""
    return F.regexp_replace(text, "^" + WHITESPACE_CLASS + "+|" + WHITESPACE_CLASS + "+$", "")


def snippet_cut(text: Column, n: int = SNIPPET_CHARS) -> Column:
    """First ``n`` characters, plus '...' when the text is longer."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def contains_ci(haystack: Column, needle: Column) -> Column:
    """Case-insensitive substring test with all white space around the needle trimmed."""
    return F.contains(F.lower(haystack), F.lower(trim_ws(needle)))
