"""Text clean-up, tokens and fuzzy similarity as Spark column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factsieve.functions.memo import memo

# Fixed value: every character the page model treats as white space.
SPACE_CHARS = r"\s\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
# Fixed value: exotic spaces that become a plain space while line breaks survive.
WIDE_SPACE_CHARS = r"\u00a0\u2000-\u200b\u202f\u205f\u3000"

# What squishing has to touch: single plain spaces, most of a text's, stay as they are.
_UNSQUISHED = rf"(?=[^!-~])(?:[{SPACE_CHARS}]{{2,}}|[{SPACE_CHARS}&&[^ ]])"
# What a text of one line has to hold for squish_block to change it.
_UNEVEN = rf"[^\S ]|[{WIDE_SPACE_CHARS}]|  |^ | $"

# Words that carry no meaning in a label.
STOP_WORDS = (
    "the", "a", "an", "of", "and", "or", "for", "to", "in", "on", "at", "by",
    "with", "our", "your", "us", "we", "is", "are", "be", "no", "number",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


@memo
def squish(c: Column) -> Column:
    """Collapse every kind of white space and trim."""
    return F.trim(F.regexp_replace(text_or_empty(c), _UNSQUISHED, " "))


@memo
def squish_block(c: Column) -> Column:
    """Like :func:`squish`, but line and paragraph breaks survive."""
    given = text_or_empty(c)
    c = F.regexp_replace(given, f"[{WIDE_SPACE_CHARS}]", " ")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\s*\n\s*\n\s*", "\n\n")
    c = F.regexp_replace(c, r"[ \t]*\n[ \t]*", "\n")
    # most texts are one line of words with single spaces, which no step changes
    return F.when(given.rlike(_UNEVEN), F.regexp_replace(c, r"^\s+|\s+$", "")).otherwise(given)


def raw_tokens(c: Column) -> Column:
    # white space parts tokens as it is; a split would compile its pattern anew for every text
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("[a-z0-9]+"), F.lit(0))


@memo
def tokens(c: Column, keep_stopwords: bool = False) -> Column:
    """Lower-case alphanumeric tokens; stop words go unless nothing else is left."""
    if keep_stopwords:
        return raw_tokens(c)
    return let(
        raw_tokens(c),
        lambda raw: let(
            F.filter(raw, lambda t: ~t.isin(*STOP_WORDS)),
            lambda kept: F.when(F.size(kept) > 0, kept).otherwise(raw),
        ),
    )


@memo
def to_key(c: Column) -> Column:
    """snake_case output column name of a label."""
    c = F.regexp_replace(squish(c), "([a-z0-9])([A-Z])", "$1_$2")
    c = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")
    c = F.regexp_replace(c, "^_+|_+$", "")
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("field"))


@memo
def alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(squish(c)), "[^a-z0-9]+", "")


@memo
def grams(word: Column) -> Column:
    """Distinct trigrams of an :func:`alnum` word padded with two leading and one trailing space."""
    return let(
        F.concat(F.lit("  "), word, F.lit(" ")),
        lambda padded: F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.length(padded) - 2),
                lambda i: F.substring(padded, i, F.lit(3)),
            )
        ),
    )


def gram_dice(word_a: Column, grams_a: Column, word_b: Column, grams_b: Column) -> Column:
    """Dice overlap of two prepared words: 1 when equal, 0 when either is empty."""
    return (
        F.when((word_a == "") | (word_b == ""), F.lit(0.0))
        .when(word_a == word_b, F.lit(1.0))
        .otherwise(2.0 * F.size(F.array_intersect(grams_a, grams_b)) / (F.size(grams_a) + F.size(grams_b)))
    )


def trigram_dice(a: Column, b: Column) -> Column:
    return let(
        alnum(a),
        lambda x: let(alnum(b), lambda y: gram_dice(x, grams(x), y, grams(y))),
    )


def token_overlap(needles: Column, haystack: Column) -> Column:
    """Share of ``needles`` found in ``haystack``; repeated needles count each time."""
    hits = F.size(F.filter(needles, lambda t: F.array_contains(haystack, t)))
    return F.when(F.size(needles) > 0, hits / F.size(needles)).otherwise(F.lit(0.0))


def dedupe_strings(values: Column) -> Column:
    """First spelling of each string, ignoring case and spacing."""
    cleaned = F.filter(F.transform(values, squish), lambda v: v != "")
    return let(
        cleaned,
        lambda all_values: let(
            F.transform(all_values, F.lower),
            lambda lowered: F.filter(
                all_values,
                lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1,
            ),
        ),
    )


def contains_text(haystack: Column, needle: Column) -> Column:
    n = F.lower(squish(needle))
    return (F.length(n) > 0) & F.lower(squish(haystack)).contains(n)


def truncate(c: Column, limit: int) -> Column:
    return let(
        squish(c),
        lambda s: F.when(F.length(s) <= limit, s).otherwise(
            F.concat(F.substring(s, 1, limit - 1), F.lit("…"))
        ),
    )


@memo
def words_only(c: Column) -> Column:
    """Letters and digits only, separated by single spaces."""
    return F.trim(F.regexp_replace(F.lower(squish(c)), r"[^\p{L}\p{N}]+", " "))


def round_half_up(c: Column, scale: int) -> Column:
    """Round half up on the binary value: floor(x * scale + 0.5) / scale."""
    return F.floor(c * scale + 0.5) / scale
