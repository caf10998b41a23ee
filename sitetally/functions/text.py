"""Text columns: trimming, accent folding, token keys."""

from __future__ import annotations

import string
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(maxsize=2)
def _accent_pairs(ascii_only: bool) -> tuple[str, str]:
    """Composed lower-case letters of the BMP and the single base letter of each."""
    accented, plain = [], []
    for code in range(0x80, 0xD800):
        char = chr(code)
        base = [c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn"]
        if len(base) != 1 or base[0] == char or char.lower() != char:
            continue
        if not ascii_only or base[0].lower() in string.ascii_lowercase:
            accented.append(char)
            plain.append(base[0].lower())
    return "".join(accented), "".join(plain)


def text_or_blank(c) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def strip(c) -> Column:
    """Trim every Unicode space; a null becomes the empty string."""
    return F.trim(text_or_blank(c), F.lit(WHITESPACE))


def _folded(c, ascii_only: bool) -> Column:
    """Lower case without combining marks, whether stored apart or inside a composed letter. Text of one byte a character holds neither."""
    text = text_or_blank(c)
    folded = F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}", ""), *_accent_pairs(ascii_only))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)


def norm_token(c) -> Column:
    """Lower-case ASCII words separated by single spaces; the join key of all names."""
    return F.trim(F.regexp_replace(_folded(c, ascii_only=True), "[^a-z0-9]+", " "))


def norm_span(c) -> Column:
    """Accent-free lower-case text that keeps its punctuation."""
    return F.trim(F.regexp_replace(_folded(c, ascii_only=False), r"(?U)\s+", " "))


def not_blank(c) -> Column:
    return strip(c) != ""


def blank_to_null(c) -> Column:
    return F.nullif(strip(c), F.lit(""))


def tidy(c) -> Column:
    """Remove NUL characters and trim."""
    return F.trim(F.replace(text_or_blank(c), F.lit("\x00"), F.lit("")), F.lit(WHITESPACE))


def phrases(words: Column, max_words: Column) -> Column:
    """Every run of consecutive words, up to ``max_words`` long."""
    n = F.size(words)
    longest = F.least(max_words, n)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    runs = F.transform(
        starts,
        lambda s: F.transform(
            F.sequence(F.lit(1), F.greatest(F.least(longest, n - s + 1), F.lit(1))),
            lambda k: F.array_join(F.slice(words, s, k), " "),
        ),
    )
    return F.array_distinct(F.flatten(runs))


def py_round(c, digits: int) -> Column:
    """Round a double the way its exact binary value rounds (half to even)."""
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", col(c).cast("double"), F.lit(pattern)).cast("double")
