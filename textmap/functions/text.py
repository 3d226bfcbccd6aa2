"""Text columns: accent folding, tokens, n-grams."""

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmap.functions.common import let

NON_ASCII = r"[^\x00-\x7F]"
# Runs of two or more word characters.
ASCII_TOKEN = r"\w\w+"
UNICODE_TOKEN = r"(?U)\w\w+"
_PAIR, _KEY, _MARK = "\x01", "\x02", "\x03"


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility form holds one ASCII character, their images, and the longer forms."""
    source, target, longer = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        plain = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            source.append(ch)
            target.append(plain)
        elif plain:
            longer[ch] = plain
    return "".join(source), "".join(target), longer


def fold(text: Column) -> Column:
    """Lower case, accents to ASCII, other non-ASCII characters dropped. Pure ASCII rows skip the fold.

    One pass maps the single characters and marks those with a longer form; only marked rows are
    expanded. A mark that was in the text already only sends its row the longer way.
    """
    source, target, longer = fold_table()
    pairs = F.map_entries(
        F.str_to_map(F.lit(_PAIR.join(k + _KEY + v for k, v in longer.items())), F.lit(_PAIR), F.lit(_KEY))
    )

    def mapped(lowered: Column) -> Column:
        expanded = F.aggregate(pairs, lowered, lambda acc, p: F.replace(acc, p["key"], p["value"]))
        return let(
            F.translate(lowered, source + "".join(longer), target + _MARK * len(longer)),
            lambda quick: F.when(F.contains(quick, F.lit(_MARK)), F.translate(expanded, source, target)).otherwise(quick),
        )

    return let(
        F.lower(text),
        lambda low: F.when(low.rlike(NON_ASCII), F.regexp_replace(mapped(low), NON_ASCII, "")).otherwise(low),
    )


def normalize(text: Column, accents: str | None = "ascii") -> Column:
    if accents == "ascii":
        return fold(text)
    if accents is None:
        return F.lower(text)
    raise ValueError(f"unknown accents mode: {accents}")


def tokens(text: Column, accents: str | None = "ascii") -> Column:
    """Array of the tokens of an already normalized text."""
    pattern = ASCII_TOKEN if accents == "ascii" else UNICODE_TOKEN
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def word_ngrams(words: Column, n_min: int, n_max: int) -> Column:
    """All n-grams of n_min..n_max words, joined by a space."""
    if not 1 <= n_min <= n_max:
        raise ValueError("need 1 <= n_min <= n_max")

    def grams(w: Column, n: int) -> Column:
        if n == 1:
            return w
        starts = F.sequence(F.lit(1), F.size(w) - F.lit(n - 1))
        made = F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(F.size(w) >= n, made).otherwise(F.array().cast("array<string>"))

    if (n_min, n_max) == (1, 1):
        return words
    return let(words, lambda w: F.concat(*[grams(w, n) for n in range(n_min, n_max + 1)]))


def terms(text: Column, accents: str | None = "ascii", ngram_range: tuple[int, int] = (1, 1)) -> Column:
    return word_ngrams(tokens(normalize(text, accents), accents), *ngram_range)


def title_of(text: Column) -> Column:
    """First line of a text."""
    return F.trim(F.substring_index(text, "\n", 1))


def slug_of(title: Column) -> Column:
    return F.trim(F.regexp_replace(fold(title), "[^a-z0-9]+", "-"), F.lit("-"))


def excerpt(text: Column, n_chars: int = 150) -> Column:
    return F.substring(text, 1, n_chars)
