"""Scalar functions of text as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.settings import Settings

CHARS_PER_TOKEN = 4
NOT_FOUND = "NOT_FOUND"
#: A term of the index; query tokens may also hold underscores, which join several terms to a phrase.
TERM, TOKEN = r"[\p{L}\p{N}]+", r"[\p{L}\p{N}_]+"


def _folds() -> tuple[str, str]:
    """Lower-case letters with marks, and the plain letters they are searched as; made by decomposing them."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if chr(code).islower() and len(parts) > 1 and parts[0].isascii() and all(unicodedata.combining(c) for c in parts[1:]):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folds()


def folded(term: Column) -> Column:
    """A lower-case term without marks. Only terms beyond ASCII are looked at letter by letter."""
    return F.when(F.octet_length(term) > F.length(term), F.translate(term, FOLD_FROM, FOLD_TO)).otherwise(term)


def raw_terms(text: Column) -> Column:
    """All terms of a text in order, lower case, not folded; folding changes no border."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def index_terms(text: Column) -> Column:
    """All terms of a text in order, as they are searched."""
    return F.transform(raw_terms(text), folded)


def query_tokens(text: Column) -> Column:
    """Distinct tokens of a question in order, without those of one character."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) > 1))


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN)).cast("long")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def context_block(position: Column, filename: Column, page: Column, chunk_idx: Column, text: Column) -> Column:
    """How a chunk is shown to the model; page 0 counts as none."""
    place = F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(", page "), page)).otherwise(F.concat(F.lit(", section "), chunk_idx + 1))
    return F.concat(F.lit("["), position, F.lit("] ("), filename, place, F.lit(")\n"), text)


def citation_marks(answer: Column, most: Column) -> Column:
    """The distinct numbers n of marks [n] with 1 <= n <= most, sorted."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: (n > 0) & (n <= most))))


def is_not_found(answer: Column) -> Column:
    return answer.startswith(NOT_FOUND)


def needs_parts(question: Column, settings: Settings | None = None) -> Column:
    """Whether a question looks as if it had several parts."""
    s = settings or Settings()
    words = F.size(F.regexp_extract_all(question, F.lit(r"\S+"), F.lit(0)))
    padded = F.concat(F.lit(" "), F.lower(question), F.lit(" "))
    joined = F.lit(False)
    for word in s.conjunctions:
        joined = joined | padded.contains(word)
    many = F.length(question) - F.length(F.replace(question, F.lit("?"), F.lit(""))) > 1
    return F.when(words < s.min_words_for_decompose, False).when(words > s.max_words_simple, True).otherwise(many | question.rlike(r"(?:^|\s)\d[.)]\s") | joined)
