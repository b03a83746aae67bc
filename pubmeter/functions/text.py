"""Text normalisers: titles, identifiers, personal names and label texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words removed from titles, in this order, case-sensitive, also inside longer words.
BOILERPLATE = ("Author", "Reply", "Introduction", "Introdução", "Poster Sessions", "preparation")

# Shortest lengths that are kept (a title must be longer, an identifier at least as long).
TITLE_LONGER_THAN = 10
WORK_TITLE_LONGER_THAN = 15
DOI_AT_LEAST = 7
ISSN_AT_LEAST = 3

# Fixed value: first year of the study.
FIRST_YEAR = 2008

PUNCTUATION = r"[\p{P}\p{S}]"
BLANKS = r"[\s\p{Z}]+"


def safe_int(c: Column) -> Column:
    """Integer value of a text, or null."""
    return c.try_cast("bigint")


def year_from(c: Column, first: int = FIRST_YEAR) -> Column:
    """True where the text is an integer of at least ``first``."""
    return F.coalesce(safe_int(c) >= first, F.lit(False))


def punctuation_to_space(c: Column) -> Column:
    return F.regexp_replace(c, PUNCTUATION, " ")


def squish(c: Column) -> Column:
    """Trim, and collapse every run of white space (Unicode separators included) to one space."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def drop_words(c: Column, words: Sequence[str] = BOILERPLATE) -> Column:
    for word in words:
        c = F.replace(c, F.lit(word), F.lit(""))
    return c


def clean_title(c: Column, words: Sequence[str] = BOILERPLATE) -> Column:
    return squish(drop_words(punctuation_to_space(c), words))


def longer_than(c: Column, n: int) -> Column:
    return F.char_length(c) > n


def strip_double_quotes(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit(""))


def strip_quotes(c: Column) -> Column:
    """Without double and single quotes."""
    return F.translate(c, "\"'", "")


def strip_doi_prefix(c: Column) -> Column:
    """Without a leading ``doi:`` and then a leading ``DOI:``."""
    return F.regexp_replace(F.regexp_replace(c, "^doi:", ""), "^DOI:", "")


def normalise_doi(c: Column) -> Column:
    return squish(strip_doi_prefix(squish(c)))


def doi_key(c: Column) -> Column:
    """Join key of an identifier: no quotes, no prefix, lower case, null where empty."""
    return F.nullif(F.lower(normalise_doi(strip_quotes(c))), F.lit(""))


def first_word(c: Column) -> Column:
    return F.split_part(c, F.lit(" "), F.lit(1))


def words_after_first(c: Column) -> Column:
    """Everything after the first space; null for a single word."""
    rest = F.regexp_replace(c, r"^[^ ]* ?", "")
    return F.nullif(rest, F.lit(""))


def split_name(name: Column, particle: str = "Ed", as_published: bool = False) -> tuple[Column, Column]:
    """First and last name; a leading particle is skipped.

    The published numbers were made with the second replacement reading the already replaced first name,
    so that the last name kept its particle word; ``as_published`` gives that result.
    """
    first, last = first_word(name), words_after_first(name)
    skip = first == particle
    fixed_first = F.when(skip, first_word(last)).otherwise(first)
    test = fixed_first == particle if as_published else skip
    fixed_last = F.when(test, words_after_first(last)).otherwise(last)
    return fixed_first, fixed_last


def after_last_dash(c: Column) -> Column:
    """Label without everything up to its last `` - ``."""
    return F.regexp_replace(c, r"(?s)^.* - ", "")


def round_half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def percent_text(share: Column, digits: int = 1) -> Column:
    """``0.4567`` as ``45.7%``; a whole number prints without decimals."""
    number = F.bround(share * 100, digits)
    whole = number == F.floor(number)
    return F.concat(F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string")), F.lit("%"))


def each(df: DataFrame, array: Column, name: str, *keep: Column | str) -> DataFrame:
    """``keep`` columns and one row per element of a costly array; elements are never null.

    A plain explode would have the optimizer compute every array once more, beforehand, to drop the empty ones.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def tokens(c: Column) -> Column:
    """Lower-case words of at least two letters, digits or underscores, in any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
