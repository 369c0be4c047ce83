"""Scalar text functions: search folding, statistics, names, layout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import REGEX_CHARS, STATS_CHARS, TRIM_WS, WIDE, collapse, trim, trim_right, utf16_clip, utf16_length

# What folding maps; the last source character is deleted.
FOLD_FROM, FOLD_TO = "ışğüöçâîû\u0307", "isguocaiu"
TITLE_MAX, PREVIEW_MAX = 80, 120
#: Line ends but LF, white space before a line end, and more than one empty line.
UNTIDY = f"\\r|\\n\\n\\n|[{TRIM_WS.replace(chr(92) + 'n', '')}]\\n"


def fold(s: Column) -> Column:
    """Search form: lower case, no diacritics of the alphabet, single spaces."""
    low = F.lower(F.replace(F.replace(s, F.lit("İ"), F.lit("i")), F.lit("I"), F.lit("i")))
    # white space becomes plain spaces with the letters: a pattern of many ranges costs several times as much a character
    plain = F.translate(low, REGEX_CHARS + FOLD_FROM, " " * len(REGEX_CHARS) + FOLD_TO)
    return trim(F.regexp_replace(plain, " {2,}", " "))


def matches(query: Column, *fields: Column) -> Column:
    """Every folded term of the query is a substring of the folded fields; a blank query matches. The
    fields are folded once a row, whatever the number of terms."""
    text = reduce(lambda a, b: F.concat(a, F.lit("\n"), b), [fold(f) for f in fields])
    terms = F.filter(F.split(fold(query), " "), lambda t: t != "")
    return F.exists(F.array(text), lambda whole: F.forall(terms, lambda t: F.contains(whole, t)))


def word_count(s: Column) -> Column:
    # white space becomes plain spaces first: a class of many ranges costs a pattern several times as much a character
    words = F.btrim(F.translate(s, STATS_CHARS, " " * len(STATS_CHARS)), F.lit(" "))
    return F.when(words == "", 0).otherwise(F.array_size(F.split(words, " +")))


def visible_chars(s: Column) -> Column:
    """UTF-16 length without white space."""
    return F.length(F.translate(s, REGEX_CHARS, "")) + F.regexp_count(s, F.lit(WIDE))


def preview(s: Column) -> Column:
    """One line of at most 120 units, with an ellipsis if cut."""
    line = trim(collapse(s))
    cut = F.concat(trim_right(utf16_clip(line, PREVIEW_MAX)), F.lit("…"))
    return F.when(utf16_length(line) > PREVIEW_MAX, cut).otherwise(line)


def sanitize(s: Column, fallback: str = "Document") -> Column:
    """A string as a file name."""
    clean = F.regexp_replace(trim(collapse(F.regexp_replace(s, '[\\\\/:*?"<>|\\x00-\\x1F]', "_"))), "[. ]+\\z", "")
    return F.when(clean == "", F.lit(fallback)).when(utf16_length(clean) > TITLE_MAX, trim(utf16_clip(clean, TITLE_MAX))).otherwise(clean)


def without_extension(s: Column) -> Column:
    """Up to the last dot, unless that is the first character or there is none."""
    return F.regexp_replace(s, "(?s)^(.+)\\.[^.]*\\z", "$1")


def format_count(n: Column) -> Column:
    """Thousands grouped by dots."""
    return F.translate(F.format_number(n, 0), ",", ".")


def format_megabytes(n: Column) -> Column:
    """Bytes in MB to one decimal, without a zero decimal, comma as decimal sign."""
    tenths = F.round(n / F.lit(1048576.0) * 10).cast("bigint")
    whole, rest = F.floor(tenths / 10).cast("bigint"), F.pmod(tenths, F.lit(10))
    return F.concat(whole.cast("string"), F.when(rest == 0, "").otherwise(F.concat(F.lit(","), rest.cast("string"))), F.lit(" MB"))


def normalize_layout(s: Column) -> Column:
    """Line ends as LF, no white space at line ends, at most one empty line, trimmed."""
    lf = F.regexp_replace(s, "\\r\\n?", "\n")
    # per line, as the class for white space holds the line end itself
    right = F.array_join(F.transform(F.split(lf, "\n"), trim_right), "\n")
    # most texts need only be trimmed
    return F.when(s.rlike(UNTIDY), trim(F.regexp_replace(right, "\\n{3,}", "\n\n"))).otherwise(trim(s))


def join_sections(sections: Column, label: str, placeholder: str) -> Column:
    """An array of texts: none gives '', one its trimmed text, more numbered sections."""
    numbered = F.transform(sections, lambda s, i: F.concat(F.lit(f"{label} "), (i + 1).cast("string"), F.lit("\n"), F.when(trim(s) == "", F.lit(placeholder)).otherwise(trim(s))))
    return F.when(F.size(sections) == 0, "").when(F.size(sections) == 1, trim(F.element_at(sections, 1))).otherwise(F.array_join(numbered, "\n\n"))


def document_title(title: Column, date: Column, shown: str = "Adsız belge") -> Column:
    """A stored title: clipped and trimmed, else the default with the date."""
    from .dates import short

    clean = trim(utf16_clip(trim(title), TITLE_MAX))
    return F.when(clean == "", F.concat(F.lit("Belge - "), short(date))).otherwise(clean)
