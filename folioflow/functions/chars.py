"""Character classes shared by all text operators, as regular-expression class bodies.

They hold for Java's and for RE2's regular expressions alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as a pattern's \\s, as trim() and as the word counter see it.
REGEX_WS = "\\t\\n\\x0B\\f\\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
TRIM_WS = REGEX_WS + "\u0085"
STATS_WS = "\\t\\n\\x0B\\f\\r \u00a0\u2000-\u200a\u2028\u2029\u202f\u3000"
# The letters of the repair rules.
LOWER = "abcdefghijklmnopqrstuvwxyzçğıöşüâîû"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÇĞİÖŞÜÂÎÛ"
LETTERS = LOWER + UPPER
#: Characters that count twice where lengths are in UTF-16 units.
WIDE = "[\\x{10000}-\\x{10FFFF}]"

TRIM = f"^[{TRIM_WS}]+|[{TRIM_WS}]+\\z"
TRIM_RIGHT = f"[{TRIM_WS}]+\\z"
#: The characters of STATS_WS, REGEX_WS and TRIM_WS one by one.
STATS_CHARS = "\t\n\x0b\x0c\r \u00a0" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u3000"
REGEX_CHARS = STATS_CHARS + "\u1680\u205f\ufeff"
TRIM_CHARS = REGEX_CHARS + "\u0085"


def trim(s: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(s, F.lit(TRIM_CHARS))


def trim_right(s: Column) -> Column:
    """Without white space at the end."""
    return F.rtrim(s, F.lit(TRIM_CHARS))


def collapse(s: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(s, f"[{REGEX_WS}]+", " ")


def is_blank(s: Column) -> Column:
    return trim(s) == ""


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 units."""
    return F.length(s) + F.regexp_count(s, F.lit(WIDE))


def utf16_clip(s: Column, n: int) -> Column:
    """The first n UTF-16 units; a character that would be cut in half goes."""
    # a noncharacter behind every wide character makes code points count as units
    spread = F.substring(F.regexp_replace(s, f"({WIDE})", "$1\uffff"), 1, n)
    wide = F.regexp_replace(F.regexp_replace(spread, f"{WIDE}\\z", ""), "\uffff", "")
    return F.when(s.rlike(WIDE), wide).otherwise(F.substring(s, 1, n))
