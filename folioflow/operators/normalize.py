"""Repair of digit and letter confusions (2 for Z, 5 for S) inside words.

Every rule is a column expression over tokens, so texts stay in the JVM: a token's core runs
from its first to its last letter or digit; guards keep numbers, codes, amounts, addresses and
paths; a digit between letters (or at the core's edge next to a letter) becomes a letter in
the case of the nearest letter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.chars import LETTERS, LOWER, REGEX_WS, UPPER

# Thresholds, currency markers and the confused pairs.
MIN_CONFIDENCE, MIN_LETTERS, MIN_RATIO = 0.35, 3, 0.6
CURRENCY = ["TL", "₺", "TRY", "$", "USD", "€", "EUR", "£", "GBP", "%"]
PAIRS = {"2": "Z", "5": "S"}
#: A digit that some rule may change, by its neighbours alone: behind a letter and not before a digit, or first of its core and before a letter.
CHANGEABLE = f"[25](?:(?<=[{LETTERS}][25])(?![0-9])|(?<![{LETTERS}0-9][25])(?=[{LETTERS}]))"
_MARKERS = "|".join("\\$" if m == "$" else m for m in CURRENCY)


def tokens(text: Column) -> Column:
    """Words and the white space between them, in order."""
    return F.regexp_extract_all(text, F.lit(f"([^{REGEX_WS}]+|[{REGEX_WS}]+)"), F.lit(1))


def _may_change(text: Column) -> Column:
    return (F.contains(text, F.lit("2")) | F.contains(text, F.lit("5"))) & text.rlike(CHANGEABLE)


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repairable(token: Column, core: Column) -> Column:
    letters, digits = F.length(core) - _without(core, LETTERS), F.length(core) - _without(core, "0123456789")
    known = (letters >= MIN_LETTERS) & (letters / (letters + digits) >= F.lit(MIN_RATIO))
    return known & ~token.rlike("@|://|\\\\") & ~F.upper(token).rlike(_MARKERS)


def repair_token(token: Column) -> Column:
    inside = f"[{LETTERS}0-9]"
    let = lambda x, f: F.transform(F.array(x), f)[0]

    def mended(digit: str) -> Callable[[Column], Column]:
        def of(core: Column) -> Column:
            fixed = core
            for case, by in ((UPPER, PAIRS[digit]), (LOWER, PAIRS[digit].lower())):
                fixed = F.regexp_replace(fixed, f"(?<=[{case}]){digit}(?=[{LETTERS}])|(?<=[{case}]){digit}\\z|^{digit}(?=[{case}])", by)
            return F.when(F.contains(core, F.lit(digit)), fixed).otherwise(core)

        return of

    def whole(core: Column) -> Column:
        head = F.regexp_extract(token, f"^([^{LETTERS}0-9]*)", 1)
        tail = F.substring(token, F.length(head) + F.length(core) + 1, F.length(token))
        fixed = core
        for digit in PAIRS:
            fixed = let(fixed, mended(digit))
        return F.when(repairable(token, core), F.concat(head, fixed, tail)).otherwise(token)

    return F.when(_may_change(token), let(F.regexp_extract(token, f"{inside}(?s:.*{inside})?", 0), whole)).otherwise(token)


def may_repair(text: Column, confidence: Column) -> Column:
    return (text != "") & (confidence.isNull() | (confidence >= MIN_CONFIDENCE))


def repair(text: Column, confidence: Column) -> Column:
    """Repaired text; unchanged where the confidence is known and low. White space stays as it is."""
    fixed = F.array_join(F.transform(tokens(text), repair_token), "")
    return F.when(may_repair(text, confidence) & _may_change(text), fixed).otherwise(text)


def changes(text: Column, confidence: Column) -> Column:
    """(before, after) of every repaired token, in order, repeats kept."""
    pairs = F.transform(F.filter(tokens(text), _may_change), lambda t: F.struct(t.alias("before"), repair_token(t).alias("after")))
    kept = F.filter(pairs, lambda p: p["before"] != p["after"])
    return F.when(may_repair(text, confidence), kept).otherwise(F.filter(pairs, lambda p: F.lit(False)))


def repaired(text: Column, confidence: Column) -> Column:
    """(text, n): repair() and the number of changes(), with every token looked at once; n is null where the text is."""
    let = lambda x, f: F.transform(F.array(x), f)[0]
    counted = lambda old, new: F.struct(F.array_join(new, "").alias("text"), F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x)).alias("n"))
    fixed = let(tokens(text), lambda old: let(F.transform(old, repair_token), lambda new: counted(old, new)))
    return F.when(may_repair(text, confidence) & _may_change(text), fixed).otherwise(F.struct(text.alias("text"), F.when(text.isNotNull(), 0).alias("n")))
