"""Scalar functions and repair rules on literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioflow.functions import chars, dates, geometry, text
from folioflow.operators import normalize


def one(spark, build, *values, kinds=None):
    names = [f"v{k}" for k in range(len(values))]
    kinds = kinds or ["string" if isinstance(v, str) else "double" if isinstance(v, float) else "bigint" for v in values]
    frame = spark.createDataFrame([values], ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    return frame.select(build(*map(F.col, names)).alias("x")).first().x


@pytest.mark.parametrize(("s", "want"), [("ŞİRKET", "sirket"), ("  Işık\u00a0 Çğ ", "isik cg"), ("i\u0307", "i"), ("", "")])
def test_fold(spark, s, want):
    assert one(spark, text.fold, s) == want


@pytest.mark.parametrize(("q", "hit"), [("sirket", True), ("ŞİR 2024", True), ("  ", True), ("sirket yok", False)])
def test_matches(spark, q, hit):
    assert one(spark, text.matches, q, "Fatura 2024", "Yeni ŞİRKET") is hit


@pytest.mark.parametrize(
    ("s", "want"),
    [("a/b:c*?", "a_b_c__"), ("  x \t y. . ", "x _ y"), (" ... ", "Document"), ("a" * 100, "a" * 80), ("", "Document")],
)
def test_sanitize(spark, s, want):
    assert one(spark, text.sanitize, s) == want


@pytest.mark.parametrize(("s", "want"), [("fatura.pdf", "fatura"), (".x", ".x"), ("a.b.c", "a.b"), ("none", "none"), ("a\nb.c", "a\nb")])
def test_extension(spark, s, want):
    assert one(spark, text.without_extension, s) == want


@pytest.mark.parametrize(("n", "want"), [(12500, "12.500"), (0, "0"), (-1234567, "-1.234.567"), (999, "999")])
def test_count(spark, n, want):
    assert one(spark, text.format_count, n) == want


@pytest.mark.parametrize(("n", "want"), [(26214400, "25 MB"), (1572864, "1,5 MB"), (0, "0 MB")])
def test_megabytes(spark, n, want):
    assert one(spark, text.format_megabytes, n) == want


def test_units_and_clip(spark):
    assert one(spark, chars.utf16_length, "a😀b") == 4
    assert one(spark, lambda s: chars.utf16_clip(s, 2), "a😀b") == "a"
    assert one(spark, lambda s: chars.utf16_clip(s, 3), "a😀b") == "a😀"
    assert one(spark, text.preview, "x" * 119 + " y z") == "x" * 119 + "…"


def test_layout(spark):
    assert one(spark, text.normalize_layout, " a \r\n\r\n\r\n\r\nb\t\rc ") == "a\n\nb\nc"


@pytest.mark.parametrize(("parts", "want"), [([], ""), ([" a "], "a"), (["a", " "], "Sayfa 1\na\n\nSayfa 2\n-")])
def test_sections(spark, parts, want):
    assert one(spark, lambda s: text.join_sections(s, "Sayfa", "-"), parts, kinds=["array<string>"]) == want


def test_dates(spark):
    ts = spark.sql("select timestamp_ntz'2026-09-11 14:05:09' as t")
    got = ts.select(dates.long_with_time(F.col("t")), dates.short(F.col("t")), dates.file_stamp(F.col("t")), dates.day_key(F.col("t"))).first()
    assert tuple(got) == ("11 Eylül 2026, 14:05", "11.09.2026", "20260911_1405", "2026-09-11")


@pytest.mark.parametrize(("w", "h", "want"), [(595.0, 842.0, (1653, 2339)), (0.0, -1.0, (1653, 2339)), (2000.0, 100.0, (2400, 120)), (100.0, 50.0, (1400, 700))])
def test_page_size(spark, w, h, want):
    assert tuple(one(spark, lambda a, b: F.struct(*geometry.page_render_size(a, b)), w, h)) == want


@pytest.mark.parametrize(
    ("s", "want"),
    [("ME2AR", "MEZAR"), ("se5lam", "seslam"), ("5ELAM", "SELAM"), ("SELAM5", "SELAMS"), ("(gü2el)", "(güzel)"), ("a\tse5lam\n", "a\tseslam\n")],
)
def test_repairs(spark, s, want):
    assert one(spark, lambda t: normalize.repair(t, F.lit(None).cast("double")), s) == want


@pytest.mark.parametrize("s", ["NEUR5ON", "KATL5AM", "A2B5C9", "TR520006", "PLAKA25ABC", "ABC-2025-5", "2500TL", "25.09.2026", "a5b@c.com", "http://5elam", "C:\\ME2AR", "5", "52", ""])
def test_protected(spark, s):
    assert one(spark, lambda t: normalize.repair(t, F.lit(None).cast("double")), s) == s


def test_confidence(spark):
    assert one(spark, normalize.repair, "ME2AR", 0.34) == "ME2AR"
    assert one(spark, normalize.repair, "ME2AR", 0.35) == "MEZAR"
    assert [tuple(c) for c in one(spark, normalize.changes, "ME2AR x ME2AR", 0.9)] == [("ME2AR", "MEZAR")] * 2


def test_counts_equal_the_patterns_without_a_pattern_a_word(spark):
    """Every white-space character at the ends, alone and between words; no list of matches is built to count words."""
    import re

    from folioflow.functions import chars, text

    own = lambda ws: re.compile("[" + ws.replace("\\x0B", "\x0b") + "]")
    rows = [None, "", " ", "a", "a\x00b \x1c c", "🙂 🙂\u200b🙂", "\u0085x\u1680y", *[f"{w}a{w}{w}b{w}é{w}" for w in chars.TRIM_CHARS], chars.TRIM_CHARS]
    table = spark.createDataFrame([(r,) for r in rows], "s string")
    found = table.select("s", text.word_count(F.col("s")).alias("w"), text.visible_chars(F.col("s")).alias("v"))
    for r in found.collect():
        if r.s is None:
            assert r.w is None and r.v is None
        else:
            assert r.w == len([x for x in own(chars.STATS_WS).split(r.s) if x]), repr(r.s)
            assert r.v == len(own(chars.REGEX_WS).sub("", r.s).encode("utf-16-le")) // 2, repr(r.s)
    plan = table.select(text.word_count(F.col("s")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower()
