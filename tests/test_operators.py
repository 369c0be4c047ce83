"""Operators on drawn pages, tables, logs and rasters with known answers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import layout, quota, raster, store, tables
from folioflow.sources import files
from folioflow.streaming import quota_stream

WORDS = "page bigint, word_no int, text string, l double, t double, r double, b double, conf double"


def boxed(pages, tilt=0.0, conf=None):
    """pages: rows of (text, left, right) by page, 40 units apart, 20 high."""
    out = []
    for p, rows in pages.items():
        k = 0
        for y, row in enumerate(rows):
            for word, left, right in row:
                top = y * 40.0 + tilt * left
                out.append((p, k, word, float(left), top, float(right), top + 20, conf))
                k += 1
    return out


def test_tables(spark):
    grid = [[("Ad", 0, 40), ("Adet", 200, 260), ("Fiyat", 400, 480)]] + [[(f"mal{k}", 0, 60), (str(k), 200, 220), (f"{k}0", 400, 440)] for k in range(2)]
    hole = [*grid, [("son", 0, 50), ("9", 400, 420)]]
    one = [[("tek", 0, 50)], [("sütun", 0, 60)], [("daha", 0, 50)]]
    prose = [[("bir", 0, 40), ("iki", 45, 90), ("üç", 95, 130)], [("dört", 0, 55), ("beş", 60, 100), ("altı", 105, 150)]]
    flat = spark.createDataFrame(boxed({1: grid, 2: hole, 3: one, 4: prose}), WORDS)
    a = tables.Analysis(flat)
    got = {r.page: r for r in a.decisions().collect()}
    assert (got[1].n_rows, got[1].n_cols, got[1].has_header, round(got[1].confidence, 6)) == (3, 3, True, 0.966667)
    assert (got[2].n_rows, got[2].n_cols, round(got[2].confidence, 6)) == (4, 3, 0.975)
    assert (got[3].reason, got[4].reason) == ("tooFewWords", "tooFewColumns")
    text = {r.page: r.text for r in tables.aligned_text(a.table_cells()).collect()}
    assert text[1] == "Ad    Adet  Fiyat\nmal0  0     00\nmal1  1     10"
    tilted = tables.Analysis(spark.createDataFrame(boxed({1: hole}, math.tan(math.radians(2.5)), 0.2), WORDS)).decisions().first()
    assert (tilted.n_rows, tilted.n_cols) == (4, 3) and tilted.confidence < 1.0


def test_row_groups_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(p, k, "w", rng.uniform(0, 300), rng.uniform(0, 120), 0.0, 0.0, None) for p in range(20) for k in range(25)]
    rows = [(p, k, w, x, y, x + 10, y + 20, c) for p, k, w, x, y, _, _, c in rows]
    a = tables.Analysis(spark.createDataFrame(rows, WORDS))
    slope = {r.page: r.slope for r in a.slopes.collect()}
    got = {(r.page, r.word_no): r.row for r in a.rows.collect()}
    for p in range(20):
        keyed = sorted(((y + b) / 2 - slope[p] * ((x + r) / 2), x, k) for q, k, _, x, y, r, b, _ in rows if q == p)
        row, total, n = -1, 0.0, 0
        for key, _, k in keyed:
            if n and abs(key - total / n) <= 12.0:
                total, n = total + key, n + 1
            else:
                row, total, n = row + 1, key, 1
            assert got[p, k] == row


def test_blocks(spark):
    lines = [(1, 0, 0, " A ", 0.0, 20.0), (1, 0, 1, "B", 22.0, 42.0), (1, 1, 0, "C", 50.0, 70.0), (1, 2, 0, " ", 72.0, 92.0), (1, 3, 0, "D", 120.0, 140.0), (2, 0, 0, " ", 0.0, 9.0)]
    got = {r.page: r.text for r in layout.format_blocks(spark.createDataFrame(lines, "page bigint, block int, line int, text string, top double, bottom double")).collect()}
    assert got == {1: "A\nB\nC\n\nD", 2: ""}


def test_store(spark):
    log = [("a", 1, 10, "save", "t1", "x1", "pdf"), ("a", 2, 20, "save", "t2", "x2", "camera"), ("b", 3, 30, "save", "u", "y", "camera"), ("b", 4, 40, "delete", None, None, None), ("b", 5, 50, "save", "v", "z", "pdf")]
    got = {r.id: r for r in store.replay(spark.createDataFrame(log, "id string, seq int, at bigint, op string, title string, text string, source string")).collect()}
    assert (got["a"].title, got["a"].created_at, got["a"].updated_at, got["a"].source) == ("t2", 10, 20, "pdf")
    assert (got["b"].generation, got["b"].created_at, got["b"].source) == (1, 50, "pdf")


def fold_usage(rows):
    latest, day, used, out = None, "", {}, []
    for seq, now, op, ok in rows:
        behind = latest is not None and now + 600 < latest
        if not behind:
            latest = now if latest is None else max(latest, now)
            today = now // 86400
            if day == "" or today > day:
                day, used = today, {}
        if ok:
            used[op] = used.get(op, 0) + 1
        out.append((seq, behind, used.get(op, 0)))
    return out


def usage_rows(rng, n=60):
    clock, out = 10 * 86400, []
    for seq in range(n):
        clock += rng.choice([60, 7200, 40000, -300, -200000])
        clock = max(clock, 86400)
        out.append((seq, clock, rng.choice(["ocr", "pdf", "export"]), rng.random() < 0.8))
    return out


def usage_frame(spark, rng, devices=6):
    rows = {d: usage_rows(rng) for d in range(devices)}
    flat = [(d, s, t, op, ok) for d, rs in rows.items() for s, t, op, ok in rs]
    return rows, spark.createDataFrame(flat, "device bigint, seq bigint, t bigint, op string, success boolean").select("device", "seq", F.timestamp_seconds("t").alias("now"), "op", "success")


def test_quota_windows_against_the_fold(spark):
    rows, frame = usage_frame(spark, random.Random(2))
    got = {(r.device, r.seq): (r.rollback, r.used) for r in quota.tracked(frame).collect()}
    for d, rs in rows.items():
        assert [(s, *got[d, s]) for s, *_ in rs] == fold_usage(rs)


def test_quota_stream_equals_batch(spark, tmp_path):
    _, frame = usage_frame(spark, random.Random(3))
    frame.repartition(1).sortWithinPartitions("seq").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    got = {(r.device, r.seq): (r.rollback, r.used) for r in quota_stream.drain(stream, "usage_out", f"{tmp_path}/state").collect()}
    assert got == {(r.device, r.seq): (r.rollback, r.used) for r in quota.tracked(frame).collect()}


def test_quota_stream_takes_operations_without_a_limit(spark, tmp_path):
    rows = [(1, k, 1_000_000 + k, op, True) for k, op in enumerate(["share", "ocr", "share", None, None, "ocr"])]
    frame = spark.createDataFrame(rows, "device bigint, seq bigint, t bigint, op string, success boolean").select("device", "seq", F.timestamp_seconds("t").alias("now"), "op", "success")
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = {(r.device, r.seq): (r.rollback, r.used) for r in quota_stream.drain(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), "usage_other", f"{tmp_path}/state").collect()}
    assert got == {(r.device, r.seq): (r.rollback, r.used) for r in quota.tracked(frame).collect()}
    assert [got[1, k][1] for k in range(6)] == [1, 1, 2, 1, 2, 2]


def test_truncation_ties(spark):
    """Of entries of one instant those behind the deletion stay."""
    log = [("a", 1, 10, "save"), (None, 2, 20, "delete_all"), ("b", 1, 20, "save"), ("c", 3, 20, "save"), ("d", 1, 30, "save")]
    frame = spark.createDataFrame(log, "id string, seq int, at bigint, op string")
    assert sorted(r.id for r in store.since_truncate(frame).collect()) == ["c", "d"]
    assert store.since_truncate(frame.where("op = 'save'")).count() == 4


def test_unreadable_stores(spark):
    texts = ['{"version":1,"documents":[]}', "[]", "{broken", "", "12", None, '"text"', '{"documents":[{"id":"a"}]}']
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, json string")
    assert sorted(r.n for r in store.unreadable(frame, "json").collect()) == [2, 3, 4, 6]
    assert store.load(frame, "json", F.current_timestamp()).count() == 1


def test_interstitials(spark):
    calls = [(1, k, float(t)) for k, t in enumerate([0, 10, 20, 30, 40, 50, 400, 410, 420, 1000])]
    got = [r.shown for r in quota.interstitials(spark.createDataFrame(calls, "user bigint, seq bigint, at double")).orderBy("seq").collect()]
    assert got == [False, False, True, False, False, False, True, False, False, True]


def test_usage_file(spark):
    texts = ['{"date":"2024-01-02","ocrCount":3,"pdfCount":-1,"pdfExportCount":"x"}', "{broken", '{"date":"soon","ocrCount":2.5}']
    got = [r.u for r in spark.createDataFrame([(t,) for t in texts], "s string").select(quota.usage_file(F.col("s")).alias("u")).collect()]
    assert tuple(got[0]) == ("2024-01-02", 3, 0, 0)
    assert tuple(got[2]) == ("", 0, 0, 0)


# --- rasters -----------------------------------------------------------------------------


def test_local_mean_and_median():
    v = np.random.default_rng(0).random((9, 13))
    mean, median = raster.local_mean(v, 3), raster.median3(v)
    for y in range(9):
        for x in range(13):
            assert abs(mean[y, x] - v[max(0, y - 3) : y + 4, max(0, x - 3) : x + 4].mean()) < 1e-12
            window = sorted(math.floor(p * 255 + 0.5) for p in v[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].ravel())
            assert median[y, x] == window[len(window) // 2]


@pytest.mark.parametrize("degrees", [3.0, -2.0, 0.0])
def test_skew(degrees):
    v = np.ones((200, 300))
    for base in range(30, 180, 25):
        for x in range(300):
            y = round(base + x * math.tan(math.radians(degrees)))
            v[max(0, y) : max(0, y + 3), x] = 0.1
    assert abs(raster.skew(v) - degrees) <= 0.75


def test_ruling_lines():
    v = np.full((400, 600), 0.9)
    for y in (40, 130, 220, 310, 360):
        v[y - 1 : y + 2, 40:561] = 0.1
    for x in (40, 200, 380, 560):
        v[40:361, x - 1 : x + 2] = 0.1
    rows, cols = raster.ruling_lines(v, (60.0, 50.0, 540.0, 350.0))
    assert np.allclose(rows, (40, 130, 220, 310, 360), atol=8) and np.allclose(cols, (40, 200, 380, 560), atol=8)
    assert raster.ruling_lines(np.full((30, 30), 0.5), (0, 0, 30, 30)) == ([], [])


def test_document_corners():
    y, x = np.mgrid[0:120, 0:160]
    v = np.where((x > 20 + y * 0.1) & (x < 140 + y * 0.1) & (y > 12) & (y < 104), 0.9, 0.1)
    corners = raster.document_quad(v)
    assert np.allclose(corners, [(22, 13), (141, 13), (150, 103), (31, 103)], atol=2)
    assert raster.document_quad(np.full((64, 64), 0.5)) is None


def test_area_means_are_overlaps_weighted():
    v = np.random.default_rng(1).random((7, 11))
    assert raster.shrink(v, 11) is v and np.allclose(raster.shrink(np.kron(v, np.ones((3, 3))), 11), v)
    for width in (1, 4, 10):
        rows = max(1, math.floor(7 * width / 11 + 0.5))
        parts = [np.array([[max(0.0, min(k + 1, (i + 1) * n / m) - max(k, i * n / m)) for k in range(n)] for i in range(m)]) * m / n for n, m in ((7, rows), (11, width))]
        assert np.allclose(raster.shrink(v, width), parts[0] @ v @ parts[1].T, atol=1e-12)
        assert raster.thin(v, width).shape == (rows, width)


def test_wide_rasters_are_measured_on_smaller_copies():
    v = np.ones((700, 1100))
    for base in range(100, 600, 60):
        for x in range(1100):
            v[round(base + x * math.tan(math.radians(2.0))) :][:8, x] = 0.1
    assert abs(raster.skew(v) - 2.0) <= 0.75
    lined = np.full((1300, 2000), 0.9)
    for y in (140, 700, 1200):
        lined[y - 4 : y + 5, 140:1860] = 0.1
    for x in (140, 900, 1860):
        lined[140:1200, x - 4 : x + 5] = 0.1
    rows, cols = raster.ruling_lines(lined, (200.0, 180.0, 1800.0, 1160.0))
    assert np.allclose(rows, (140, 700, 1200), atol=8) and np.allclose(cols, (140, 900, 1860), atol=8)
    y, x = np.mgrid[0:900, 0:1200]
    page = np.where((x > 150 + y * 0.1) & (x < 1050 + y * 0.1) & (y > 90) & (y < 780), 0.9, 0.1)
    assert np.allclose(raster.document_quad(page), [(159, 91), (1059, 91), (1127, 779), (228, 779)], atol=14)
    wide = np.random.default_rng(2).random((30, 1500))
    small = raster.local_mean(raster.shrink(wide, 640), 3)
    assert raster.mean_map(wide)[29, 1499] == small[12, 639] and raster.mean_map(wide)[0, 3] == small[0, 1]


def test_planted_perspective_is_undone():
    t, u = np.mgrid[0:120, 0:160]
    flat = 0.5 + 0.4 * np.sin(u / 9) * np.cos(t / 7)
    corners = [(30.0, 20.0), (170.0, 35.0), (185.0, 150.0), (18.0, 138.0)]
    seen = raster.warp(flat, _inverse(corners, 160, 120), 200, 170)
    assert np.abs(raster.warp(seen, corners, 160, 120) - flat)[2:-2, 2:-2].max() < 0.03
    assert np.array_equal(raster.warp(flat, [(0, 0), (159, 0), (159, 119), (0, 119)], 160, 120).round(9), flat.round(9))


def _inverse(corners, w, h):
    """Where the corners of a 200 x 170 picture lie on the flat page, if the page's corners are seen at these places."""
    rows, known = [], []
    for (x, y), (u, t) in zip(corners, [(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)], strict=True):
        rows += [[x, y, 1, 0, 0, 0, -x * u, -y * u], [0, 0, 0, x, y, 1, -x * t, -y * t]]
        known += [u, t]
    a = np.append(np.linalg.solve(np.array(rows), known), 1).reshape(3, 3)
    return [tuple((a @ [x, y, 1])[:2] / (a @ [x, y, 1])[2]) for x, y in ((0, 0), (199, 0), (199, 169), (0, 169))]


@pytest.mark.parametrize("degrees", [3.0, -2.0])
def test_tilted_lines_come_level(degrees):
    v = np.ones((200, 300))
    for base in range(30, 180, 25):
        for x in range(300):
            y = round(base + x * math.tan(math.radians(degrees)))
            v[max(0, y) : max(0, y + 3), x] = 0.1
    out = raster.upright(v)
    assert out.shape > v.shape and out[0, 0] == out[-1, -1] == 255 and abs(raster.skew(out / 255)) < raster.SKEW_ROTATE


def test_handwriting_pages(spark):
    y, x = np.mgrid[0:120, 0:160]
    page = np.where((x > 20 + y * 0.1) & (x < 140 + y * 0.1) & (y > 12) & (y < 104), 0.9, 0.1)
    rows = [(1, 160, 120, page.ravel().tolist()), (2, 64, 64, [0.5] * 4096), (3, 1, 1, [0.5])]
    table = spark.createDataFrame(rows, "img_id long, w int, h int, px array<double>")
    got = {r.img_id: r for r in raster.handwriting_pages(table).collect()}
    assert (got[2].w, got[2].h, got[3].w, got[3].h) == (64, 64, 1, 1)
    cut = {r.img_id: r for r in raster.rectified(table).collect()}
    assert abs(cut[1].w - 119) <= 1 and abs(cut[1].h - 90) <= 1 and np.array_equal(got[1].px, raster.upright(np.array(cut[1].px).reshape(cut[1].h, cut[1].w)).ravel())
    assert np.mean(np.array(cut[1].px) > 0.8) > 0.97 and cut[2].px == rows[1][3]
    assert raster.handwriting_pages(table.limit(0)).count() == 0


def test_image_size(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452000002800000012C")
    def jpeg(w, h, before=b""):
        return b"\xff\xd8\xff\xe0\x00\x10" + bytes(14) + before + b"\xff\xc2\x00\x11\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes(12)

    exif = b"\xff\xe1\xff\xfe" + b"\xff\xc0" * 32766 + b"\xff\xff\xd0" + b"\xff\xc4\x00\x04ab"
    webp = [b"VP8X" + bytes(8) + (639).to_bytes(3, "little") + (299).to_bytes(3, "little"), b"VP8L" + bytes(4) + b"\x2f" + (639 | 299 << 14 | 1 << 28).to_bytes(4, "little"), b"VP8 " + bytes(10) + (640 | 1 << 14).to_bytes(2, "little") + (300 | 2 << 14).to_bytes(2, "little")]
    others = [jpeg(640, 300), jpeg(640, 300, exif), *(b"RIFF" + bytes(4) + b"WEBP" + x + bytes(4) for x in webp), jpeg(0, 300), jpeg(9, 9)[:21] + b"\xff\xda" + bytes(20), b"\xff\xd8\xff" + b"\xff" * 40, b"RIFF" + bytes(4) + b"WEBPVP8Z" + bytes(20)]
    got = [r.s for r in spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(others)], "k int, c binary").select("k", files.image_size(F.col("c")).alias("s")).orderBy("k").collect()]
    assert [tuple(s) if s else None for s in got] == [(640, 300)] * 5 + [None] * 4
    rows = [(png,), (png[:10],), (b"BM" + bytes(16) + (640).to_bytes(4, "little") + (300).to_bytes(4, "little"),), (b"x" * 40,)]
    got = [r.s for r in spark.createDataFrame([(bytearray(b),) for (b,) in rows], "c binary").select(files.image_size(F.col("c")).alias("s")).collect()]
    assert [tuple(s) if s else None for s in got] == [(640, 300), None, (640, 300), None]


def test_share_route_counts_utf16_units(spark):
    texts = ["a" * 100_000, "a" * 100_001, "🙂" * 50_000, "🙂" * 50_001]
    got = spark.createDataFrame(list(enumerate(texts)), "n int, t string").orderBy("n").select(files.share_route(F.col("t")).alias("r")).collect()
    assert [r.r for r in got] == ["inline", "file", "inline", "file"]


def test_stages_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from folioflow.operators import stages

    session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stages._folder(session)
