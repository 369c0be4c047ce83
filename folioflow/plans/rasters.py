"""Queries over rasters: embeddings as small images, and drawn pages.

The SQL works on pixels as rows; local means are two passes of window sums, not an integral image.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import raster
from ..sources import pictures
from .sources import table


def small(spark, sf_dir):
    """Each vector as 8 x 8 pixels between its least and greatest value."""
    e = F.col("embedding").cast("array<double>")
    px = F.transform(e, lambda x: (x - F.array_min(e)) / (F.array_max(e) - F.array_min(e)))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), F.lit(8).alias("w"), F.lit(8).alias("h"), px.alias("px"))


def stacked(spark, sf_dir):
    """Sixteen neighbouring vectors as 32 x 32 pixels, 0 to 1 over all sixteen."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("img_id"), "vec_id", F.col("embedding").cast("array<double>").alias("e"))
    whole = rows.groupBy("img_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "e"))), lambda x: x["e"])).alias("e")).where(F.size("e") == 1024)
    e = F.col("e")
    return whole.select("img_id", F.lit(32).alias("w"), F.lit(32).alias("h"), F.transform(e, lambda x: (x - F.array_min(e)) / (F.array_max(e) - F.array_min(e))).alias("px"))


_PIXELS = """select vec_id as img_id, (i - 1) % 8 as x, (i - 1) // 8 as y, (v - min(v) over p) / (max(v) over p - min(v) over p) as v, 8 as w, 8 as h
from (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings) window p as (partition by vec_id)"""
_STACKED = """select img_id, k % 32 as x, k // 32 as y, (v - min(v) over p) / (max(v) over p - min(v) over p) as v, 32 as w, 32 as h
from (select vec_id // 16 as img_id, (vec_id % 16) * 64 + i - 1 as k, v, count(*) over (partition by vec_id // 16) as n from (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings)) where n = 1024 window p as (partition by img_id)"""


def _box(px: str, radius: int) -> str:
    """Pixels with the mean m of their clipped square."""
    across = f"partition by img_id, y order by x rows between {radius} preceding and {radius} following"
    down = f"partition by img_id, x order by y rows between {radius} preceding and {radius} following"
    return f"(select img_id, x, y, v, w, h, sum(s) over w2 / sum(c) over w2 as m from (select *, sum(v) over w1 as s, count(*) over w1 as c from ({px}) window w1 as ({across})) window w2 as ({down}))"


def _pixels(out):
    return out.select("img_id", "w", F.posexplode("px").alias("i", "v")).select("img_id", (F.col("i") % F.col("w")).cast("bigint").alias("x"), F.floor(F.col("i") / F.col("w")).alias("y"), "v")


def _levels(out):
    return _pixels(out).select("img_id", "x", "y", F.col("v").cast("bigint").alias("level"))


def integral_mean(spark, sf_dir):
    return _pixels(raster.filtered(small(spark, sf_dir), raster.mean_map)).select("img_id", "x", "y", F.round("v", 6).alias("mean"))


INTEGRAL_MEAN = f"select img_id, x, y, round(m, 6) as mean from {_box(_PIXELS, 3)}"
_FLAT = f"select img_id, x, y, w, h, round(least(greatest(v / greatest(m, 0.02::double) * 255, 0), 255)) as level from {_box(_PIXELS, 3)}"


def area_means(spark, sf_dir):
    """32 x 32 pixels at a width of 20, so that most pixels belong to two means."""
    shrunk = raster.filtered(stacked(spark, sf_dir), lambda v: raster.shrink(v, 20))
    return _pixels(shrunk).select("img_id", "x", "y", F.round("v", 6).alias("mean"))


def _part(px: str, axis: str) -> str:
    """Means over 1.6 pixels along an axis, pixels weighted by what a mean covers of them."""
    other = "y" if axis == "x" else "x"
    return f"""(select img_id, {other}, i as {axis}, sum(v * (least({axis} + 1, (i + 1) * 1.6::double) - greatest({axis}, i * 1.6::double))) / 1.6::double as v, 20 as w, 20 as h
 from ({px}), range(20) as r(i) where {axis} + 1 > i * 1.6::double and {axis} < (i + 1) * 1.6::double group by img_id, {other}, i)"""


_AREA = f"select * from {_part('select * from ' + _part(_STACKED, 'x'), 'y')}"
AREA_MEANS = f"select img_id, x, y, round(v, 6) as mean from ({_AREA})"


def wide_mean_map(spark, sf_dir):
    """Local means of 32 x 32 pixels, looked up in the map of a copy 20 wide."""
    return _pixels(raster.filtered(stacked(spark, sf_dir), lambda v: raster.mean_map(v, 20))).select("img_id", "x", "y", F.round("v", 6).alias("mean"))


WIDE_MEAN_MAP = f"""select m.img_id, a.x, b.y, round(m.m, 6) as mean from {_box(_AREA, 3)} m
join (select i as x, least(round(i * 0.625::double), 19) as at from range(32) as r(i)) a on a.at = m.x join (select i as y, least(round(i * 0.625::double), 19) as at from range(32) as r(i)) b on b.at = m.y"""


def illumination(spark, sf_dir):
    return _levels(raster.filtered(small(spark, sf_dir), raster.flatten_light))


ILLUMINATION = f"select img_id, x, y, cast(level as bigint) as level from ({_FLAT})"


def _stretch(px: str) -> str:
    return f"""(with p as ({px}), n as (select img_id, floor(count(*) * 0.02::double) as clip from p group by img_id),
hi as (select img_id, lv, sum(k) over (partition by img_id order by lv) as up, sum(k) over (partition by img_id order by lv desc) as down from (select img_id, round(v * 255) as lv, count(*) as k from p group by all)),
e as (select img_id, min(lv) filter (where up > clip) as lo, max(lv) filter (where down > clip) as hi from hi join n using (img_id) group by img_id)
select p.img_id, x, y, w, h, case when hi - lo < 16 then round(v * 255) else round(least(greatest((v * 255 - lo) * (255::double / (hi - lo)), 0), 255)) end as level from p join e using (img_id))"""


def contrast_stretch(spark, sf_dir):
    return _levels(raster.filtered(small(spark, sf_dir), raster.stretch))


CONTRAST_STRETCH = f"select img_id, x, y, cast(level as bigint) as level from {_stretch(_PIXELS)}"


def _median(px: str) -> str:
    return f"(with p as (select img_id, x, y, w, h, round(v * 255) as lv from ({px})) select a.img_id, a.x, a.y, any_value(a.w) as w, any_value(a.h) as h, list_sort(list(b.lv))[count(*) // 2 + 1] as level from p a join p b on a.img_id = b.img_id and b.x between a.x - 1 and a.x + 1 and b.y between a.y - 1 and a.y + 1 group by a.img_id, a.x, a.y)"


def median3(spark, sf_dir):
    return _levels(raster.filtered(small(spark, sf_dir), raster.median3))


MEDIAN3 = f"select img_id, x, y, cast(level as bigint) as level from {_median(_PIXELS)}"


def adaptive_threshold(spark, sf_dir):
    return _levels(raster.filtered(small(spark, sf_dir), raster.threshold))


ADAPTIVE = f"select img_id, x, y, case when v < m * 0.9::double then 0 else 255 end as level from {_box(_PIXELS, 3)}"


def handwriting_binary(spark, sf_dir):
    """The whole chain: light, contrast, noise, threshold."""
    return _levels(raster.filtered(small(spark, sf_dir), raster.binary))


_AS_V = lambda s: f"select img_id, x, y, level / 255 as v, w, h from {s}"
_CHAIN = _AS_V(_median(_AS_V(_stretch(_AS_V(f"({_FLAT})")))))
HANDWRITING = f"select img_id, x, y, case when v < m * 0.9::double then 0 else 255 end as level from {_box(_CHAIN, 3)}"


def otsu(spark, sf_dir):
    return raster.measured(small(spark, sf_dir), "threshold", raster.otsu).select("img_id", F.round(F.col("threshold") * 255).cast("bigint").alias("level"))


OTSU = f"""with hi as (select img_id, cast(round(v * 255) as bigint) as lv, count(*) as k from ({_PIXELS}) group by all),
al as (select img_id, lv, coalesce(k, 0) as k from (select distinct img_id from hi) cross join (select unnest(range(256)) as lv) left join hi using (img_id, lv)),
cu as (select img_id, lv, sum(k) over o as wb, sum(lv * k) over o as sb, sum(k) over a as n, sum(lv * k) over a as s from al window o as (partition by img_id order by lv), a as (partition by img_id)),
bt as (select img_id, lv, wb * (n - wb) * pow(sb / wb - (s - sb) / (n - wb), 2) as b from cu where wb > 0 and n > wb)
select i.img_id, coalesce(lv, 127) as level from (select distinct img_id from hi) i left join (select * from (select *, row_number() over (partition by img_id order by round(b, 9) desc, lv) as o from bt where b > 0) where o = 1) using (img_id)"""


def skew_estimate(spark, sf_dir):
    return raster.measured(stacked(spark, sf_dir), "degrees", raster.skew)


SKEW = f"""with p as ({_STACKED}), d as (select img_id, x, y from (select *, avg(v) over (partition by img_id) as m from p) where v < m * 0.8::double),
a as (select -4 + 0.5::double * unnest(range(17)) as g), s as (select img_id, g, sum(k * k) as sc from (select img_id, g, round(y - x * tan(g * pi() / 180)) as rw, count(*) as k from d, a group by all) group by all),
b as (select img_id, arg_min(g, {{'a': -sc, 'b': g}}) as g from s group by img_id)
select i.img_id, coalesce(case when n >= 50 then g end, 0)::double as degrees from (select distinct img_id from p) i left join b using (img_id) left join (select img_id, count(*) as n from d group by img_id) using (img_id)"""


def drawn(spark, sf_dir):
    """Ruled pages of 120 x 90 pixels on a textured ground, one per nation."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("img_id"))
    px = n.select("img_id", F.explode(F.sequence(F.lit(0), F.lit(120 * 90 - 1))).alias("i")).select("img_id", "i", (F.col("i") % 120).alias("x"), F.floor(F.col("i") / 120).alias("y"))
    gray = F.expr(_GRAY)
    rows = px.select("img_id", "i", (gray / 255).alias("v")).groupBy("img_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("px"))
    return rows.select("img_id", F.lit(120).alias("w"), F.lit(90).alias("h"), "px", F.lit(12.0).alias("x0"), F.lit(14.0).alias("y0"), F.lit(106.0).alias("x1"), F.lit(77.0).alias("y1"))


_GRAY = "case when (y in (10 + img_id % 5, 11 + img_id % 5, 45, 80) and x >= 8 and x < 112) or (x in (8, 60 + img_id % 7, 111) and y >= 10 and y <= 80 and img_id % 4 <> 3) then 40.0D else 200.0D + (x * 7 + y * 13 + img_id * 11) % 17 end"


def ruling_lines(spark, sf_dir):
    found = raster.lines(drawn(spark, sf_dir))
    return found.select("img_id", F.array_join(F.transform("horizontal", lambda x: F.round(x, 3).cast("string")), ",").alias("horizontal"), F.array_join(F.transform("vertical", lambda x: F.round(x, 3).cast("string")), ",").alias("vertical"))


# the box 12..106 x 14..77 with its margins is columns 6..111 and rows 7..83 of the page
_DRAWN = f"select n_nationkey as img_id, x - 6 as x, y - 7 as y, ({_GRAY.replace('img_id', 'n_nationkey').replace('D', '::double')}) / 255 as v, 106 as w, 77 as h from nation, (select unnest(range(6, 112)) as x), (select unnest(range(7, 84)) as y)"


def _runs(a: str, b: str, least: int, off: int) -> str:
    return f"""(select img_id, string_agg(cast(round({off} + p, 3) as varchar), ',' order by p) as ps from (select img_id, g, sum(a_) / count(*) as p from (
 select img_id, a_, sum(case when a_ - pa > 6 then 1 else 0 end) over (partition by img_id order by a_) as g from (select img_id, a_, lag(a_) over (partition by img_id order by a_) as pa from (
 select img_id, {a} as a_ from (select img_id, {a}, {b} - row_number() over (partition by img_id, {a} order by {b}) as isl from mask) group by img_id, {a}, isl having count(*) >= {least}) group by img_id, a_)) group by img_id, g) group by img_id)"""


RULING = f"""with mask as (select img_id, x, y from {_box(_DRAWN, 5)} where v < m * 0.92::double)
select n.n_nationkey as img_id, coalesce(r.ps, '') as horizontal, coalesce(c.ps, '') as vertical from nation n left join {_runs('y', 'x', 58, 7)} r on r.img_id = n.n_nationkey left join {_runs('x', 'y', 42, 6)} c on c.img_id = n.n_nationkey"""


def pages_in_view(spark, sf_dir):
    """Bright slanted pages on a dark ground, 64 x 48 pixels, one per nation."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("img_id"))
    px = n.select("img_id", F.explode(F.sequence(F.lit(0), F.lit(64 * 48 - 1))).alias("i")).select("img_id", "i", (F.col("i") % 64).alias("x"), F.floor(F.col("i") / 64).alias("y"))
    inside = F.expr("x >= 4 + img_id % 6 + y * (img_id % 3) / 24 and x <= 58 - img_id % 5 + y * (img_id % 3) / 24 and y >= 3 + img_id % 4 + x * (img_id % 2) / 32 and y <= 42 - img_id % 3 and img_id % 8 <> 7")
    rows = px.select("img_id", "i", F.when(inside, 0.85).otherwise(0.2).alias("v")).groupBy("img_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("px"))
    return rows.select("img_id", F.lit(64).alias("w"), F.lit(48).alias("h"), "px")


def document_quads(spark, sf_dir):
    """Corners of pages, their plausibility and whether and to what size they would be rectified."""
    c = F.col
    q = raster.quads(pages_in_view(spark, sf_dir))
    quad = geometry.Quad((c("x0"), c("y0")), (c("x1"), c("y1")), (c("x2"), c("y2")), (c("x3"), c("y3")))
    w, h = c("w").cast("double"), c("h").cast("double")
    tw, th = quad.target_size(w, h)
    ok = quad.plausible(w, h)
    return q.select("img_id", *[f"{a}{k}" for k in range(4) for a in "xy"], ok.alias("plausible"), (ok & ~quad.nearly_full(w, h)).alias("rectify"), tw.alias("target_width"), th.alias("target_height"))


#: The pages' pixels are one component each, so corners are the pixels of least and greatest x + y and x - y; of
#: equal ones the lower, for the least difference the upper.
DOCUMENT_QUADS = """with px as (select n_nationkey::bigint as img_id, i % 64 as x, i // 64 as y from nation, range(64 * 48) as r(i)),
b as (select * from px where x >= 4 + img_id % 6 + y * (img_id % 3) / 24 and x <= 58 - img_id % 5 + y * (img_id % 3) / 24 and y >= 3 + img_id % 4 + x * (img_id % 2) / 32 and y <= 42 - img_id % 3 and img_id % 8 <> 7),
c as (select img_id, arg_min(x, 100 * (x + y) - y)::double as x0, arg_min(y, 100 * (x + y) - y)::double as y0, arg_max(x, 100 * (x - y) + y)::double as x1, arg_max(y, 100 * (x - y) + y)::double as y1,
 arg_max(x, 100 * (x + y) + y)::double as x2, arg_max(y, 100 * (x + y) + y)::double as y2, arg_min(x, 100 * (x - y) + y)::double as x3, arg_min(y, 100 * (x - y) + y)::double as y3 from b group by img_id having count(*) between 64 * 48 * 0.35::double and 64 * 48 * 0.97::double),
s as (select *, sqrt((x0-x1)*(x0-x1)+(y0-y1)*(y0-y1)) as t, sqrt((x3-x2)*(x3-x2)+(y3-y2)*(y3-y2)) as b, sqrt((x0-x3)*(x0-x3)+(y0-y3)*(y0-y3)) as l, sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2)) as r,
 abs((x0*y1-x1*y0)+(x1*y2-x2*y1)+(x2*y3-x3*y2)+(x3*y0-x0*y3))/2 as a, greatest(x0,x1,x2,x3)-least(x0,x1,x2,x3) as bw, greatest(y0,y1,y2,y3)-least(y0,y1,y2,y3) as bh from c),
d as (select *, t >= 64*0.3::double and b >= 64*0.3::double and l >= 48*0.3::double and r >= 48*0.3::double and t <= 2*b and b <= 2*t and l <= 2*r and r <= 2*l
 and (t+b)/2/greatest((l+r)/2,1) between 0.35::double and 3 and bw > 0 and bh > 0 and a >= bw*bh*0.55::double as plausible,
 greatest(abs(x0), abs(y0), abs(x1-63), abs(y1), abs(x2-63), abs(y2-47), abs(x3), abs(y3-47)) <= 48*0.02::double as full_frame from s)
select img_id, x0, y0, x1, y1, x2, y2, x3, y3, plausible, plausible and not full_frame as rectify, least(greatest(cast(round((t+b)/2) as bigint), 32), 64) as target_width, least(greatest(cast(round((l+r)/2) as bigint), 32), 48) as target_height from d"""

# places (x, y) of a picture k: the page, a smaller sheet beside it, a bridge between both in every fifth
_PAGE = "(x between 14 + k % 5 and 56 - k % 3 and y between 5 + k % 4 and 35 - k % 2)"
_SHEET = "(x between 2 and 3 + k % 6 and y between 4 and 20 + k % 12)"
_BRIDGE = "(k % 5 = 1 and y = 12 and x between 2 and 20)"


def page_components(spark, sf_dir):
    """Largest bright component of 64 x 40 pixels for each vector: a page, a smaller sheet that some bridges tie to it (with equal
    corners among them), and noise by the vector's signs, in components of all sizes, right of a gap."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), F.col("vec_id").alias("k"), F.col("embedding").alias("e"))
    bright = f"{_PAGE} or {_SHEET} or {_BRIDGE} or (x >= 59 and e[(x * 5 + y * 3) % 64] > 0)"
    value = bright.replace("x", "(i % 64)").replace("y", "(i div 64)")
    px = F.expr(f"transform(sequence(0, 64 * 40 - 1), i -> case when {value} then 0.85D else 0.2D end)")
    return raster.bright_components(e.select("img_id", F.lit(64).alias("w"), F.lit(40).alias("h"), px.alias("px")))


PAGE_COMPONENTS = f"""with b as (select k as img_id, x, y from (select vec_id as k, i % 64 as x, i // 64 as y from embeddings, range(64 * 40) as r(i)) where {_PAGE} or (k % 5 = 1 and ({_SHEET} or {_BRIDGE})))
select img_id, count(*) as n, arg_min(x, 100 * (x + y) - y)::double as x0, arg_min(y, 100 * (x + y) - y)::double as y0, arg_max(x, 100 * (x - y) + y)::double as x1, arg_max(y, 100 * (x - y) + y)::double as y1,
arg_max(x, 100 * (x + y) + y)::double as x2, arg_max(y, 100 * (x + y) + y)::double as y2, arg_min(x, 100 * (x - y) + x)::double as x3, arg_min(y, 100 * (x - y) + x)::double as y3 from b group by img_id"""


def warped(spark, sf_dir):
    """Slanted parts of 32 x 32 pixels, straightened to 20 x 16."""
    k = F.col("img_id") % 3
    places = [(2 + k, F.lit(1)), (26 + k, F.lit(3)), (28 + k, F.lit(29)), (4 + k, F.lit(27))]
    corners = {f"{a}{n}": c.cast("double") for n, place in enumerate(places) for a, c in zip("xy", place, strict=True)}
    rows = stacked(spark, sf_dir).withColumns(corners | {"target_width": F.lit(20), "target_height": F.lit(16)})
    return _pixels(raster.warped(rows)).select("img_id", "x", "y", F.round("v", 6).alias("value"))


def untilted(spark, sf_dir):
    """32 x 32 pixels turned by five degrees, white where nothing is."""
    return _pixels(raster.filtered(stacked(spark, sf_dir), lambda v: raster.untilt(v, 5.0))).select("img_id", "x", "y", F.round("v", 6).alias("value"))


def _between(grid: str) -> str:
    """Pixels looked up at the places (sx, sy) of a grid (img_id, x, y, sx, sy); none outside."""
    return f"""(with p as ({_STACKED}) select g.img_id, g.x, g.y, sum(p.v * (1 - abs(p.x - g.sx)) * (1 - abs(p.y - g.sy))) as v from {grid} g join p on p.img_id = g.img_id
 and p.x in (floor(g.sx), floor(g.sx) + 1) and p.y in (floor(g.sy), floor(g.sy) + 1) where g.sx between 0 and 31 and g.sy between 0 and 31 group by g.img_id, g.x, g.y)"""


_IDS = f"(select distinct img_id from ({_STACKED}))"
_SLANTED = f"(select img_id, i as x, j as y, 2 + img_id % 3 + 24 * i / 19::double + 2 * j / 15::double as sx, 1 + 2 * i / 19::double + 26 * j / 15::double as sy from {_IDS}, range(20) as a(i), range(16) as b(j))"
WARPED = f"select img_id, x, y, round(v, 6) as value from {_between(_SLANTED)}"
_TURNED = f"(select img_id, i as x, j as y, 15.5::double + (i - 17) * cos(radians(5)) - (j - 17) * sin(radians(5)) as sx, 15.5::double + (i - 17) * sin(radians(5)) + (j - 17) * cos(radians(5)) as sy from {_IDS}, range(35) as a(i), range(35) as b(j))"
UNTILTED = f"select img_id, x, y, round(coalesce(v, 1), 6) as value from {_TURNED} left join {_between(_TURNED)} using (img_id, x, y)"

def decoded_images(spark, sf_dir):
    """Levels of PNG files put together from vectors: 8 x 8 pixels, the five filters in turn; every seventh has a wrong checksum and is not read."""
    two, eight = lambda x: f"lpad(hex({x}), 2, '0')", lambda x: f"lpad(hex({x}), 8, '0')"
    piece = lambda kind, body, crc: f"concat({eight(f'length({body}) div 2')}, '{kind}', {body}, {eight(f'(crc32(unhex(concat({kind!r}, {body}))) + {crc}) % 4294967296')})"
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id as img_id", "transform(embedding, v -> cast(floor(abs(cast(v as double) * 1000)) % 256 as bigint)) as r")
    lines = e.selectExpr("img_id", "flatten(transform(sequence(0, 7), y -> concat(array((img_id + y) % 5), slice(r, y * 8 + 1, 8)))) as d")
    sums = lines.selectExpr("img_id", "d", "(1 + aggregate(d, 0L, (n, x) -> n + x)) % 65521 as a", "(72 + aggregate(transform(d, (x, i) -> x * (72 - i)), 0L, (n, x) -> n + x)) % 65521 as b")
    stored = sums.selectExpr("img_id", f"concat('7801014800B7FF', array_join(transform(d, x -> {two('x')}), ''), {eight('b * 65536 + a')}) as z", "'00000008000000080800000000' as ihdr", "'' as none")
    whole = stored.selectExpr("img_id", f"unhex(concat('89504E470D0A1A0A', {piece('49484452', 'ihdr', '0')}, {piece('49444154', 'z', 'cast(img_id % 7 = 3 as int)')}, {piece('49454E44', 'none', '0')})) as content")
    return _pixels(pictures.decode(whole, "img_id").where("px is not null")).select("img_id", "x", "y", F.round(F.col("v") * 255).cast("bigint").alias("level"))


#: byte after byte, each from those before it
DECODED_IMAGES = """with recursive f as (select vec_id as img_id, 0 as i, list_transform(embedding, lambda v: cast(floor(abs(v::double * 1000)) as bigint) % 256) as r, []::bigint[] as o from embeddings where vec_id % 7 <> 3
 union all select img_id, i + 1, r, list_append(o, (r[i + 1] + case k when 1 then a when 2 then b when 3 then (a + b) // 2 when 4 then case when abs(b - c) <= abs(a - c) and abs(b - c) <= abs(a + b - 2 * c) then a when abs(a - c) <= abs(a + b - 2 * c) then b else c end else 0 end) % 256)
 from (select *, (img_id + i // 8) % 5 as k, case when i % 8 > 0 then o[i] else 0 end as a, case when i > 7 then o[i - 7] else 0 end as b, case when i % 8 > 0 and i > 7 then o[i - 8] else 0 end as c from f where i < 64))
select img_id, k % 8 as x, k // 8 as y, level from (select img_id, unnest(o) as level, unnest(range(64)) as k from f where i = 64)"""

QUERIES = {
    "decoded_images": (decoded_images, DECODED_IMAGES),
    "integral_mean": (integral_mean, INTEGRAL_MEAN),
    "area_means": (area_means, AREA_MEANS),
    "wide_mean_map": (wide_mean_map, WIDE_MEAN_MAP),
    "illumination": (illumination, ILLUMINATION),
    "contrast_stretch": (contrast_stretch, CONTRAST_STRETCH),
    "median3": (median3, MEDIAN3),
    "adaptive_threshold": (adaptive_threshold, ADAPTIVE),
    "handwriting_binary": (handwriting_binary, HANDWRITING),
    "otsu": (otsu, OTSU),
    "skew_estimate": (skew_estimate, SKEW),
    "ruling_lines": (ruling_lines, RULING),
    "page_components": (page_components, PAGE_COMPONENTS),
    "warped": (warped, WARPED),
    "untilted": (untilted, UNTILTED),
    "document_quads": (document_quads, DOCUMENT_QUADS),
}
