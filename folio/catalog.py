"""All queries of the page engine, by row of the operator inventory (``o018_...``), with their SQL for DuckDB.

The SQL is written for itself, over views of the same pages; every computed column is cast alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import rasters
from folio.kernels import components, masks, vision
from folio.operators import areas, points, profiles, regions
from folio.sources import batch, images

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PX = """px AS (SELECT vec_id AS page_id, i // 8 AS y, i % 8 AS x,
  CAST(least(255, greatest(0, floor((CAST(embedding[i + 1] AS DOUBLE) + 0.5) * 255))) AS BIGINT) AS v FROM embeddings, range(64) t(i))"""
PXC = """pxc AS (SELECT vec_id AS page_id, j // 8 AS y, j % 8 AS x,
  CAST(least(255, greatest(0, floor((CAST(embedding[j + 1] AS DOUBLE) + 0.5) * 255))) AS BIGINT) AS b,
  CAST(least(255, greatest(0, floor((CAST(embedding[(j + 21) % 64 + 1] AS DOUBLE) + 0.5) * 255))) AS BIGINT) AS g,
  CAST(least(255, greatest(0, floor((CAST(embedding[(j + 42) % 64 + 1] AS DOUBLE) + 0.5) * 255))) AS BIGINT) AS r FROM embeddings, range(64) t(j))"""
SPREAD = "spr AS (SELECT page_id // 2 AS page_id, y, x + 8 * (page_id % 2) AS x, v FROM px)"
TEXT = """chars AS (SELECT doc_id, text, length(text) - length(text) % 64 AS n FROM documents),
  pxt AS (SELECT doc_id AS page_id, i // 64 AS y, i % 64 AS x, CAST(least(255, ord(c)) AS BIGINT) AS v
  FROM (SELECT doc_id, n, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM chars) WHERE i < n)"""
WHOLE_TEXT = """whole AS (SELECT doc_id AS page_id, i // 64 AS y, i % 64 AS x, CAST(least(255, ord(c)) AS BIGINT) AS v
  FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM documents))"""
FILES = """files AS (SELECT page_id, 'scans/h' || CAST(page_id % 7 AS VARCHAR) AS folder, 'Page' || CAST(page_id AS VARCHAR) || CASE WHEN page_id % 3 = 0 THEN 'b' ELSE '' END AS base_name,
  CASE page_id % 5 WHEN 0 THEN 'tif' WHEN 1 THEN 'bmp' WHEN 2 THEN 'jpg' WHEN 3 THEN 'txt' ELSE 'png' END AS ext FROM pages)"""


def register(name: str, sql: str | None, *ctes: str):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {', '.join(ctes)} {sql}" if ctes else sql
        return f

    return add


def longs(df: DataFrame, *columns: str, doubles: tuple[str, ...] = ()) -> DataFrame:
    """Whole numbers as bigint; doubles rounded to six places."""
    return df.select(*[F.col(c).cast("bigint").alias(c) for c in columns], *[F.round(F.col(c).cast("double"), 6).alias(c) for c in doubles])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of scans, a file for each web page."""
    p = rasters.table(spark, sf_dir, "pages").select("page_id")
    ext = F.element_at(F.array(*map(F.lit, ("tif", "bmp", "jpg", "txt", "png"))), (F.col("page_id") % 5 + 1).cast("int"))
    name = F.concat(F.lit("Page"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, "b").otherwise(""))
    return p.select("page_id", F.concat(F.lit("scans/h"), (F.col("page_id") % 7).cast("string")).alias("folder"), name.alias("base_name"), ext.alias("ext"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Borders by contrast, then a threshold, then the ink of each page and where it lies."""
    px = rasters.gray_pages(spark, sf_dir)
    clean = points.threshold(profiles.whiten_borders(px, profiles.contrast_borders(px, 8, 8), 8, 8), 128).withColumn("dark", F.col("v") == 0)
    at = lambda f, c: f(F.when(F.col("dark"), F.col(c)))
    out = clean.groupBy("page_id").agg(F.count_if("dark").alias("ink_px"), at(F.min, "y").alias("top"), at(F.max, "y").alias("bottom"), at(F.min, "x").alias("left_x"), at(F.max, "x").alias("right_x"))
    return longs(out, "page_id", "ink_px", "top", "bottom", "left_x", "right_x")


BORDERS = """med AS (SELECT page_id, floor((list_sort(list(v))[len(list(v)) // 2 + 1] + list_sort(list(v))[(len(list(v)) - 1) // 2 + 1]) / 2) AS med FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 GROUP BY page_id),
  off_ AS (SELECT px.*, CAST(abs(v - med) > 30 AS INT) AS bad FROM px JOIN med USING (page_id)),
  rows_ AS (SELECT page_id, y AS i, sum(bad) AS bad, count(*) AS n FROM off_ GROUP BY page_id, y), cols_ AS (SELECT page_id, x AS i, sum(bad) AS bad, count(*) AS n FROM off_ GROUP BY page_id, x),
  depths AS (SELECT r.page_id, top, bottom, left_d, right_d FROM
   (SELECT page_id, least(4, coalesce(min(i) FILTER (bad <= n * 0.4), 8)) AS top, least(4, coalesce(7 - max(i) FILTER (bad <= n * 0.4), 8)) AS bottom FROM rows_ GROUP BY page_id) r JOIN
   (SELECT page_id, least(4, coalesce(min(i) FILTER (bad <= n * 0.4), 8)) AS left_d, least(4, coalesce(7 - max(i) FILTER (bad <= n * 0.4), 8)) AS right_d FROM cols_ GROUP BY page_id) c USING (page_id))"""
register(
    "o054_clean_and_sum",
    """SELECT page_id, CAST(count(*) FILTER (d) AS BIGINT) AS ink_px, CAST(min(y) FILTER (d) AS BIGINT) AS top, CAST(max(y) FILTER (d) AS BIGINT) AS bottom, CAST(min(x) FILTER (d) AS BIGINT) AS left_x, CAST(max(x) FILTER (d) AS BIGINT) AS right_x
    FROM (SELECT page_id, y, x, (y >= top AND y < 8 - bottom AND x >= left_d AND x < 8 - right_d AND v <= 128) AS d FROM px JOIN depths USING (page_id)) GROUP BY page_id""",
    PX,
    BORDERS,
)(flagship)


def over_gray(name: str, op: Callable[[DataFrame], DataFrame], sql: str, *more: str, columns: tuple[str, ...] = ("page_id", "y", "x", "v"), doubles: tuple[str, ...] = ()) -> None:
    """Registers an operator over the 8x8 gray pages."""
    register(name, sql, PX, *more)(lambda spark, sf_dir: longs(op(rasters.gray_pages(spark, sf_dir)), *columns, doubles=doubles))


def over_spreads(name: str, op: Callable[[DataFrame], DataFrame], sql: str, *more: str, columns: tuple[str, ...], doubles: tuple[str, ...] = ()) -> None:
    register(name, sql, PX, SPREAD, *more)(lambda spark, sf_dir: longs(op(rasters.spreads(spark, sf_dir)), *columns, doubles=doubles))


# ---- pixels and places
@register("o018_gray", "SELECT page_id, y, x, CAST(round_even(CAST(299 * r + 587 * g + 114 * b AS DECIMAL(18,3)) / 1000, 0) AS BIGINT) AS v FROM pxc", PXC)
def o018_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = rasters.colour_pages(spark, sf_dir)
    return longs(px.withColumn("v", points.gray(F.col("b"), F.col("g"), F.col("r"))), "page_id", "y", "x", "v")


@register("o033_scale_channels", """SELECT page_id, y, x, CAST(least(255, greatest(0, round_even(b * 0.75, 0))) AS BIGINT) AS b, CAST(least(255, round_even(g * 1.0, 0)) AS BIGINT) AS g, CAST(least(255, round_even(r * 1.5, 0)) AS BIGINT) AS r FROM pxc""", PXC)
def o033_scale_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(points.scale_channels(rasters.colour_pages(spark, sf_dir), red=50, blue=-25), "page_id", "y", "x", "b", "g", "r")


@register("o013_cmyk", """SELECT page_id, y, x, CAST(floor((1 - least(1.0, CAST(b AS DOUBLE) / 255.0 * (1 - CAST(b // 2 AS DOUBLE) / 255.0) + CAST(b // 2 AS DOUBLE) / 255.0)) * 255 + 0.5) AS BIGINT) AS r,
  CAST(floor((1 - least(1.0, CAST(g AS DOUBLE) / 255.0 * (1 - CAST(b // 2 AS DOUBLE) / 255.0) + CAST(b // 2 AS DOUBLE) / 255.0)) * 255 + 0.5) AS BIGINT) AS g,
  CAST(floor((1 - least(1.0, CAST(r AS DOUBLE) / 255.0 * (1 - CAST(b // 2 AS DOUBLE) / 255.0) + CAST(b // 2 AS DOUBLE) / 255.0)) * 255 + 0.5) AS BIGINT) AS b FROM pxc""", PXC)
def o013_cmyk(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = rasters.colour_pages(spark, sf_dir).select("page_id", "y", "x", F.col("b").alias("c"), F.col("g").alias("m"), F.col("r").alias("y_"), F.floor(F.col("b") / 2).alias("k"))
    return longs(points.cmyk_to_rgb(px), "page_id", "y", "x", "r", "g", "b")


over_gray("o019_threshold", lambda p: points.threshold(p, 128), "SELECT page_id, y, x, CAST(CASE WHEN v > 128 THEN 255 ELSE 0 END AS BIGINT) AS v FROM px")
over_gray("o087_invert", points.invert, "SELECT page_id, y, x, 255 - v AS v FROM px")
over_gray("o034_brightness_contrast", lambda p: points.brightness_contrast(p, 10, 50), "SELECT page_id, y, x, CAST(least(255, greatest(0, round_even(v * 1.5 + 10.0, 0))) AS BIGINT) AS v FROM px")
over_gray("o062_crop", lambda p: points.crop(p, 2, 1, 4, 5), "SELECT page_id, y - 1 AS y, x - 2 AS x, v FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 5")
over_gray("o056_manual_borders", lambda p: points.fill_outside(p, 1, 2, 0, 1, 8, 8), "SELECT page_id, y, x, CASE WHEN x >= 1 AND x <= 7 AND y >= 2 AND y <= 6 THEN v ELSE 255 END AS v FROM px")
over_gray("o008_orient", lambda p: points.orient(p, 6, 8, 8), "SELECT page_id, x AS y, 7 - y AS x, v FROM px")
over_gray("o128_resize_nearest", lambda p: points.resize_nearest(p, 8, 8, 5, 11), "SELECT p.page_id, b.i AS y, a.i AS x, v FROM px p, range(5) a(i), range(11) b(i) WHERE p.x = ((2 * a.i + 1) * 8) // 10 AND p.y = ((2 * b.i + 1) * 8) // 22")
over_gray("o098_punch_bands", lambda p: points.edge_bands(p, 8, 8, 2, 1, 1, 0).withColumn("searched", F.col("searched").cast("int")), "SELECT page_id, y, x, CAST(x < 2 OR x >= 7 OR y < 1 OR y >= 8 AS BIGINT) AS searched FROM px", columns=("page_id", "y", "x", "searched"))
over_gray("o130_pack_bits", points.pack_bits, "SELECT page_id, y, x // 8 AS byte, CAST(sum((v // 128) * (1 << CAST(7 - x % 8 AS INT))) AS BIGINT) AS packed FROM px GROUP BY ALL", columns=("page_id", "y", "byte", "packed"))
over_spreads("o124_split_manual", lambda p: points.split_at(p, 16, 50.0, 1), "SELECT page_id, 1 AS side, y, x, v FROM spr WHERE x < 9 UNION ALL SELECT page_id, 2, y, x - 7, v FROM spr WHERE x >= 7", columns=("page_id", "side", "y", "x", "v"))
# ---- neighbourhoods
BOX = """b AS (SELECT p.page_id, p.y, p.x, any_value(p.v) AS v, sum(q.v) AS s, sum(q.v * q.v) AS s2, count(*) AS n FROM px p JOIN px q ON p.page_id = q.page_id AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 GROUP BY p.page_id, p.y, p.x)"""
over_gray("o064_box", lambda p: areas.box_sums(p, 1), "SELECT page_id, y, x, CAST(s AS BIGINT) AS s, CAST(s2 AS BIGINT) AS s2, n FROM b", BOX, columns=("page_id", "y", "x", "s", "s2", "n"))
over_gray("o020_adaptive_mean", lambda p: areas.adaptive_mean(p, 3, 14), "SELECT page_id, y, x, CAST(CASE WHEN v > CAST(s AS DOUBLE) / n - 14 THEN 255 ELSE 0 END AS BIGINT) AS v FROM b", BOX)
over_gray("o021_sauvola", lambda p: areas.sauvola(p, 3, 0.3, 180.0), """SELECT page_id, y, x, CAST(CASE WHEN v > least(255.0, m * (1 + 0.3 * (sqrt(greatest(0.0, m2 - m * m)) / 180.0 - 1))) THEN 255 ELSE 0 END AS BIGINT) AS v
  FROM (SELECT *, CAST(s AS DOUBLE) / n AS m, CAST(s2 AS DOUBLE) / n AS m2 FROM b)""", BOX)
AROUND = "SELECT p.page_id, p.y, p.x, {}(q.v) AS v FROM {} p JOIN {} q ON p.page_id = q.page_id AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 GROUP BY p.page_id, p.y, p.x"
over_gray("o066_dilate", lambda p: areas.morph(p, True), AROUND.format("max", "px", "px"))
over_gray("o066_erode", lambda p: areas.morph(p, False), AROUND.format("min", "px", "px"))
over_gray("o067_open", areas.opened, AROUND.format("max", "e", "e"), f"e AS ({AROUND.format('min', 'px', 'px')})")
over_gray("o067_close", areas.closed, AROUND.format("min", "e", "e"), f"e AS ({AROUND.format('max', 'px', 'px')})")
STENCIL = """c AS (SELECT p.page_id, p.y, p.x, dy, dx, q.v FROM px p, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx), px q
  WHERE q.page_id = p.page_id AND q.y = greatest(0, least(7, p.y + dy)) AND q.x = greatest(0, least(7, p.x + dx)))"""
over_gray("o064_sobel", areas.gradient, "SELECT page_id, y, x, CAST(abs(sum(dx * (2 - abs(dy)) * v)) + abs(sum(dy * (2 - abs(dx)) * v)) AS BIGINT) AS g FROM c GROUP BY page_id, y, x", STENCIL, columns=("page_id", "y", "x", "g"))
over_gray("o065_blur", areas.blur3, "SELECT page_id, y, x, CAST(least(255, round_even(sum((2 - abs(dy)) * (2 - abs(dx)) * v) / 16.0, 0)) AS BIGINT) AS v FROM c GROUP BY page_id, y, x", STENCIL)
# ---- histograms
over_gray("o073_histogram", areas.histogram, "SELECT page_id, v, n, CAST(sum(n) OVER (PARTITION BY page_id ORDER BY v) AS BIGINT) AS cum FROM (SELECT page_id, v, count(*) AS n FROM px GROUP BY ALL)", columns=("page_id", "v", "n", "cum"))
OTSU = """h AS (SELECT page_id, v, count(*) AS c FROM px GROUP BY ALL), hh AS (SELECT page_id, v, CAST(sum(c) OVER r AS BIGINT) AS w, CAST(sum(c * v) OVER r AS BIGINT) AS m, CAST(sum(c) OVER p AS BIGINT) AS n, CAST(sum(c * v) OVER p AS BIGINT) AS s FROM h
  WINDOW r AS (PARTITION BY page_id ORDER BY v), p AS (PARTITION BY page_id)),
  o AS (SELECT page_id, v AS t FROM (SELECT *, CASE WHEN w < n THEN CAST(s * w - m * n AS DOUBLE) * CAST(s * w - m * n AS DOUBLE) / CAST(w * (n - w) AS DOUBLE) ELSE 0.0 END AS apart FROM hh) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY apart DESC, v) = 1)"""
over_gray("o069_otsu", areas.otsu, "SELECT page_id, t FROM o", OTSU, columns=("page_id", "t"))
over_gray("o131_is_binary", lambda p: areas.binary_pages(p).withColumn("is_binary", F.col("is_binary").cast("int")), "SELECT page_id, CAST(b AS BIGINT) AS is_binary, CASE WHEN NOT b THEN t END AS t FROM o JOIN (SELECT page_id, bool_and(v IN (0, 255)) AS b FROM px GROUP BY page_id) USING (page_id)", OTSU, columns=("page_id", "is_binary", "t"))
POINTS = """cdf AS (SELECT page_id, v, sum(n) OVER (PARTITION BY page_id ORDER BY v) AS cum, sum(n) OVER (PARTITION BY page_id) AS total FROM (SELECT page_id, v, count(*) AS n FROM px GROUP BY ALL)),
  q AS (SELECT page_id, min(v) FILTER (cum >= total * 0.05) AS a, min(v) FILTER (cum >= total * 0.95) AS z FROM cdf GROUP BY page_id), bw AS (SELECT page_id, CASE WHEN z > a THEN a ELSE 0 END AS lo, CASE WHEN z > a THEN z ELSE 255 END AS hi FROM q)"""
over_gray("o031_points", lambda p: areas.black_white_points(p, 5.0, 95.0), "SELECT page_id, lo, hi FROM bw", POINTS, columns=("page_id", "lo", "hi"))
over_gray("o031_levels", lambda p: areas.levels(p, 5.0, 95.0, 1.0), "SELECT page_id, y, x, CAST(round_even(least(1.0, greatest(0.0, CAST(v - lo AS DOUBLE) / (hi - lo))) * 255, 0) AS BIGINT) AS v FROM px JOIN bw USING (page_id)", POINTS)
register("o074_medians", "SELECT page_id, CAST(s[33] AS BIGINT) AS upper_median, CAST((s[33] + s[32]) / 2.0 AS DOUBLE) AS mean_median, CAST((s[33] + s[32]) // 2 AS BIGINT) AS cut_median FROM (SELECT page_id, list_sort(list(v)) AS s FROM px GROUP BY page_id)", PX)(
    lambda spark, d: rasters.gray_pages(spark, d).groupBy("page_id").agg(areas.median_of("v").cast("bigint").alias("upper_median"), areas.median_of("v", "mean").cast("double").alias("mean_median"), areas.median_of("v", "truncated").cast("bigint").alias("cut_median"))
)
# ---- profiles
ROWS = "pr AS (SELECT page_id, y AS i, sum(v) AS s, count(*) AS n, sum(CAST(v <= 128 AS INT)) AS ink FROM px GROUP BY ALL)"
COLS = "pc AS (SELECT page_id, x AS i, sum(v) AS s, count(*) AS n, sum(CAST(v <= 128 AS INT)) AS ink FROM {} GROUP BY ALL)"
over_gray("o061_row_profile", lambda p: profiles.profile(p, "y"), "SELECT page_id, i, CAST(s AS BIGINT) AS s, n, CAST(ink AS BIGINT) AS ink FROM pr", ROWS, columns=("page_id", "i", "s", "n", "ink"))
over_gray("o116_moving_average", lambda p: profiles.moving(profiles.profile(p, "x"), 2), "SELECT page_id, i, CAST(sum(ink) OVER w AS BIGINT) AS near, count(*) OVER w AS near_n FROM pc WINDOW w AS (PARTITION BY page_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", COLS.format("px"), columns=("page_id", "i", "near", "near_n"))
STRIPED = """mm AS (SELECT page_id, i, CAST(s AS DOUBLE) / n AS mean FROM pr), oo AS (SELECT page_id, i, abs(mean - avg(mean) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS off_ FROM mm),
  st AS (SELECT page_id, i, round(off_, 9) > round(1.5 * avg(off_) OVER (PARTITION BY page_id), 9) AS striped FROM oo)"""
over_gray("o093_stripes", lambda p: profiles.stripes(p, "y", 1.5).withColumn("striped", F.col("striped").cast("int")), "SELECT page_id, i, CAST(striped AS BIGINT) AS striped FROM st", ROWS, STRIPED, columns=("page_id", "i", "striped"))
over_gray("o093_remove_stripes", lambda p: profiles.remove_stripes(p, "y", 1.5), """SELECT f.page_id, f.i AS y, px.x, px.v FROM (SELECT a.page_id, a.i, coalesce(min(b.i) FILTER (NOT b.striped AND abs(b.i - a.i) = d), any_value(a.i)) AS src
  FROM st a JOIN st b ON a.page_id = b.page_id JOIN (SELECT a.page_id, a.i, min(abs(b.i - a.i)) FILTER (NOT b.striped) AS d FROM st a JOIN st b ON a.page_id = b.page_id GROUP BY ALL) m ON m.page_id = a.page_id AND m.i = a.i GROUP BY a.page_id, a.i) f
  JOIN px ON px.page_id = f.page_id AND px.y = f.src""", ROWS, STRIPED)
over_gray("o054_contrast_borders", lambda p: profiles.contrast_borders(p, 8, 8), "SELECT page_id, CAST(top AS BIGINT) AS top, CAST(bottom AS BIGINT) AS bottom, CAST(left_d AS BIGINT) AS \"left\", CAST(right_d AS BIGINT) AS \"right\" FROM depths", BORDERS, columns=("page_id", "top", "bottom", "left", "right"))
over_spreads("o118_split_column", lambda p: profiles.split_column(p, 16), """SELECT page_id, i AS split_x, near, near_n FROM (SELECT page_id, i, CAST(sum(ink) OVER w AS BIGINT) AS near, count(*) OVER w AS near_n FROM pc WINDOW w AS (PARTITION BY page_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
  WHERE i BETWEEN 6 AND 9 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY CAST(near AS DOUBLE) / near_n, abs(2 * i - 15), i) = 1""", COLS.format("spr"), columns=("page_id", "split_x", "near", "near_n"))
over_spreads("o117_ink_band", profiles.ink_band, """SELECT page_id, min(i) FILTER (cum >= total * 0.02) AS band_start, min(i) FILTER (cum >= total * 0.98) AS band_end FROM (SELECT page_id, i, sum(ink) OVER (PARTITION BY page_id ORDER BY i) AS cum, sum(ink) OVER (PARTITION BY page_id) AS total FROM pc) WHERE total > 0 GROUP BY page_id""", COLS.format("spr"), columns=("page_id", "band_start", "band_end"))
over_gray("o092_dense_rect", profiles.dense_rect, """SELECT page_id, min(i) FILTER (k = 'r' AND f) AS top, max(i) FILTER (k = 'r' AND f) AS bottom, min(i) FILTER (k = 'c' AND f) AS "left", max(i) FILTER (k = 'c' AND f) AS "right" FROM
  (SELECT page_id, 'r' AS k, i, ink > 0 AND ink >= 0.65 * max(ink) OVER (PARTITION BY page_id) AS f FROM pr UNION ALL SELECT page_id, 'c', i, ink > 0 AND ink >= 0.65 * max(ink) OVER (PARTITION BY page_id) FROM pc) GROUP BY page_id""", ROWS, COLS.format("px"), columns=("page_id", "top", "bottom", "left", "right"))
over_gray("o078_text_rows", lambda p: profiles.text_rows(p, 8).withColumn("text_row", F.col("text_row").cast("int")), "SELECT page_id, i, CAST(ink > 1 AS BIGINT) AS text_row FROM pr", ROWS, columns=("page_id", "i", "text_row"))
# ---- skew
MOMENTS = """mo AS (SELECT page_id, CAST(count(*) AS HUGEINT) AS m00, sum(x) AS m10, sum(y) AS m01, sum(x * y) AS m11, sum(x * x) AS m20, sum(y * y) AS m02 FROM px WHERE v <= 128 GROUP BY page_id HAVING count(*) >= 5),
  an AS (SELECT page_id, m00, degrees(0.5 * atan2(CAST(2 * (m00 * m11 - m10 * m01) AS DOUBLE), CAST((m00 * m20 - m10 * m10) - (m00 * m02 - m01 * m01) AS DOUBLE))) AS angle FROM mo)"""
over_gray("o043_moments_angle", profiles.moments_angle, "SELECT page_id, CAST(m00 AS BIGINT) AS m00, round(angle, 6) AS angle FROM an", MOMENTS, columns=("page_id", "m00"), doubles=("angle",))
over_gray("o045_normal_angle", lambda p: profiles.moments_angle(p).withColumn("angle", profiles.normal_angle(F.col("angle"))), "SELECT page_id, round(CASE WHEN abs(a) < 0.005 THEN 0.0 ELSE a END, 6) AS angle FROM (SELECT page_id, CASE WHEN angle > 45 THEN angle - 90 WHEN angle <= -45 THEN angle + 90 ELSE angle END AS a FROM an)", MOMENTS, columns=("page_id",), doubles=("angle",))
TURNS = [-10.0, -5.0, 0.0, 5.0, 10.0]
over_gray("o041_projection_angle", lambda p: profiles.projection_angle(p, TURNS), """SELECT page_id, energy, round(angle, 6) AS angle FROM (SELECT page_id, angle, CAST(sum(n * n) AS BIGINT) AS energy FROM (SELECT page_id, angle, floor(round(y * cos(radians(angle)) - x * sin(radians(angle)) + 0.5, 9)) AS r, count(*) AS n
  FROM px, (VALUES (CAST(-10.0 AS DOUBLE)), (-5.0), (0.0), (5.0), (10.0)) a(angle) WHERE v <= 128 GROUP BY ALL) GROUP BY page_id, angle) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY energy DESC, abs(angle), angle) = 1""", columns=("page_id", "energy"), doubles=("angle",))


@register("o047_consensus", """SELECT page_id, support, round(angle, 6) AS angle FROM (SELECT page_id, island, count(*) AS support, sum(weight) AS weight, sum(angle * weight) / sum(weight) AS angle, max(angle) - min(angle) AS wide FROM (SELECT *, sum(jump) OVER (PARTITION BY page_id ORDER BY angle, weight ROWS UNBOUNDED PRECEDING) AS island FROM
  (SELECT *, coalesce(CAST(angle - lag(angle) OVER (PARTITION BY page_id ORDER BY angle, weight) > 1.5 AS INT), 0) AS jump FROM (SELECT user_id AS page_id, round(value / 10, 3) AS angle, CAST(event_id % 7 + 1 AS DOUBLE) AS weight FROM events WHERE value IS NOT NULL))) GROUP BY page_id, island)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY support DESC, weight DESC, wide, island) = 1""")
def o047_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rasters.table(spark, sf_dir, "events").where("value is not null").select(F.col("user_id").alias("page_id"), F.round(F.col("value") / 10, 3).alias("angle"), (F.col("event_id") % 7 + 1).cast("double").alias("weight"))
    return longs(profiles.consensus(found), "page_id", "support", doubles=("angle",))


# ---- batches
@register("o001_catalog", "SELECT page_id, folder, base_name, ext FROM files WHERE ext <> 'txt'", FILES)
def o001_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(F.col("ext").isin(*batch.IMAGES))


@register("o002_count", "SELECT folder, count(*) AS n FROM files WHERE ext <> 'txt' GROUP BY folder", FILES)
def o002_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o001_catalog(spark, sf_dir).groupBy("folder").agg(F.count("*").alias("n"))


register("o005_folders", "SELECT DISTINCT folder FROM files WHERE ext IN ('jpg', 'png', 'tif')", FILES)(lambda spark, d: batch.folders_with_pages(files(spark, d)))


@register("o063_natural_order", "SELECT page_id, row_number() OVER (PARTITION BY folder ORDER BY page_id) AS seq FROM files", FILES)
def o063_natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.numbered(files(spark, sf_dir)).select("page_id", F.col("n").cast("bigint").alias("seq"))


@register("o127_renumber", "SELECT page_id, format('{:03d}', row_number() OVER (PARTITION BY folder ORDER BY page_id)) AS new_name FROM files", FILES)
def o127_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.numbered(files(spark, sf_dir)).select("page_id", "new_name")


@register("o151_not_done", "SELECT page_id FROM files WHERE page_id NOT IN (SELECT doc_id FROM labels)", FILES)
def o151_not_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = rasters.table(spark, sf_dir, "labels").select(F.concat(F.lit("PAGE"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, "B").otherwise("")).alias("base_name"))
    return batch.not_done(files(spark, sf_dir), done).select("page_id")


register("o154_side", "SELECT page_id, CASE WHEN page_id % 2 = 1 THEN 'Left' ELSE 'Right' END AS side FROM files", FILES)(lambda spark, d: files(spark, d).select("page_id", batch.side(F.col("base_name")).alias("side")))


def finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of done work, a row for each event."""
    e = rasters.table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("f"), (F.col("user_id") % 20).cast("string")).alias("folder"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 11 == 0, "bad page").alias("error"), (F.col("event_id") % 97).alias("seconds"))


DONE = "done AS (SELECT 'f' || CAST(user_id % 20 AS VARCHAR) AS folder, event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'bad page' END AS error, event_id % 97 AS seconds FROM events)"
register("o160_progress", "SELECT folder, seq, CAST(round_even(100.0 * count(*) OVER (PARTITION BY folder ORDER BY seq) / count(*) OVER (PARTITION BY folder), 0) AS BIGINT) AS percent FROM done", DONE)(
    lambda spark, d: batch.progress(finished(spark, d)).select("folder", "seq", F.col("percent").cast("bigint").alias("percent"))
)
register("o159_log", "SELECT folder, total, errors, t // 3600 AS h, t % 3600 // 60 AS m, t % 60 AS s FROM (SELECT folder, count(*) AS total, count(error) AS errors, CAST(sum(seconds) AS BIGINT) AS t FROM done GROUP BY folder)", DONE)(
    lambda spark, d: batch.log(finished(spark, d)).select("folder", *[F.col(c).cast("bigint").alias(c) for c in ("total", "errors", "h", "m", "s")])
)
# ---- components
LABELS = """m AS (SELECT page_id, y, x, y * 8 + x AS id FROM px WHERE v < 110),
  reach(page_id, id, seen) AS (SELECT page_id, id, id FROM m UNION SELECT r.page_id, r.id, b.id FROM reach r JOIN m a ON a.page_id = r.page_id AND a.id = r.seen JOIN m b ON b.page_id = a.page_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
  cc AS (SELECT page_id, id, min(seen) AS label FROM reach GROUP BY page_id, id)"""


@register("o068_components", """SELECT page_id, label, count(*) AS area, CAST(min(x) AS BIGINT) AS left_x, CAST(min(y) AS BIGINT) AS top, CAST(max(x) - min(x) + 1 AS BIGINT) AS width, CAST(max(y) - min(y) + 1 AS BIGINT) AS height FROM cc JOIN m USING (page_id, id) GROUP BY page_id, label""", "RECURSIVE " + PX, LABELS)
def o068_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.components(rasters.packed_gray(spark, sf_dir), 0, 110)


@register("o103_largest_component", """SELECT page_id, label, area, width, height FROM (SELECT page_id, label, count(*) AS area, CAST(max(x) - min(x) + 1 AS BIGINT) AS width, CAST(max(y) - min(y) + 1 AS BIGINT) AS height FROM cc JOIN m USING (page_id, id) GROUP BY page_id, label)
  WHERE area >= 6.4 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY area DESC, label) = 1""", "RECURSIVE " + PX, LABELS)
def o103_largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.largest(o068_components(spark, sf_dir).where("area >= 0.1 * 64")).select("page_id", "label", "area", "width", "height")


BOXES = "bx AS (SELECT page_id, label, count(*) AS area, min(x) AS l, min(y) AS t, max(x) + 1 AS r, max(y) + 1 AS b FROM cc JOIN m USING (page_id, id) GROUP BY page_id, label)"


@register("o079_near_big", """SELECT s.page_id, s.label FROM bx s WHERE s.area < 4 AND EXISTS (SELECT 1 FROM bx g WHERE g.page_id = s.page_id AND g.area >= 4 AND
  pow(greatest(g.l - (s.l + s.r) / 2.0, 0, (s.l + s.r) / 2.0 - g.r), 2) + pow(greatest(g.t - (s.t + s.b) / 2.0, 0, (s.t + s.b) / 2.0 - g.b), 2) < 2.25)""", "RECURSIVE " + PX, LABELS, BOXES)
def o079_near_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.near_big(o068_components(spark, sf_dir), 4, 1.5).select("page_id", "label")


@register("o081_clustered", """SELECT DISTINCT s.page_id, s.label FROM bx s JOIN bx o ON o.page_id = s.page_id AND o.label <> s.label AND o.area < 4 AND abs((s.l + s.r) / 2.0 - (o.l + o.r) / 2.0) <= 2 AND abs((s.t + s.b) / 2.0 - (o.t + o.b) / 2.0) <= 1 WHERE s.area < 4""", "RECURSIVE " + PX, LABELS, BOXES)
def o081_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.clustered(o068_components(spark, sf_dir).where("area < 4"), 2.0, 1.0).select("page_id", "label")


# ---- specks, borders and boxes
SPECKS = """sized AS (SELECT page_id, coalesce(list_sort(list(b - t) FILTER (b - t >= 3))[count(*) FILTER (b - t >= 3) // 2 + 1], 20) AS mh FROM bx GROUP BY page_id),
  kn AS (SELECT bx.*, mh, r - l AS w, b - t AS h, l + (r - l) // 2 AS cx, t + (b - t) // 2 AS cy, area < greatest(1, round_even(0.5 * mh * mh, 0)) OR b - t <= greatest(1, round_even(0.35 * mh, 0)) AS small FROM bx JOIN sized USING (page_id)),
  lines_ AS (SELECT page_id, y FROM px GROUP BY page_id, y HAVING count(*) FILTER (v <= 128) > 1),
  judged AS (SELECT s.page_id, s.label, w, h,
    EXISTS (SELECT 1 FROM kn g WHERE g.page_id = s.page_id AND NOT g.small AND pow(greatest(g.l - s.cx, 0, s.cx - g.r), 2) + pow(greatest(g.t - s.cy, 0, s.cy - g.b), 2) < pow(greatest(1.0, 0.8 * s.mh), 2)) AS near_big,
    EXISTS (SELECT 1 FROM lines_ q WHERE q.page_id = s.page_id AND abs(q.y - s.cy) <= greatest(1, s.mh // 3)) AS on_line,
    EXISTS (SELECT 1 FROM kn o WHERE o.page_id = s.page_id AND o.small AND o.label <> s.label AND abs(o.cx - s.cx) <= greatest(3, floor(s.mh * 0.6)) AND abs(o.cy - s.cy) <= greatest(1, s.mh // 3)) AS in_group
    FROM kn s WHERE small),
  gone AS (SELECT page_id, label, near_big, on_line, in_group, NOT (near_big OR (on_line AND (abs(w - h) <= greatest(1, 0.6 * h) OR in_group))) AS remove FROM judged)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.specks(o068_components(spark, sf_dir), profiles.text_rows(rasters.gray_pages(spark, sf_dir), 8))


register("o083_specks", "SELECT * FROM gone", "RECURSIVE " + PX, LABELS, BOXES, SPECKS)(judged)


@register("o084_despeckle", "SELECT px.page_id, px.y, px.x, CASE WHEN EXISTS (SELECT 1 FROM cc JOIN gone USING (page_id, label) WHERE remove AND cc.page_id = px.page_id AND cc.id = px.y * 8 + px.x) THEN 255 ELSE v END AS v FROM px", "RECURSIVE " + PX, LABELS, BOXES, SPECKS)
def o084_despeckle(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = judged(spark, sf_dir).where("remove")
    return longs(rasters.unpack(masks.paint(rasters.packed_gray(spark, sf_dir), gone, 255, 110)), "page_id", "y", "x", "v")


@register(
    "o053_edge_borders",
    """SELECT px.page_id, px.y, px.x, CASE WHEN EXISTS (SELECT 1 FROM cc JOIN bx USING (page_id, label) WHERE cc.page_id = px.page_id AND cc.id = px.y * 8 + px.x AND (l = 0 OR t = 0 OR r = 8 OR b = 8)
  AND (r - l >= 4.8 OR b - t >= 4.8 OR (l = 0 AND r = 8) OR (t = 0 AND b = 8))) THEN 255 ELSE v END AS v FROM px""",
    "RECURSIVE " + PX,
    LABELS,
    BOXES,
)
def o053_edge_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    border = regions.edge_touching(o068_components(spark, sf_dir), 8, 8)
    return longs(rasters.unpack(masks.paint(rasters.packed_gray(spark, sf_dir), border, 255, 110)), "page_id", "y", "x", "v")


BIGGEST = "big AS (SELECT * FROM bx WHERE area >= 6.4 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY area DESC, label) = 1)"


@register("o103_crop", "SELECT px.page_id, px.y - coalesce(t, 0) AS y, px.x - coalesce(l, 0) AS x, v FROM px LEFT JOIN big USING (page_id) WHERE l IS NULL OR (px.x >= l AND px.x < r AND px.y >= t AND px.y < b)", "RECURSIVE " + PX, LABELS, BOXES, BIGGEST)
def o103_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = regions.largest(o068_components(spark, sf_dir).where("area >= 0.1 * 64")).select("page_id", F.col("left_x").alias("x"), F.col("top").alias("y"), F.col("width").alias("w"), F.col("height").alias("h"))
    return longs(rasters.unpack(masks.crop_to(rasters.packed_gray(spark, sf_dir), box)), "page_id", "y", "x", "v")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o068_components(spark, sf_dir).select("page_id", F.col("label").alias("box_id"), F.col("left_x").alias("x"), F.col("top").alias("y"), F.col("width").alias("w"), F.col("height").alias("h"))


register("o111_boundary", "SELECT page_id, greatest(0, min(l) - 1) AS x, greatest(0, min(t) - 1) AS y, least(8, max(r) + 1) - greatest(0, min(l) - 1) AS w, least(8, max(b) + 1) - greatest(0, min(t) - 1) AS h FROM bx WHERE area >= 3 GROUP BY page_id", "RECURSIVE " + PX, LABELS, BOXES)(
    lambda spark, d: longs(regions.boundary(o068_components(spark, d).where("area >= 3").select("page_id", F.col("left_x").alias("x"), F.col("top").alias("y"), F.col("width").alias("w"), F.col("height").alias("h")), 8, 8, 1), "page_id", "x", "y", "w", "h")
)
register("o105_overlaps", """SELECT p.page_id, p.label AS box_id, q.label AS other_id, CAST(i AS BIGINT) AS inter, round(i / ((p.r - p.l) * (p.b - p.t) + (q.r - q.l) * (q.b - q.t) - i)::DOUBLE, 6) AS iou FROM bx p JOIN bx q ON p.page_id = q.page_id AND p.label < q.label,
  LATERAL (SELECT greatest(0, least(p.r, q.r) - greatest(p.l, q.l)) * greatest(0, least(p.b, q.b) - greatest(p.t, q.t)) AS i) WHERE i > 0""", "RECURSIVE " + PX, LABELS, BOXES)(
    lambda spark, d: longs(regions.overlaps(boxes(spark, d)), "page_id", "box_id", "other_id", "inter", doubles=("iou",))
)
NMS = """ranked AS (SELECT page_id, label AS box_id, l AS x, t AS y, r - l AS w, b - t AS h, row_number() OVER (PARTITION BY page_id ORDER BY (r - l) * (b - t) DESC, label) AS nth FROM bx),
  nms AS (SELECT page_id, 1 AS nth, [{'i': box_id, 'x': x, 'y': y, 'w': w, 'h': h}] AS kept FROM ranked WHERE nth = 1
   UNION ALL SELECT n.page_id, n.nth + 1, CASE WHEN list_bool_or([greatest(0, least(k.x + k.w, q.x + q.w) - greatest(k.x, q.x)) * greatest(0, least(k.y + k.h, q.y + q.h) - greatest(k.y, q.y))
     > 0.2 * (k.w * k.h + q.w * q.h - greatest(0, least(k.x + k.w, q.x + q.w) - greatest(k.x, q.x)) * greatest(0, least(k.y + k.h, q.y + q.h) - greatest(k.y, q.y))) FOR k IN n.kept])
     THEN n.kept ELSE list_append(n.kept, {'i': q.box_id, 'x': q.x, 'y': q.y, 'w': q.w, 'h': q.h}) END FROM nms n JOIN ranked q ON q.page_id = n.page_id AND q.nth = n.nth + 1),
  last AS (SELECT page_id, unnest(arg_max(kept, nth)) AS k FROM nms GROUP BY page_id)"""
register("o105_suppressed", "SELECT page_id, CAST(k.i AS BIGINT) AS box_id, CAST(k.x AS BIGINT) AS x, CAST(k.y AS BIGINT) AS y, CAST(k.w AS BIGINT) AS w, CAST(k.h AS BIGINT) AS h FROM last", "RECURSIVE " + PX, LABELS, BOXES, NMS)(lambda spark, d: masks.suppressed(boxes(spark, d), 0.2))
DARK = """large AS (SELECT page_id, label FROM bx WHERE area >= 1.28),
  own AS (SELECT cc.page_id, label, y, x FROM cc JOIN m USING (page_id, id) JOIN large USING (page_id, label)),
  flood AS (SELECT page_id, label, -1::BIGINT AS y, -1::BIGINT AS x FROM large
   UNION SELECT f.page_id, f.label, f.y + dy, f.x + dx FROM flood f, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) d(dy, dx) WHERE f.y + dy BETWEEN -1 AND 8 AND f.x + dx BETWEEN -1 AND 8
   AND NOT EXISTS (SELECT 1 FROM own o WHERE o.page_id = f.page_id AND o.label = f.label AND o.y = f.y + dy AND o.x = f.x + dx)),
  wide AS (SELECT page_id, label, min(y) AS t, max(y) AS b FROM (SELECT page_id, label, y, count(*) AS n, max(count(*)) OVER (PARTITION BY page_id, label) AS most FROM own GROUP BY page_id, label, y) WHERE n >= most * 0.65 GROUP BY page_id, label),
  high AS (SELECT page_id, label, min(x) AS l, max(x) AS r FROM (SELECT page_id, label, x, count(*) AS n, max(count(*)) OVER (PARTITION BY page_id, label) AS most FROM own GROUP BY page_id, label, x) WHERE n >= most * 0.65 GROUP BY page_id, label),
  dark AS (SELECT px.page_id, px.y, px.x, px.v, w.label IS NOT NULL AND f.label IS NULL AS filled, coalesce(px.y BETWEEN t AND b AND px.x BETWEEN l AND r, false) AS boxed FROM px
   LEFT JOIN wide w ON w.page_id = px.page_id LEFT JOIN high h ON h.page_id = w.page_id AND h.label = w.label
   LEFT JOIN flood f ON f.page_id = px.page_id AND f.label = w.label AND f.y = px.y AND f.x = px.x)"""
register("o089_invert_dark", "SELECT page_id, y, x, CASE WHEN bool_or(filled) THEN 255 - v ELSE v END AS v FROM dark GROUP BY page_id, y, x, v", "RECURSIVE " + PX, LABELS, BOXES, DARK)(lambda spark, d: longs(rasters.unpack(masks.invert_dark(rasters.packed_gray(spark, d), "mask", below=110)), "page_id", "y", "x", "v"))
register("o090_invert_rect", "SELECT page_id, y, x, CASE WHEN bool_or(boxed) THEN 255 - v ELSE v END AS v FROM dark GROUP BY page_id, y, x, v", "RECURSIVE " + PX, LABELS, BOXES, DARK)(lambda spark, d: longs(rasters.unpack(masks.invert_dark(rasters.packed_gray(spark, d), "rect", below=110)), "page_id", "y", "x", "v"))
register("o091_invert_hybrid", "SELECT page_id, y, x, CASE WHEN bool_or(filled AND boxed) THEN 255 - v ELSE v END AS v FROM dark GROUP BY page_id, y, x, v", "RECURSIVE " + PX, LABELS, BOXES, DARK)(lambda spark, d: longs(rasters.unpack(masks.invert_dark(rasters.packed_gray(spark, d), "hybrid", below=110)), "page_id", "y", "x", "v"))
register(
    "o104_decode_boxes",
    """SELECT page_id, CAST(floor(x - lx) AS BIGINT) AS x, CAST(floor(y - ty) AS BIGINT) AS y, CAST(floor(rx - (x - lx)) AS BIGINT) AS w, CAST(floor(by_ - (y - ty)) AS BIGINT) AS h FROM
  (SELECT page_id, x * 4.0::DOUBLE AS x, y * 4.0::DOUBLE AS y, least(x * 4.0::DOUBLE, v / 16.0::DOUBLE) AS lx, least(y * 4.0::DOUBLE, v / 32.0::DOUBLE) AS ty, least(32.0::DOUBLE, x * 4.0::DOUBLE + v / 16.0::DOUBLE) AS rx, least(32.0::DOUBLE, y * 4.0::DOUBLE + v / 32.0::DOUBLE) AS by_ FROM px WHERE v / 255.0::DOUBLE >= 0.5)
  WHERE floor(rx - (x - lx)) > 1 AND floor(by_ - (y - ty)) > 1""",
    PX,
)(
    lambda spark, d: longs(
        regions.decoded_boxes(rasters.gray_pages(spark, d).select("page_id", F.col("y").alias("cy"), F.col("x").alias("cx"), (F.col("v") / 255.0).alias("score"), *[(F.col("v") / by).alias(c) for c, by in (("up", 32.0), ("down", 32.0), ("left", 16.0), ("right", 16.0))]), 4, 0.5, 32, 32), "page_id", "x", "y", "w", "h"
    )
)
WALK = """walk(page_id, y, x, c) AS (SELECT page_id, y, x, 255 - v FROM spr WHERE y = 0 AND x BETWEEN 6 AND 9 UNION ALL
  SELECT s.page_id, s.y, s.x, 255 - s.v + min(k.c) FROM walk k JOIN spr s ON s.page_id = k.page_id AND s.y = k.y + 1 AND abs(s.x - k.x) <= 1 AND s.x BETWEEN 6 AND 9 GROUP BY s.page_id, s.y, s.x, s.v)"""
register("o120_seam_cost", "SELECT page_id, CAST(min(c) AS BIGINT) AS cost FROM walk WHERE y = 7 GROUP BY page_id", "RECURSIVE " + PX, SPREAD, WALK)(lambda spark, d: masks.seams(rasters.pack(rasters.spreads(spark, d))).select("page_id", "cost"))

# ---- tiles, illumination, votes and palettes
TILES = """tile AS (SELECT page_id, x // 4 AS tx, y // 4 AS ty, v, count(*) AS n FROM px GROUP BY ALL),
  lut AS (SELECT page_id, tx, ty, u.v, round_even(255 * (sum(least(n, 2)) FILTER (tile.v <= u.v) * 256.0::DOUBLE + sum(greatest(n - 2, 0)) * (u.v + 1)) / 4096.0::DOUBLE, 0) AS nv FROM tile, range(256) u(v) GROUP BY page_id, tx, ty, u.v),
  lut0 AS (SELECT tx, ty, page_id, v, coalesce(nv, (SELECT round_even(255 * sum(greatest(n - 2, 0)) * (lut.v + 1) / 4096.0::DOUBLE, 0) FROM tile WHERE tile.page_id = lut.page_id AND tile.tx = lut.tx AND tile.ty = lut.ty)) AS nv FROM lut),
  four AS (SELECT px.*, greatest(0, least(1, floor((2 * x - 4) / 8.0) + i)) AS tx, greatest(0, least(1, floor((2 * y - 4) / 8.0) + j)) AS ty,
    CASE WHEN i = 1 THEN 2 * x - 4 - floor((2 * x - 4) / 8.0) * 8 ELSE 8 - (2 * x - 4 - floor((2 * x - 4) / 8.0) * 8) END * CASE WHEN j = 1 THEN 2 * y - 4 - floor((2 * y - 4) / 8.0) * 8 ELSE 8 - (2 * y - 4 - floor((2 * y - 4) / 8.0) * 8) END AS w FROM px, range(2) a(i), range(2) b(j))"""
register(
    "o028_clahe",
    """SELECT page_id, y, x, CAST(CASE WHEN bool_or(any_mid) THEN least(255, round_even(sum(w * nv) / 64.0::DOUBLE, 0)) ELSE any_value(v) END AS BIGINT) AS v FROM (SELECT f.*, l.nv, m.any_mid FROM four f JOIN lut0 l USING (page_id, tx, ty, v) JOIN (SELECT page_id, bool_or(v BETWEEN 1 AND 254) AS any_mid FROM px GROUP BY page_id) m USING (page_id)) GROUP BY page_id, y, x""",
    PX,
    TILES,
)(lambda spark, d: longs(rasters.unpack(masks.each_page(rasters.packed_gray(spark, d), lambda v, row: vision.tiles_equalised(v, 2, 32.0))), "page_id", "y", "x", "v"))
LOGS = """lg AS (SELECT page_id, y, x, ln(greatest(1e-6, v / 255.0::DOUBLE)) AS l FROM px),
  rows_ AS (SELECT a.page_id, a.y, a.x, any_value(a.l) AS l, sum(exp(-pow(a.x - b.x, 2) / 4.5::DOUBLE) * b.l) / sum(exp(-pow(a.x - b.x, 2) / 4.5::DOUBLE)) AS g FROM lg a JOIN lg b ON a.page_id = b.page_id AND a.y = b.y AND abs(a.x - b.x) <= 4 GROUP BY a.page_id, a.y, a.x)"""
register(
    "o029_retinex",
    """SELECT page_id, y, x, round(e, 6) + 0.0 AS e FROM (SELECT a.page_id, a.y, a.x, 1.8::DOUBLE * (any_value(a.l) - sum(exp(-pow(a.y - b.y, 2) / 4.5::DOUBLE) * b.g) / sum(exp(-pow(a.y - b.y, 2) / 4.5::DOUBLE))) AS e FROM rows_ a JOIN rows_ b ON a.page_id = b.page_id AND a.x = b.x AND abs(a.y - b.y) <= 4 GROUP BY a.page_id, a.y, a.x)""",
    PX,
    LOGS,
)(lambda spark, d: longs(areas.homomorphic(rasters.gray_pages(spark, d), 1.5), "page_id", "y", "x", doubles=("e",)).withColumn("e", F.col("e") + 0.0))
LIMITS = """lim AS (SELECT page_id, quantile_disc(v, 0.05) AS lo, quantile_disc(v, 0.95) AS hi FROM px GROUP BY page_id)"""
register("o030_normalise", """SELECT page_id, y, x, CAST(CASE WHEN hi - lo < 1e-9 THEN 0 ELSE least(255, greatest(0, round_even((v - lo) * 255.0::DOUBLE / (hi - lo), 0))) END AS BIGINT) AS v FROM px JOIN lim USING (page_id)""", PX, LIMITS)(
    lambda spark, d: longs(areas.normalised(rasters.gray_pages(spark, d).withColumn("e", F.col("v").cast("double")), 5, 95), "page_id", "y", "x", "v")
)
register("o023_majority", "SELECT page_id, y, x, CASE WHEN (SELECT count(*) FROM range(7) t(i) WHERE v <= 98 + 10 * i) >= 4 THEN 0 ELSE 255 END AS v FROM px", PX)(lambda spark, d: longs(areas.majority(rasters.gray_pages(spark, d)), "page_id", "y", "x", "v"))
register("o014_palette", "SELECT page_id, y, x, CASE v // 64 WHEN 0 THEN 0 WHEN 1 THEN 85 ELSE 200 END AS v FROM px", PX)(
    lambda spark, d: longs(
        areas.palette_unpacked(rasters.gray_pages(spark, d).groupBy("page_id", "y", F.floor(F.col("x") / 4).cast("int").alias("byte")).agg(F.sum(F.floor(F.col("v") / 64) * F.pow(F.lit(4), 3 - F.col("x") % 4)).cast("long").alias("packed")), 2, 8, [0, 85, 200]), "page_id", "y", "x", "v"
    )
)
# ---- image files
for _form, _packing in (("png", ""), ("bmp", ""), ("tif", "none"), ("tif", "lzw"), ("tif", "deflate"), ("tif", "packbits")):

    def _round_trip(spark: SparkSession, sf_dir: str, form: str = _form, packing: str = _packing) -> DataFrame:
        files_ = images.encoded(rasters.packed_gray(spark, sf_dir), form, 300, packing).select(F.col("page_id").cast("string").alias("path"), "content")
        back = images.decoded(files_).select(F.col("path").cast("bigint").alias("page_id"), "width", "height", "channels", "pixels")
        return longs(rasters.unpack(back), "page_id", "y", "x", "v")

    register(f"o{'132_tiff' if _form == 'tif' else '135'}_{_packing or _form}", "SELECT page_id, y, x, v FROM px", PX)(_round_trip)


# ---- shapes of pages
def text_row_sums(px: DataFrame) -> DataFrame:
    return longs(px.groupBy("page_id", "y").agg(F.sum("v").alias("s"), F.max("v").alias("brightest")), "page_id", "y", "s", "brightest")


# The SQL of this one has full rows only; the next has every character.
register("o164_text_rows", "SELECT page_id, y, CAST(sum(v) AS BIGINT) AS s, max(v) AS brightest FROM pxt GROUP BY page_id, y", TEXT)(
    lambda spark, d: text_row_sums(rasters.text_pages(spark, d).where(F.col("y") < F.floor(F.col("n") / rasters.TEXT_WIDTH)))
)
register("o164_whole_text_rows", "SELECT page_id, y, CAST(sum(v) AS BIGINT) AS s, CAST(max(v) AS BIGINT) AS brightest FROM whole GROUP BY page_id, y", WHOLE_TEXT)(
    lambda spark, d: text_row_sums(rasters.text_pages(spark, d))
)
register("o164_packed_and_back", "SELECT page_id, y, x, v FROM px", PX)(lambda spark, d: longs(rasters.unpack(rasters.packed_gray(spark, d)), "page_id", "y", "x", "v"))


def queries() -> dict[str, Query]:
    from folio import catalog_boxes, catalog_bricks, catalog_codes, catalog_colour_groups, catalog_files, catalog_more, catalog_presets, catalog_resize, catalog_runs, catalog_seams, catalog_votes  # noqa: F401  each registers its own

    return dict(catalog_more.catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    from folio import catalog_more

    return dict(catalog_more.catalog.SQL)
