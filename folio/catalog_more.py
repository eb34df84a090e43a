"""More queries of the page engine, registered beside those of :mod:`folio.catalog`: colour, names, lenient values, and whole-page kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio import catalog, rasters
from folio.catalog import FILES, PX, PXC, files, longs, register
from folio.functions import lenient
from folio.operators import colours, profiles, regions
from folio.sources import batch

# ---- colour
register("o024_weighted_gray", "SELECT page_id, y, x, CAST(least(255, greatest(0, round_even(r * 0.25 + g * 0.5 + b * 0.125, 0))) AS BIGINT) AS v FROM pxc", PXC)(
    lambda spark, d: longs(colours.weighted_gray(rasters.colour_pages(spark, d), 0.25, 0.5, 0.125), "page_id", "y", "x", "v")
)
register("o037_as_bgr", "SELECT page_id, y, x, v AS b, v AS g, v AS r FROM px", PX)(lambda spark, d: longs(colours.as_bgr(rasters.gray_pages(spark, d)), "page_id", "y", "x", "b", "g", "r"))
_HSV = """top AS (SELECT *, greatest(b, g, r) AS hi, least(b, g, r) AS lo FROM pxc),
  hue AS (SELECT *, CASE WHEN hi = lo THEN 0 WHEN hi = r THEN 60.0::DOUBLE * (g - b) / (hi - lo) WHEN hi = g THEN 120 + 60.0::DOUBLE * (b - r) / (hi - lo) ELSE 240 + 60.0::DOUBLE * (r - g) / (hi - lo) END AS deg FROM top),
  turned AS (SELECT *, ((CASE WHEN deg < 0 THEN deg + 360 ELSE deg END) / 2 + 20) % 180 / 30 AS h, least(255, CASE WHEN hi = 0 THEN 0 ELSE 255.0::DOUBLE * (hi - lo) / hi END * 1.5) / 255 AS s FROM hue),
  sect AS (SELECT *, CAST(floor(h) AS INT) % 6 AS k, hi * (1 - s) AS p, hi * (1 - s * (h - floor(h))) AS q, hi * (1 - s * (1 - (h - floor(h)))) AS t FROM turned)"""
register(
    "o033_hue_saturation",
    """SELECT page_id, y, x, CAST(round_even(round(CASE k WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN hi WHEN 4 THEN hi ELSE q END, 6), 0) AS BIGINT) AS b,
    CAST(round_even(round(CASE k WHEN 0 THEN t WHEN 1 THEN hi WHEN 2 THEN hi WHEN 3 THEN q WHEN 4 THEN p ELSE p END, 6), 0) AS BIGINT) AS g,
    CAST(round_even(round(CASE k WHEN 0 THEN hi WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE hi END, 6), 0) AS BIGINT) AS r FROM sect""",
    PXC,
    _HSV,
)(lambda spark, d: longs(colours.shift_hue(rasters.colour_pages(spark, d), 40, 50), "page_id", "y", "x", "b", "g", "r"))
for _how, _sql in (("and", "b & g"), ("or", "b | g"), ("xor", "xor(b, g)"), ("absdiff", "abs(b - g)")):
    register(f"o060_{_how}", f"SELECT page_id, y, x, {_sql} AS v FROM pxc", PXC)(lambda spark, d, how=_how: longs(colours.combine(rasters.colour_pages(spark, d), "b", "g", how), "page_id", "y", "x", "v"))
register("o060_in_range", "SELECT page_id, y, x, CASE WHEN b BETWEEN 40 AND 200 AND g BETWEEN 100 AND 180 AND r >= 90 THEN 255 ELSE 0 END::BIGINT AS v FROM pxc", PXC)(
    lambda spark, d: longs(colours.in_range(rasters.colour_pages(spark, d), (40, 100, 90), (200, 180, 255)), "page_id", "y", "x", "v")
)
register("o060_masked_set", "SELECT page_id, y, x, CASE WHEN v < 100 AND x > 3 THEN 7 ELSE v END::BIGINT AS v FROM px", PX)(
    lambda spark, d: longs(colours.masked_set(rasters.gray_pages(spark, d), (F.col("v") < 100) & (F.col("x") > 3), 7), "page_id", "y", "x", "v")
)
register("o062_pad", "SELECT p.page_id, j // 14 AS y, j % 14 AS x, coalesce(v, 255) AS v FROM (SELECT vec_id AS page_id, j FROM embeddings, range(196) t(j)) p LEFT JOIN px ON px.page_id = p.page_id AND px.y + 3 = j // 14 AND px.x + 3 = j % 14", PX)(
    lambda spark, d: longs(colours.padded(rasters.gray_pages(spark, d), 8, 8, 3), "page_id", "y", "x", "v")
)
_LIGHT = """lin AS (SELECT page_id, y, x, [CASE WHEN c / 255.0::DOUBLE <= 0.04045 THEN c / 255.0::DOUBLE / 12.92 ELSE pow((c / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END FOR c IN [r, g, b]] AS n FROM pxc),
  lum AS (SELECT page_id, y, x, 0.212671 * n[1] + 0.715160 * n[2] + 0.072169 * n[3] AS u FROM lin), light AS (SELECT page_id, y, x, CASE WHEN u > 0.008856 THEN 116.0 * cbrt(u) - 16.0 ELSE 903.3 * u END * 2.55 AS light FROM lum)"""
register("o115_lightness_columns", "SELECT page_id, x, round(avg(light), 6) AS mean, round(stddev_pop(light), 6) AS deviation FROM light GROUP BY page_id, x", PXC, _LIGHT)(
    lambda spark, d: longs(profiles.lightness_columns(rasters.colour_pages(spark, d), colours.lightness(F.col("b"), F.col("g"), F.col("r"))), "page_id", "x", doubles=("mean", "deviation"))
)
_PCA = """mom AS (SELECT page_id, count(*) AS n, avg(x::DOUBLE) AS mx, avg(y::DOUBLE) AS my, avg((x * x)::DOUBLE) AS mxx, avg((y * y)::DOUBLE) AS myy, avg((x * y)::DOUBLE) AS mxy FROM px WHERE v < 128 GROUP BY page_id HAVING count(*) >= 20),
  ang AS (SELECT page_id, n, degrees(atan2(2 * (mxy - mx * my), (mxx - mx * mx) - (myy - my * my)) / 2) AS angle FROM mom)"""
register(
    "o042_pca_angle",
    "SELECT page_id, CAST(n AS BIGINT) AS n, round(angle, 6) AS angle, round(0.35 * least(1, ln(1 + n) / ln(20001)) * (0.5 + 0.5 * greatest(0, least(1, (25 - abs(angle)) / 25))), 6) AS confidence FROM ang",
    PX,
    _PCA,
)(lambda spark, d: longs(profiles.pca_angle(rasters.gray_pages(spark, d), least=20), "page_id", "n", doubles=("angle", "confidence")))

# ---- names, outputs and answers
register("o003_fast_count", "SELECT folder, count(*) AS n FROM files WHERE ext <> 'txt' GROUP BY folder", FILES)(lambda spark, d: files(spark, d).where(F.col("ext").isin(*batch.IMAGES)).groupBy("folder").agg(F.count("*").alias("n")))
register("o126_split_names", "SELECT page_id, CAST(s AS BIGINT) AS side, base_name || '_' || s || CASE WHEN ext = 'png' THEN '.png' ELSE '.jpg' END AS output FROM files, range(1, 3) t(s)", FILES)(
    lambda spark, d: batch.split_names(files(spark, d)).select("page_id", F.col("side").cast("bigint").alias("side"), "output")
)
register("o129_resized_names", "SELECT page_id, folder || '_resized' AS out_folder, base_name || '.' || ext AS output FROM files", FILES)(lambda spark, d: batch.resized_names(files(spark, d)).select("page_id", "out_folder", "output"))
_OUT = "outs AS (SELECT page_id, folder, CASE WHEN page_id % 4 = 0 THEN '.' || base_name || '.tif.17.tmp' ELSE base_name || '.tif' END AS name FROM files)"


def outputs(spark, d):
    name = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("."), "base_name", F.lit(".tif.17.tmp"))).otherwise(F.concat("base_name", F.lit(".tif")))
    return files(spark, d).select("page_id", "folder", name.alias("name"))


register("o150_left_over", "SELECT page_id, folder, name FROM outs WHERE page_id % 4 = 0", FILES, _OUT)(lambda spark, d: batch.left_over(outputs(spark, d)))
register("o152_to_delete", "SELECT page_id, folder, name FROM outs WHERE folder IN ('scans/h1', 'scans/h4')", FILES, _OUT)(
    lambda spark, d: batch.to_delete(outputs(spark, d), files(spark, d).where(F.col("folder").isin("scans/h1", "scans/h4"))).select("page_id", "folder", "name")
)
register(
    "o153_answers",
    """SELECT seq, batch, CASE WHEN said = 'Cancel' THEN 'cancelled' WHEN n = 0 THEN 'fresh' WHEN said IN ('Yes', 'YesToAll') THEN 'overwrite' ELSE 'keep' END AS done FROM
    (SELECT a.seq, a.batch, a.n, coalesce((SELECT arg_min(b.answer, b.seq) FROM ask b WHERE b.batch = a.batch AND b.seq < a.seq AND b.n > 0 AND b.answer IN ('YesToAll', 'NoToAll', 'Cancel')), CASE WHEN a.n > 0 THEN a.answer END) AS said FROM ask a)""",
    "ask AS (SELECT page_id AS seq, page_id // 12 AS batch, page_id % 3 AS n, CASE WHEN page_id % 11 = 7 THEN 'YesToAll' WHEN page_id % 13 = 5 THEN 'NoToAll' WHEN page_id % 17 = 3 THEN 'Cancel' WHEN page_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS answer FROM pages)",
)(
    lambda spark, d: batch.answered(
        rasters.table(spark, d, "pages").selectExpr(
            "page_id as seq", "page_id div 12 as batch", "page_id % 3 as n_existing",
            "case when page_id % 11 = 7 then 'YesToAll' when page_id % 13 = 5 then 'NoToAll' when page_id % 17 = 3 then 'Cancel' when page_id % 2 = 0 then 'Yes' else 'No' end as answer",
        )
    ).select("seq", "batch", "done")
)
register("o155_page_side", "SELECT page_id, page_id % 2 = 1 AS applies FROM files", FILES)(lambda spark, d: batch.gated(files(spark, d).withColumn("side", batch.side(F.col("base_name"))), True, False).select("page_id", "applies"))
register(
    "o161_cancelled",
    "SELECT event_id FROM w WHERE began < coalesce((SELECT min(event_id) FROM events WHERE event_id % 97 = 13 AND event_id % 7 = folder), 1e18) AND began < (SELECT max(event_id) - 50 FROM events)",
    "w AS (SELECT event_id, event_id % 7 AS folder, event_id AS began FROM events)",
)(
    lambda spark, d: batch.until_cancelled(
        rasters.table(spark, d, "events").selectExpr("event_id", "event_id % 7 as folder", "event_id as started"),
        rasters.table(spark, d, "events").where("event_id % 97 = 13").selectExpr("event_id % 7 as folder", "event_id as at")
        .unionByName(rasters.table(spark, d, "events").agg((F.max("event_id") - 50).alias("at")).select(F.lit(None).cast("bigint").alias("folder"), "at")),
    ).select("event_id")
)
register(
    "o169_offsets",
    """SELECT event_id, CAST(greatest(0, floor(x / s + 0.5)) AS BIGINT) AS left_px, CAST(greatest(0, floor(y / s + 0.5)) AS BIGINT) AS top_px,
    CAST(greatest(0, 2000 - floor((x + w) / s + 0.5)) AS BIGINT) AS right_px, CAST(greatest(0, 3000 - floor((y + h) / s + 0.5)) AS BIGINT) AS bottom_px
    FROM (SELECT event_id, (event_id % 300)::DOUBLE AS x, (event_id % 500)::DOUBLE AS y, (event_id % 211 + 100)::DOUBLE AS w, (event_id % 307 + 100)::DOUBLE AS h, 0.25::DOUBLE AS s FROM events)""",
)(
    lambda spark, d: batch.offsets(
        rasters.table(spark, d, "events").selectExpr("event_id", "double(event_id % 300) as x", "double(event_id % 500) as y", "double(event_id % 211 + 100) as w", "double(event_id % 307 + 100) as h", "double(0.25) as scale", "2000 as width", "3000 as height")
    ).select("event_id", "left_px", "top_px", "right_px", "bottom_px")
)

# ---- values of parameters
_SAID = "CASE event_id % 10 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'off' WHEN 2 THEN '0' WHEN 3 THEN cast(event_id as varchar(20)) WHEN 4 THEN 'TRUE' WHEN 5 THEN concat(cast(event_id as varchar(20)), '.5') WHEN 6 THEN '1,250.75' WHEN 7 THEN 'maybe' WHEN 8 THEN '' ELSE '-3e2' END"
register(
    "o144_lenient",
    """SELECT event_id, CASE event_id % 10 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN event_id <> 0 WHEN 4 THEN true ELSE true END AS yes,
    CASE event_id % 10 WHEN 2 THEN 0 WHEN 3 THEN event_id WHEN 5 THEN event_id + 0.5 WHEN 6 THEN 1250.75 WHEN 9 THEN -300 ELSE 7.5 END::DOUBLE AS number,
    CAST(CASE event_id % 10 WHEN 2 THEN 0 WHEN 3 THEN event_id WHEN 5 THEN round_even(event_id + 0.5, 0) WHEN 6 THEN 1251 WHEN 9 THEN -300 ELSE 7 END AS BIGINT) AS whole FROM events""",
)(
    lambda spark, d: rasters.table(spark, d, "events").withColumn("said", F.expr(_SAID)).select(
        "event_id", lenient.boolean(F.col("said"), True).alias("yes"), lenient.double(F.col("said"), 7.5).alias("number"), lenient.integer(F.col("said"), 7).cast("bigint").alias("whole")
    )
)
register(
    "o140_steps",
    """SELECT event_id, CASE WHEN abs(t - v) < 0.0001 THEN v ELSE t END AS stepped, ['a', 'b', 'c'][CAST(greatest(0, least(2, event_id % 7 - 2)) AS INT) + 1] AS chosen
    FROM (SELECT event_id, v, greatest(-4.0, least(9.0, v + 0.25 * (event_id % 41 - 20)))::DOUBLE AS t FROM (SELECT event_id, (event_id % 13)::DOUBLE / 2 AS v FROM events))""",
)(
    lambda spark, d: rasters.table(spark, d, "events").select(
        "event_id",
        lenient.stepped((F.col("event_id") % 13).cast("double") / 2, 0.25, F.col("event_id") % 41 - 20, -4, 9).alias("stepped"),
        lenient.option(["a", "b", "c"], F.col("event_id") % 7 - 2).alias("chosen"),
    )
)

# ---- kernels of whole pages
import math  # noqa: E402
from collections.abc import Callable, Iterator  # noqa: E402

import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

from folio.kernels import operations as op  # noqa: E402
from folio.kernels import masks, vision  # noqa: E402
from folio.kernels.masks import each_page  # noqa: E402
from folio.plans import engine, presets  # noqa: E402


def facts(pages, schema: str, of: Callable[[np.ndarray], list[tuple]]):
    """Rows told of each gray page: page_id, then what ``of`` returns."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(page, *row) for page, w, h, pixels in zip(b.page_id, b.width, b.height, b.pixels) for row in of(np.frombuffer(pixels, np.uint8).reshape(h, w))]
            yield pd.DataFrame(rows, columns=names)

    return pages.select("page_id", "width", "height", "pixels").mapInPandas(run, schema)


_ANGLES = range(-150, 151, 30)


def _sines(degrees: float) -> tuple[int, int]:
    return round(math.cos(math.radians(degrees)) * 65536), round(math.sin(math.radians(degrees)) * 65536)


_TABLE = ", ".join(f"({t}, {_sines(t / 10)[0]}, {_sines(t / 10)[1]})" for t in _ANGLES)
register(
    "o041_profile_scores",
    """SELECT page_id, CAST(tenth AS BIGINT) AS tenth, round((n * sum(c * c) - sum(c) * sum(c)) / (n * n)::DOUBLE, 6) AS score FROM
    (SELECT page_id, tenth, n, bin, count(*) AS c FROM (SELECT page_id, tenth, n, greatest(0, least(n - 1, CAST(floor(((2 * y - 7) * c - (2 * x - 7) * s + n * 65536) / 131072.0) AS BIGINT))) AS bin
    FROM px, ang WHERE v < 128) GROUP BY page_id, tenth, n, bin) GROUP BY page_id, tenth, n""",
    PX,
    f"ang AS (SELECT tenth, c, s, greatest(1, (abs(s) * 8 + abs(c) * 8 + 32768) // 65536) AS n FROM (VALUES {_TABLE}) t(tenth, c, s))",
)(lambda spark, d: longs(facts(rasters.packed_gray(spark, d), "page_id bigint, tenth int, score double", lambda v: [(t, op.profile_score(v < 128, t / 10)) for t in _ANGLES] if (v < 128).any() else []), "page_id", "tenth", doubles=("score",)))

_C, _S = _sines(12)
_N = (abs(_C) * 8 + abs(_S) * 8 + 32768) // 65536
register(
    "o048_turned",
    f"""SELECT page_id, y, x, CAST(((a * (256 - fx) + b * fx) * (256 - fy) + (c * (256 - fx) + e * fx) * fy + 32768) // 65536 AS BIGINT) AS v FROM (SELECT p.page_id, p.y, p.x, fx, fy,
    coalesce(q1.v, 255) AS a, coalesce(q2.v, 255) AS b, coalesce(q3.v, 255) AS c, coalesce(q4.v, 255) AS e FROM place p
    LEFT JOIN px q1 ON q1.page_id = p.page_id AND q1.y = p.t AND q1.x = p.l LEFT JOIN px q2 ON q2.page_id = p.page_id AND q2.y = p.t AND q2.x = p.l + 1
    LEFT JOIN px q3 ON q3.page_id = p.page_id AND q3.y = p.t + 1 AND q3.x = p.l LEFT JOIN px q4 ON q4.page_id = p.page_id AND q4.y = p.t + 1 AND q4.x = p.l + 1)""",
    PX,
    f"""raw AS (SELECT vec_id AS page_id, j // {_N} AS y, j % {_N} AS x, (2 * (j % {_N}) + 1 - {_N}) * {_C} - (2 * (j // {_N}) + 1 - {_N}) * {_S} + 458752 AS u,
    (2 * (j % {_N}) + 1 - {_N}) * {_S} + (2 * (j // {_N}) + 1 - {_N}) * {_C} + 458752 AS w FROM embeddings, range({_N * _N}) t(j)),
  place AS (SELECT page_id, y, x, CAST(floor(u / 131072.0) AS BIGINT) AS l, CAST(floor(w / 131072.0) AS BIGINT) AS t, CAST(floor((u - floor(u / 131072.0) * 131072) / 512) AS BIGINT) AS fx, CAST(floor((w - floor(w / 131072.0) * 131072) / 512) AS BIGINT) AS fy FROM raw)""",
)(lambda spark, d: longs(rasters.unpack(each_page(rasters.packed_gray(spark, d), lambda v, row: vision.turned(v, 12))), "page_id", "y", "x", "v"))

register(
    "o065_median",
    """SELECT p.page_id, p.y, p.x, list_sort(list(q.v))[5] AS v FROM px p, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)
    JOIN px q ON q.page_id = p.page_id AND q.y = greatest(0, least(7, p.y + dy)) AND q.x = greatest(0, least(7, p.x + dx)) GROUP BY p.page_id, p.y, p.x""",
    PX,
)(lambda spark, d: longs(rasters.unpack(each_page(rasters.packed_gray(spark, d), lambda v, row: vision.median(v))), "page_id", "y", "x", "v"))

register(
    "o070_distance",
    """SELECT p.page_id, p.y, p.x, round(sqrt(least(16, least((p.y + 1) * (p.y + 1), (8 - p.y) * (8 - p.y), (p.x + 1) * (p.x + 1), (8 - p.x) * (8 - p.x)), coalesce(min((q.y - p.y) * (q.y - p.y) + (q.x - p.x) * (q.x - p.x)), 99))), 6) AS far
    FROM px p LEFT JOIN px q ON q.page_id = p.page_id AND q.v >= 128 WHERE p.v < 128 GROUP BY p.page_id, p.y, p.x""",
    PX,
)(lambda spark, d: longs(facts(rasters.packed_gray(spark, d), "page_id bigint, y int, x int, far double", lambda v: [(y, x, f) for y, x, f in zip(*np.nonzero(v < 128), vision.distance(np.pad(v < 128, 8), 4)[8:-8, 8:-8][v < 128])]), "page_id", "y", "x", doubles=("far",)))

_SPLIT = """cols AS (SELECT page_id, x, sum(CAST(v < 128 AS INT))::DOUBLE AS c, avg(v) AS m, stddev_pop(v) AS s, count(*) OVER (PARTITION BY page_id) AS w FROM spr GROUP BY page_id, x),
  run AS (SELECT *, avg(c) OVER (PARTITION BY page_id ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, sum(c) OVER (PARTITION BY page_id ORDER BY x) AS lft, sum(c) OVER (PARTITION BY page_id) AS total FROM cols),
  band AS (SELECT *, median(near) OVER (PARTITION BY page_id) AS mid, min(m) OVER (PARTITION BY page_id) AS m0, max(m) OVER (PARTITION BY page_id) AS m1, min(s) OVER (PARTITION BY page_id) AS s0, max(s) OVER (PARTITION BY page_id) AS s1 FROM run WHERE x BETWEEN 4 AND 11 AND w = 16),
  score AS (SELECT page_id, x, 0.60 * greatest(0, 1 - 2.5 * abs(x - 7.5) / 7) + 0.20 * CASE WHEN mid > 0 THEN 1 - least(1, near / mid) ELSE 0 END + 0.15 * CASE WHEN total > 0 THEN 1 - least(1, abs(2 * lft - total) / total) ELSE 0.5 END
   + 0.03 * CASE WHEN m1 - m0 > 1e-6 THEN (m - m0) / (m1 - m0) ELSE 0.5 END + 0.02 * CASE WHEN s1 - s0 > 1e-6 THEN 1 - (s - s0) / (s1 - s0) ELSE 0.5 END AS score FROM band)"""


def _split_scores(v: np.ndarray) -> list[tuple]:
    if v.shape[1] != 16:
        return []
    columns = (v < 128).sum(0).astype(float)
    return [(x, s) for x, s in enumerate(op.split_scores(columns, op.running_mean(columns, 3), v.mean(0), v.std(0), 4, 11).tolist(), 4)]


register("o118_split_scores", "SELECT page_id, x, round(score, 6) AS score FROM score", PX, catalog.SPREAD, _SPLIT)(
    lambda spark, d: longs(facts(rasters.pack(rasters.spreads(spark, d)), "page_id bigint, x int, score double", _split_scores), "page_id", "x", doubles=("score",))
)


# ---- pipelines over whole texts as pages: one pass, nothing shuffled; no SQL, tests hold the kernels
def engine_query(name: str, *operations: tuple[str, dict]) -> None:
    def query(spark, d):
        done = engine.run(rasters.packed_texts(spark, d), [presets.Operation(kind, given=given) for kind, given in operations])
        return done.select("page_id", "part", "width", "height", "channels", F.sha2("pixels", 256).alias("pixels_sha256"), "operation", "error")

    register(name, None)(query)


engine_query("o017_binarize_adaptive", ("Binarize", {"method": "Adaptive", "blockSize": 9, "useGaussian": True, "useMorphology": True}))
engine_query("o022_sauvola_equalised", ("Binarize", {"method": "Sauvola", "sauvolaWindowSize": 9, "sauvolaMorphRadius": 1}))
engine_query("o038_deskew_projection", ("Deskew", {"deskewAlgorithm": "Projection", "projCoarseStep": 3.0, "projRefineStep": 1.0}))
engine_query("o055_contour_borders", ("BordersRemove", {"borderRemovalAlgorithm": "By Contours"}))
engine_query("o057_integral_borders", ("BordersRemove", {"borderRemovalAlgorithm": "Integral"}))
engine_query("o076_classic_specks", ("Despeckle", {"enableDustRemoval": True, "enableDustShapeFilter": True}))
engine_query("o085_effective_specks", ("Despeckle", {"despeckleMethod": "Effective"}))
engine_query("o100_punch_holes", ("PunchHolesRemove", {"punchShape": "Rect", "width": 3, "height": 2, "leftOffset": 16, "rightOffset": 16, "topOffset": 4, "bottomOffset": 4, "fillRatio": 0.6}))
engine_query("o123_auto_split", ("SplitPage", {"splitMethod": "Auto"}))
engine_query("o156_default_pipeline", ("BordersRemove", {}), ("Binarize", {}))

register("o009_downscaled", "SELECT page_id, y // 2 AS y, x // 2 AS x, CAST(round_even(avg(v), 0) AS BIGINT) AS v FROM px GROUP BY page_id, y // 2, x // 2", PX)(
    lambda spark, d: longs(rasters.unpack(each_page(rasters.packed_gray(spark, d), lambda v, row: vision.reduced(v, 4))), "page_id", "y", "x", "v")
)
register(
    "o108_confirmed",
    r"""SELECT conv_id, turn, (sure >= 50 AND n >= 3 AND share >= 0.5) OR (sure >= 30 AND n >= 1 AND share >= 0.9) AS confirmed FROM (SELECT conv_id, turn, sure, n, CASE WHEN seen > 0 THEN n / seen::DOUBLE ELSE 0 END AS share FROM
    (SELECT conv_id, turn, (conv_id * 37 + turn * 13) % 100 AS sure, length(regexp_replace(trim(coalesce(text, '')), '[^\p{L}\p{N}]', '', 'g')) AS n, length(regexp_replace(trim(coalesce(text, '')), '[\p{Cc}\s]', '', 'g')) AS seen FROM conversations))""",
)(lambda spark, d: regions.confirmed(rasters.table(spark, d, "conversations").withColumn("sure", (F.col("conv_id") * 37 + F.col("turn") * 13) % 100)).select("conv_id", "turn", "confirmed"))
