"""Geometry and isolation queries (GEO)."""

from pyspark.sql import functions as F

from photoflow.functions import geometry as G
from photoflow.operators import isolation as S
from photoflow.plans.fixtures import ctes, view
from photoflow.plans.registry import query

_PROFILES = "p AS (SELECT * FROM (VALUES (2048, 4194304), (1024, 1048576), (1536, 2359296)) t(edge, total))"
_FIT = "least(1.0::DOUBLE, least(edge::DOUBLE / greatest({w}, {h})::DOUBLE, sqrt(total::DOUBLE / ({w}::DOUBLE * {h}::DOUBLE))))"


def images(spark, sf):
    v = view(spark, sf, "v_images")
    name = F.when(F.col("profile_edge") == 2048, "gemma4-26b-default").otherwise(F.concat(F.lit("gemma4-26b-benchmark-"), F.col("profile_edge").cast("string")))
    return G.join_profile(v.withColumn("profile", name), G.profiles(spark))


@query(f"""{ctes("v_images")}, {_PROFILES}, j AS (SELECT * FROM v_images LEFT JOIN p ON edge = profile_edge), s AS (SELECT *, {_FIT.format(w="width", h="height")} AS s FROM j)
SELECT image_id, CASE WHEN edge IS NULL THEN 'E_CONFIG_INVALID' END AS profile_error, CASE WHEN edge IS NOT NULL THEN greatest(1, floor(width * s))::INT END AS fit_width, CASE WHEN edge IS NOT NULL THEN greatest(1, floor(height * s))::INT END AS fit_height FROM s""")
def geo_fit(spark, sf):
    """GEO1, GEO2."""
    fit = G.fit_dimensions(F.col("width"), F.col("height"), F.col("max_long_edge"), F.col("max_total_pixels"))
    known = F.col("max_long_edge").isNotNull()
    return images(spark, sf).withColumn("f", fit).select("image_id", "profile_error", F.when(known, F.col("f.width")).alias("fit_width"), F.when(known, F.col("f.height")).alias("fit_height"))


@query(f"""{ctes("v_images")}, o AS (SELECT *, coalesce(exif_value, 1) AS o FROM v_images)
SELECT image_id, CASE WHEN o BETWEEN 1 AND 8 THEN o END AS orientation, CASE WHEN o BETWEEN 5 AND 8 THEN height WHEN o BETWEEN 1 AND 8 THEN width END AS upright_width,
CASE WHEN o BETWEEN 5 AND 8 THEN width WHEN o BETWEEN 1 AND 8 THEN height END AS upright_height, CASE WHEN o NOT BETWEEN 1 AND 8 THEN 'E_ORIENTATION_UNRESOLVED' END AS error_code FROM o""")
def geo_orientation(spark, sf):
    """GEO3."""
    o = G.resolve_orientation(F.col("exif_value"), F.col("width"), F.col("height"))
    return view(spark, sf, "v_images").withColumn("o", o).select("image_id", "o.orientation", F.col("o.width").alias("upright_width"), F.col("o.height").alias("upright_height"), F.col("o.error").alias("error_code"))


def _span(a, d, n):
    lo = f"least(greatest(floor({a} * {n})::INT, 0), {n} - 1)"
    hi = f"least(greatest(ceil(({a} + {d}) * {n})::INT, {lo} + 1), {n})"
    return lo, f"({hi} - {lo})"


_X, _W = _span("x", "w", "1200")
_Y, _H = _span("y", "h", "800")


@query(f"""{ctes("v_instances")}, b AS (SELECT image_id, idx, {_X} AS px, {_Y} AS py, {_W} AS pw, {_H} AS ph, greatest(0.0, w) * greatest(0.0, h) AS area, (cx - 0.5) * (cx - 0.5) + (cy - 0.5) * (cy - 0.5) AS d FROM v_instances),
m AS (SELECT *, ceil(greatest(pw, ph)::DOUBLE * 0.08)::INT AS margin FROM b)
SELECT image_id, idx, round(area, 9) AS area, round(d, 9) AS distance, px, py, pw, ph, greatest(0, px - margin) AS crop_x, greatest(0, py - margin) AS crop_y,
least(1200, px + pw + margin) - greatest(0, px - margin) AS crop_w, least(800, py + ph + margin) - greatest(0, py - margin) AS crop_h FROM m""")
def geo_boxes(spark, sf):
    """GEO4, GEO5, GEO6, GEO10."""
    b, w, h = G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")), F.lit(1200), F.lit(800)
    df = view(spark, sf, "v_instances").select("image_id", "idx", F.round(G.area(b), 9).alias("area"), F.round(G.squared_distance(F.col("cx"), F.col("cy"), F.lit(0.5), F.lit(0.5)), 9).alias("distance"), G.scale_box(b, w, h).alias("p"), G.crop_box(b, w, h, 0.08).alias("c"))
    return df.select("image_id", "idx", "area", "distance", *[F.col(f"{s}.{n}").alias(a) for s, p in (("p", "p"), ("c", "crop_")) for n, a in ((k, p + k[0]) for k in ("x", "y", "width", "height"))])


@query("""SELECT l_suppkey AS image_id, CAST(l_linenumber AS INT) AS idx, count(*) AS area_pixels, round(min(l_orderkey % 100) / 100.0::DOUBLE, 9) AS x, round((max(l_orderkey % 100) - min(l_orderkey % 100) + 1) / 100.0::DOUBLE, 9) AS w,
round((sum(l_orderkey % 100)::DOUBLE / count(*) + 0.5) / 100.0::DOUBLE, 9) AS cx, round((sum(l_partkey % 80)::DOUBLE / count(*) + 0.5) / 80.0::DOUBLE, 9) AS cy FROM lineitem GROUP BY 1, 2""")
def geo_mask(spark, sf):
    """GEO7, with line items as mask pixels."""
    px = view(spark, sf, "lineitem").select(F.col("l_suppkey").alias("image_id"), F.col("l_linenumber").cast("int").alias("idx"), (F.col("l_orderkey") % 100).alias("px"), (F.col("l_partkey") % 80).alias("py"))
    dims = px.select("image_id").distinct().withColumns({"width": F.lit(100), "height": F.lit(80)})
    return S.mask_geometry(px, dims).select("image_id", "idx", "area_pixels", *[F.round(c, 9).alias(c) for c in ("x", "w", "cx", "cy")])


_SEL = """sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area_pixels DESC, (cx - 0.5) * (cx - 0.5) + (cy - 0.5) * (cy - 0.5), idx) AS n FROM v_instances) WHERE n = 1),
u AS (SELECT image_id, count(*) AS cnt, min(x) AS ux, min(y) AS uy, max(x + w) - min(x) AS uw, max(y + h) - min(y) AS uh, list_aggregate(list_sort(list(idx)), 'string_agg', ',') AS idxs FROM v_instances GROUP BY 1),
m AS (SELECT s.image_id, cnt, idx, idxs, CASE WHEN greatest(0.0, uw) * greatest(0.0, uh) > 0 THEN greatest(0.0, w) * greatest(0.0, h) / (greatest(0.0, uw) * greatest(0.0, uh)) ELSE 1.0 END AS ratio, x, y, w, h, ux, uy, uw, uh FROM sel s JOIN u ON s.image_id = u.image_id),
d AS (SELECT *, cnt > 1 AND ratio >= 0.75 AS merged FROM m)"""


@query(f"""{ctes("v_instances")}, {_SEL} SELECT image_id, cnt AS instance_count, merged, round(ratio, 9) AS ratio, CASE WHEN merged THEN idxs ELSE CAST(idx AS VARCHAR) END AS selected, round(CASE WHEN merged THEN ux ELSE x END, 9) AS x, round(CASE WHEN merged THEN uw ELSE w END, 9) AS w FROM d""")
def geo_merge(spark, sf):
    """GEO8, GEO9."""
    df = S.merge_decision(view(spark, sf, "v_instances"))
    return df.select("image_id", "instance_count", "merged", F.round("ratio", 9).alias("ratio"), F.array_join(F.col("selected_indices").cast("array<string>"), ",").alias("selected"), F.round("selected_box.x", 9).alias("x"), F.round("selected_box.width", 9).alias("w"))


@query(f"""{ctes("v_instances")} SELECT image_id, idx AS selected FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area_pixels DESC, (cx - 0.5) * (cx - 0.5) + (cy - 0.5) * (cy - 0.5), idx) AS n FROM v_instances) WHERE n = 1""")
def geo_select(spark, sf):
    """GEO8."""
    return S.select_instance(view(spark, sf, "v_instances")).select("image_id", F.col("idx").alias("selected"))


_bx, _bw = _span("bx", "bw", "width")
_by, _bh = _span("by_", "bh", "height")


@query(f"""{ctes("v_instances", "v_images")}, {_SEL},
i AS (SELECT v.*, cnt, merged, CASE WHEN image_id_d IS NULL THEN 'no_foreground' ELSE 'success' END AS st, CASE WHEN merged THEN ux ELSE x END AS bx, CASE WHEN merged THEN uy ELSE y END AS by_, CASE WHEN merged THEN uw ELSE w END AS bw, CASE WHEN merged THEN uh ELSE h END AS bh FROM v_images v LEFT JOIN (SELECT *, image_id AS image_id_d FROM d) d ON v.image_id = d.image_id),
t AS (SELECT *, CASE WHEN image_id % 23 = 0 THEN 'failed' ELSE st END AS status FROM i),
b AS (SELECT *, {_bx} AS px, {_by} AS py, {_bw} AS pw, {_bh} AS ph FROM t),
g AS (SELECT *, ceil(greatest(pw, ph)::DOUBLE * 0.08)::INT AS margin FROM b),
c AS (SELECT *, greatest(0, px - margin) AS cx0, greatest(0, py - margin) AS cy0, least(width, px + pw + margin) - greatest(0, px - margin) AS cw, least(height, py + ph + margin) - greatest(0, py - margin) AS ch, 2048 AS edge, 4194304 AS total FROM g),
f AS (SELECT *, {_FIT.format(w="cw", h="ch")} AS s FROM c)
SELECT image_id, status, CASE WHEN status = 'success' THEN cnt ELSE 0 END AS instance_count, coalesce(status = 'success' AND merged, false) AS merged, CASE WHEN status = 'success' THEN margin ELSE 0 END AS margin_pixels,
CASE WHEN status = 'success' THEN cx0 END AS crop_x, CASE WHEN status = 'success' THEN cw END AS crop_w, CASE WHEN status = 'success' THEN ch END AS crop_h,
CASE WHEN status = 'success' THEN greatest(1, floor(cw * s))::INT END AS final_w, false AS upscaled, 2.0::DOUBLE AS scale_x, '128,255,0' AS matte,
CASE status WHEN 'failed' THEN 'E_SUBJECT_ISOLATION_FAILED' WHEN 'no_foreground' THEN 'E_SUBJECT_ISOLATION_NO_FOREGROUND' END AS error_code FROM f""")
def geo_isolate(spark, sf):
    """GEO11, GEO12, GEO13, GEO14."""
    v = view(spark, sf, "v_images").withColumns({"analysis_width": F.col("width") / 2.0, "analysis_height": F.col("height") / 2.0, "max_long_edge": F.lit(2048), "max_total_pixels": F.lit(4194304), "matte_rgb": F.array(F.lit(128), F.lit(300), F.lit(-4))})
    failed = v.where("image_id % 23 = 0").select("image_id", F.lit("mask provider failed").alias("message"))
    df = S.isolate(v, view(spark, sf, "v_instances"), failed=failed)
    return df.select("image_id", "status", "instance_count", "merged", "margin_pixels", F.col("crop_box.x").alias("crop_x"), F.col("crop_box.width").alias("crop_w"), F.col("crop_box.height").alias("crop_h"), F.col("final_size.width").alias("final_w"), "upscaled", "scale_x", F.array_join(F.col("matte_rgb").cast("array<string>"), ",").alias("matte"), "error_code")
