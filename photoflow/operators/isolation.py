"""Subject isolation decisions from instance geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photoflow.functions import geometry as G


def mask_geometry(pixels: DataFrame, dims: DataFrame, keys: tuple[str, str] = ("image_id", "idx")) -> DataFrame:
    """Mask pixels (keys, px, py) and image ``width, height`` to instance rows: area, normalised box and centroid (GEO7).

    A pixel's centre is half a pixel in; instances without pixels don't appear.
    """
    image, idx = keys
    g = pixels.groupBy(image, idx).agg(F.count("*").alias("area_pixels"), F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"), F.sum("px").alias("sx"), F.sum("py").alias("sy"))
    g, w, h = g.join(dims.select(image, "width", "height"), image), F.col("width").cast("double"), F.col("height").cast("double")
    n = F.col("area_pixels").cast("double")
    return g.select(
        image, idx, "area_pixels", (F.col("x0") / w).alias("x"), (F.col("y0") / h).alias("y"), ((F.col("x1") - F.col("x0") + 1) / w).alias("w"), ((F.col("y1") - F.col("y0") + 1) / h).alias("h"),
        ((F.col("sx") / n + 0.5) / w).alias("cx"), ((F.col("sy") / n + 0.5) / h).alias("cy"),
    )


def select_instance(instances: DataFrame, image: str = "image_id") -> DataFrame:
    """The largest instance of each image; ties go to the nearest to the centre, then the least index (GEO8)."""
    d = G.squared_distance(F.col("cx"), F.col("cy"), F.lit(0.5), F.lit(0.5))
    w = Window.partitionBy(image).orderBy(F.desc("area_pixels"), d, "idx")
    return instances.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_decision(instances: DataFrame, threshold: float = 0.75, image: str = "image_id") -> DataFrame:
    """Per image: the selected instance, or all of them where its box is ``threshold`` of the union's area or more (GEO9).

    One pass: the best instance is the least of (-area, distance, index), so nothing is gathered but an image's indices.
    """
    d = G.squared_distance(F.col("cx"), F.col("cy"), F.lit(0.5), F.lit(0.5))
    best = F.min(F.struct((-F.col("area_pixels")).alias("a"), d.alias("d"), "idx", "x", "y", "w", "h")).alias("s")
    g = instances.groupBy(image).agg(
        best, F.count("*").alias("instance_count"), F.sort_array(F.collect_list("idx")).alias("all_indices"),
        F.min("x").alias("ux"), F.min("y").alias("uy"), F.max(F.col("x") + F.col("w")).alias("ux2"), F.max(F.col("y") + F.col("h")).alias("uy2"),
    )
    own = G.box(F.col("s.x"), F.col("s.y"), F.col("s.w"), F.col("s.h"))
    union = G.box(F.col("ux"), F.col("uy"), F.col("ux2") - F.col("ux"), F.col("uy2") - F.col("uy"))
    g = g.select(image, "instance_count", "all_indices", F.col("s.idx").alias("selected_idx"), own.alias("own"), union.alias("union_box"))
    ratio = F.when(G.area(F.col("union_box")) > 0, G.area(F.col("own")) / G.area(F.col("union_box"))).otherwise(F.lit(1.0))
    g = g.withColumn("ratio", ratio).withColumn("merged", (F.col("instance_count") > 1) & (F.col("ratio") >= threshold))
    return g.select(image, "instance_count", "merged", "ratio", F.when(F.col("merged"), F.col("all_indices")).otherwise(F.array("selected_idx")).alias("selected_indices"), F.when(F.col("merged"), F.col("union_box")).otherwise(F.col("own")).alias("selected_box"))


def isolate(images: DataFrame, instances: DataFrame, threshold: float = 0.75, margin: float = 0.08, failed: DataFrame | None = None, image: str = "image_id") -> DataFrame:
    """One isolation record per image of ``images(image, width, height, analysis_width, analysis_height, max_long_edge, max_total_pixels, matte_rgb)``.

    status: failed for images in ``failed(image, message)`` (GEO14), no_foreground without instances, else success (GEO13).
    Crop, margin, scale factors and final size follow the selected box (GEO10, GEO11); a crop is never upscaled.
    """
    df = images.join(merge_decision(instances, threshold, image), image, "left")
    if failed is not None:
        df = df.join(failed.select(image, F.col("message").alias("_failed")), image, "left")
    else:
        df = df.withColumn("_failed", F.lit(None).cast("string"))
    status = F.when(F.col("_failed").isNotNull(), "failed").when(F.col("instance_count").isNull(), "no_foreground").otherwise("success")
    df = df.withColumn("status", status)
    ok = F.col("status") == "success"
    px = G.scale_box(F.col("selected_box"), F.col("width"), F.col("height"))
    df = df.withColumn("full_box", F.when(ok, px))
    df = df.withColumn("margin_pixels", F.when(ok, G.margin_pixels(F.col("full_box"), margin)).otherwise(0))
    df = df.withColumn("crop_box", F.when(ok, G.expand_box(F.col("full_box"), F.col("margin_pixels"), F.col("width"), F.col("height"))))
    final = G.fit_dimensions(F.col("crop_box.width"), F.col("crop_box.height"), F.col("max_long_edge"), F.col("max_total_pixels"))
    df = df.withColumn("final_size", F.when(ok, final))
    up = (F.col("final_size.width") > F.col("crop_box.width")) | (F.col("final_size.height") > F.col("crop_box.height"))
    code = F.when(F.col("status") == "failed", "E_SUBJECT_ISOLATION_FAILED").when(F.col("status") == "no_foreground", "E_SUBJECT_ISOLATION_NO_FOREGROUND")
    return df.select(
        image, "status", F.when(ok, F.col("instance_count")).otherwise(F.lit(0).cast("long")).alias("instance_count"), F.when(ok, F.col("selected_indices")).otherwise(F.array().cast("array<int>")).alias("selected_indices"),
        F.coalesce(ok & F.col("merged"), F.lit(False)).alias("merged"), F.when(ok, F.col("ratio")).alias("ratio"), F.when(ok, F.col("selected_box")).alias("selected_box"), "crop_box", "margin_pixels",
        (F.col("width").cast("double") / F.col("analysis_width")).alias("scale_x"), (F.col("height").cast("double") / F.col("analysis_height")).alias("scale_y"), "final_size",
        F.coalesce(up, F.lit(False)).alias("upscaled"), G.matte(F.col("matte_rgb")).alias("matte_rgb"), code.alias("error_code"),
    )
