"""Columns for dimensions, orientation and boxes. Boxes are structs ``x, y, width, height``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The built-in profiles' names, long edges, pixel totals and matte.
PROFILES = [("gemma4-26b-default", 2048, 4194304, [128, 128, 128]), ("gemma4-26b-benchmark-1024", 1024, 1048576, [128, 128, 128]), ("gemma4-26b-benchmark-1536", 1536, 2359296, [128, 128, 128])]


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, "profile string, max_long_edge int, max_total_pixels int, matte_rgb array<int>")


def join_profile(df: DataFrame, known: DataFrame, name: str = "profile") -> DataFrame:
    """With the profile's columns; an unknown name gives ``profile_error`` E_CONFIG_INVALID (GEO2). Profiles are a fixed few."""
    out = df.join(F.broadcast(known.withColumn("_known", F.lit(True))), name, "left")
    return out.withColumn("profile_error", F.when(F.col("_known").isNull(), "E_CONFIG_INVALID")).drop("_known")


def fit_dimensions(w: Column, h: Column, edge: Column, total: Column, upscale: bool = False) -> Column:
    """Largest ``width, height`` of this shape inside both caps, floored, 1 at least, never larger unless ``upscale`` (GEO1)."""
    wide, high = w.cast("double"), h.cast("double")
    scale = F.least(edge.cast("double") / F.greatest(wide, high), F.sqrt(total.cast("double") / (wide * high)))
    scale = scale if upscale else F.least(F.lit(1.0), scale)
    one = lambda v: F.greatest(F.lit(1), F.floor(v * scale).cast("int"))
    return F.when((w > 0) & (h > 0), F.struct(one(wide).alias("width"), one(high).alias("height")))


def resolve_orientation(exif: Column, w: Column, h: Column) -> Column:
    """orientation (absent: 1), upright ``width`` and ``height`` (5 to 8 swap them), and ``error`` for other values (GEO3)."""
    o = F.coalesce(exif, F.lit(1))
    ok, swap = o.between(1, 8), o.between(5, 8)
    return F.struct(F.when(ok, o).alias("orientation"), F.when(ok, F.when(swap, h).otherwise(w)).alias("width"), F.when(ok, F.when(swap, w).otherwise(h)).alias("height"), F.when(~ok, "E_ORIENTATION_UNRESOLVED").alias("error"))


def box(x, y, w, h) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["width"]) * F.greatest(F.lit(0.0), b["height"])


def union_box(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return box(x, y, F.greatest(a["x"] + a["width"], b["x"] + b["width"]) - x, F.greatest(a["y"] + a["height"], b["y"] + b["height"]) - y)


def squared_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def scale_box(b: Column, w: Column, h: Column) -> Column:
    """Normalised to pixels: floored start, ceiled end, inside the frame, 1 pixel at least (GEO5)."""

    def span(start, size, n):
        lo = F.least(F.greatest(F.floor(start * n).cast("int"), F.lit(0)), n - 1)
        hi = F.least(F.greatest(F.ceil((start + size) * n).cast("int"), lo + 1), n)
        return lo, hi - lo

    (x, dx), (y, dy) = span(b["x"], b["width"], w), span(b["y"], b["height"], h)
    return box(x, y, dx, dy)


def expand_box(b: Column, margin: Column, w: Column, h: Column) -> Column:
    """Grown on every side by ``margin`` pixels inside the frame (GEO6)."""
    x, y = F.greatest(F.lit(0), b["x"] - margin), F.greatest(F.lit(0), b["y"] - margin)
    return box(x, y, F.least(w, b["x"] + b["width"] + margin) - x, F.least(h, b["y"] + b["height"] + margin) - y)


def margin_pixels(b: Column, fraction: float) -> Column:
    return F.ceil(F.greatest(b["width"], b["height"]).cast("double") * fraction).cast("int")


def crop_box(b: Column, w: Column, h: Column, fraction: float) -> Column:
    """Of a normalised box: its pixels grown by a fraction of the longer side (GEO10)."""
    px = scale_box(b, w, h)
    return expand_box(px, margin_pixels(px, fraction), w, h)


def matte(rgb: Column) -> Column:
    """Three values in 0..255, or grey (GEO12)."""
    return F.when(F.size(rgb) == 3, F.transform(rgb, lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(255)))).otherwise(F.array(*[F.lit(128)] * 3))
