"""Media columns: cropped and edited copies of images found by local descriptors.

Corners at several scales get an orientation and 256 binary intensity tests turned with it, in numpy within tasks. Spark
joins the descriptors on four 64-bit parts, which any two within RADIUS bits share one of, and settles the geometry: each
match votes for a turn, a change of scale and a shift, and a pair of images is kept where enough votes meet.
Equal images are described once, and results go back to all of them by their class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photoflow.llm.common import materialise

RADIUS, LEVELS, BORDER, TURNS = 3, 2, 8, 32
WORDS = ["d0", "d1", "d2", "d3"]
#: Votes that a pair needs, and the bins that they fall in: degrees of turn and pixels of shift.
MIN_VOTES, TURN_BIN, SHIFT_BIN = 5, 30.0, 6.0
_r = np.random.default_rng(5)
_POINTS = np.clip(_r.normal(0, 2.6, (256, 2, 2)), -5.5, 5.5)
_ANGLES = 2 * np.pi * np.arange(TURNS) / TURNS
_TURNED = np.rint(np.einsum("tij,pkj->tpki", np.stack([np.stack([np.cos(_ANGLES), -np.sin(_ANGLES)], -1), np.stack([np.sin(_ANGLES), np.cos(_ANGLES)], -1)], 1), _POINTS)).astype(np.int64)
_YX = np.stack(np.meshgrid(np.arange(-6, 7), np.arange(-6, 7), indexing="ij"), -1).reshape(-1, 2)
_YX = _YX[(_YX**2).sum(1) <= 36]


def _box(x: np.ndarray, k: int) -> np.ndarray:
    """Sums over (2k+1) x (2k+1) windows, edges repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (k + 1, k)
        c = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis, dtype=np.float64)
        n = x.shape[axis]
        hi, lo = [slice(None)] * 3, [slice(None)] * 3
        hi[axis], lo[axis] = slice(2 * k + 1, 2 * k + 1 + n), slice(0, n)
        x = c[tuple(hi)] - c[tuple(lo)]
    return x


def descriptors(images: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of images (n, height, width), equal in size: image, y, x, scale, angle in degrees and four 64-bit parts of each corner."""
    parts, img = [], images.astype(np.float64)
    for level in range(LEVELS):
        n, h, w = img.shape
        if min(h, w) <= 2 * BORDER + 1:
            break
        dy, dx = np.gradient(img, axis=(1, 2))
        a, b, c = _box(dx * dx, 2), _box(dy * dy, 2), _box(dx * dy, 2)
        harris = _box(a * b - c * c - 0.05 * (a + b) ** 2, 1)
        top = harris.copy()
        for sy in range(-2, 3):
            for sx in range(-2, 3):
                top = np.maximum(top, np.roll(harris, (sy, sx), axis=(1, 2)))
        peak = (harris >= top) & (harris > 0.01 * harris.max(axis=(1, 2), keepdims=True)) & (harris > 1e-6)
        peak[:, :BORDER] = peak[:, -BORDER:] = False
        peak[:, :, :BORDER] = peak[:, :, -BORDER:] = False
        i, y, x = np.nonzero(peak)
        flat = _box(img, 1)
        patch = flat[i[:, None], y[:, None] + _YX[:, 0], x[:, None] + _YX[:, 1]]
        patch = patch - patch.mean(1, keepdims=True)
        angle = np.arctan2((patch * _YX[:, 0]).sum(1), (patch * _YX[:, 1]).sum(1))
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
        at = _TURNED[turn]  # corner, test, end, (x, y)
        value = flat[i[:, None, None], y[:, None, None] + at[..., 1], x[:, None, None] + at[..., 0]]
        bits = np.packbits(value[..., 0] > value[..., 1] + 1e-6, axis=1).view(">u8").astype(np.int64)
        s = 2.0**level
        parts.append((i, y * s, x * s, np.full(len(i), level), np.degrees(angle), *bits.T))
        img = img[:, : h // 2 * 2, : w // 2 * 2].reshape(n, h // 2, 2, w // 2, 2).mean(axis=(2, 4))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else tuple(np.empty(0, dtype=np.int64) for _ in range(9))


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["y", "x", "level", "angle", *WORDS]
    for pdf in batches:
        pdf = pdf[(pdf["height"] > 0) & (pdf["width"] > 0) & (pdf["pixels"].str.len() == pdf["height"] * pdf["width"])]
        for (h, w), group in pdf.groupby(["height", "width"]):
            for k in range(0, len(group), 256):
                some = group.iloc[k : k + 256]
                images = np.stack([np.frombuffer(p, np.uint8).reshape(h, w) for p in some["pixels"]])
                i, *rest = descriptors(images)
                out = pd.DataFrame(dict(zip(names, rest, strict=True)))
                out.insert(0, "id", some["id"].to_numpy()[i])
                yield out


def described(images: DataFrame) -> DataFrame:
    """``images(id, height, width, pixels)``, grey bytes by row, to a row for each corner; other sizes and nulls have none."""
    schema = f"id {dict(images.dtypes)['id']}, y double, x double, level int, angle double, d0 long, d1 long, d2 long, d3 long"
    return images.where("pixels is not null and height is not null and width is not null").mapInPandas(_described, schema)


def matches(queries: DataFrame, images: DataFrame) -> DataFrame:
    """Pairs ``query, image, votes`` of two sets of ``id, height, width, pixels`` with at least MIN_VOTES consistent matches."""
    parts = F.array(*[F.struct(F.lit(k).alias("part"), F.col(d).alias("bits")) for k, d in enumerate(WORDS)])
    columns = ["y", "x", "level", "angle", *WORDS]
    left = described(queries).select(F.col("id").alias("query"), *[F.col(c).alias(f"q_{c}") for c in columns], F.explode(parts).alias("k")).select("*", "k.part", "k.bits")
    right = described(images).select(F.col("id").alias("image"), *columns, F.explode(parts).alias("k")).select("*", "k.part", "k.bits")
    # two corners that are alike in several parts meet in the first of them only
    first = " and ".join(f"(part <= {k} or {d} <> q_{d})" for k, d in enumerate(WORDS))
    near = left.join(right, ["part", "bits"]).where(first).where(" + ".join(f"bit_count({d} ^ q_{d})" for d in WORDS) + f" <= {RADIUS}")
    # the similarity that takes the image's corner to the query's; the scale is in octaves
    turn, scale = F.radians(F.col("q_angle") - F.col("angle")), F.pow(F.lit(2.0), F.col("q_level") - F.col("level"))
    sx = F.col("q_x") - scale * (F.cos(turn) * F.col("x") - F.sin(turn) * F.col("y"))
    sy = F.col("q_y") - scale * (F.sin(turn) * F.col("x") + F.cos(turn) * F.col("y"))
    bin_ = lambda c, k: F.array(F.floor(c / k), F.floor(c / k) + 1)  # noqa: E731  each vote counts in neighbouring bins
    spots = near.select("query", "image", "q_y", "q_x", "q_level", (F.col("q_level") - F.col("level")).alias("octave"), F.floor(F.pmod(F.degrees(turn), F.lit(360.0)) / TURN_BIN + 0.5).alias("turn"), bin_(sx / SHIFT_BIN - 0.5, 1).alias("bx"), bin_(sy / SHIFT_BIN - 0.5, 1).alias("by"))
    spots = spots.withColumn("turn", F.col("turn") % int(360 / TURN_BIN)).select("query", "image", "octave", "turn", F.explode("bx").alias("bx"), "by", "q_y", "q_x", "q_level").select("*", F.explode("by").alias("b2")).drop("by").distinct()
    votes = spots.groupBy("query", "image", "octave", "turn", "bx", "b2").agg(F.count("*").alias("votes"))
    return votes.groupBy("query", "image").agg(F.max("votes").alias("votes")).where(f"votes >= {MIN_VOTES}")


def classes(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One image of each class of equal ones, and ``id, class``; a class is the least id."""
    key = F.xxhash64("height", "width", "pixels"), F.sha2("pixels", 256)
    keyed = images.select("*", F.concat_ws("-", *key).alias("key"))
    least = materialise(keyed.groupBy("key").agg(F.min("id").alias("class")), "classes")
    members = keyed.select("id", "key").join(least, "key").select("id", "class")
    return images.join(least.select(F.col("class").alias("id")), "id", "left_semi"), members


def search(queries: DataFrame, images: DataFrame) -> DataFrame:
    """For each query: ``id, query_class, n_matches, best_class, best_votes``; classes stand for all their equal images.

    Ties in votes go to the least class. Queries without a match have 0 and nulls. Null or damaged pixels match nothing.
    """
    q, q_members = classes(queries)
    d, _members = classes(images)
    found = matches(q, d)
    best = found.groupBy("query").agg(F.count("*").alias("n_matches"), F.max(F.struct("votes", (-F.col("image")).alias("image"))).alias("b"))
    best = best.select(F.col("query").alias("class"), "n_matches", (-F.col("b.image")).alias("best_class"), F.col("b.votes").alias("best_votes"))
    out = q_members.join(best, "class", "left")
    return out.select("id", F.col("class").alias("query_class"), F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"), "best_class", "best_votes")


def rendered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = 4, side: int = 16) -> DataFrame:
    """Grey mosaics of ``side`` x ``side`` tiles: a fixed random projection of each vector, in 256 steps of its own range.

    Null and empty vectors have no pixels. Equal vectors give equal images, and near ones nearly equal ones.
    """

    def run(batches):
        known = {}
        for pdf in batches:
            rows = []
            for i, v in zip(pdf["id"], pdf["v"], strict=True):
                if v is None or len(v) == 0:
                    rows.append((i, None, None, None))
                    continue
                if len(v) not in known:
                    known[len(v)] = np.random.default_rng(len(v)).normal(size=(side * side, len(v)))
                g = known[len(v)] @ np.nan_to_num(np.asarray(v, dtype=np.float64))
                g = np.rint(255 * (g - g.min()) / max(float(np.ptp(g)), 1e-9)).astype(np.uint8).reshape(side, side)
                rows.append((i, side * tile, side * tile, np.kron(g, np.ones((tile, tile), np.uint8)).tobytes()))
            yield pd.DataFrame(rows, columns=["id", "height", "width", "pixels"]).astype({"height": "Int32", "width": "Int32"})

    src = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    return src.mapInPandas(run, f"id {dict(src.dtypes)['id']}, height int, width int, pixels binary")


def edited(images: DataFrame) -> DataFrame:
    """Copies of ``images``, cropped, dimmed or turned by a right angle, by id."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, h, w, p in zip(pdf["id"], pdf["height"], pdf["width"], pdf["pixels"], strict=True):
                if p is None:
                    rows.append((i, None, None, None))
                    continue
                x = np.frombuffer(p, np.uint8).reshape(int(h), int(w))
                kind = (i // 20) % 3
                x = x[h // 8 : h - h // 8, w // 8 : w - w // 8] if kind == 0 else np.rint(0.8 * x + 20).astype(np.uint8) if kind == 1 else np.rot90(x)
                rows.append((i, x.shape[0], x.shape[1], np.ascontiguousarray(x).tobytes()))
            yield pd.DataFrame(rows, columns=["id", "height", "width", "pixels"]).astype({"height": "Int32", "width": "Int32"})

    return images.mapInPandas(run, images.schema)


def op7_image_match(spark, sf_dir: str) -> DataFrame:
    """Edited copies of the images whose id is divisible by 20, searched for among all images of ``embeddings``."""
    images = rendered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(edited(images.where("id % 20 = 0")), images)
