"""Keywords from valid runs, and the plan of what an export would change (specified rules; no running code to compare with)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photoflow.functions import paths as P
from photoflow.sources.documents import get

BANDS = ["low", "medium", "high"]
FIELDS = ["genre_or_photography_type", "species", "main_subjects", "secondary_subjects", "scene_context", "habitat_or_setting", "behavior_or_action", "proposed_keywords"]
SCENE_FIELDS = ["genre_or_photography_type", "scene_context", "habitat_or_setting"]
SEPARATOR = "|"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).casefold()))


def normalize_keyword(c: Column, ascii_only: bool = False) -> Column:
    """NFC, trimmed, white space as one space; casing stays (KEY2). ``ascii_only`` texts are in NFC as they are."""
    return F.trim(F.regexp_replace(c if ascii_only else _nfc(c), r"\s+", " "))


def fold(c: Column, ascii_only: bool = False) -> Column:
    """For comparison: NFC, case folded, white space as one space; accents and stems stay (VOC6)."""
    return F.trim(F.regexp_replace(F.lower(c) if ascii_only else _casefold(c), r"\s+", " "))


def extract_candidates(runs: DataFrame, parsed: str = "parsed", image: str = "image_id", role: str = "input_role") -> DataFrame:
    """Candidates of each field of each valid run: ``field, position, term, confidence, evidence`` (KEY1)."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), get(F.col(parsed), f"$.{f}", "array<variant>").alias("items")) for f in FIELDS])
    df = runs.select(image, role, F.explode(each).alias("f")).select(image, role, "f.field", F.posexplode("f.items").alias("position", "item"))
    text = lambda k: get(F.col("item"), f"$.{k}", "string").alias(k)
    return df.select(image, role, "field", "position", text("term"), text("confidence"), text("evidence"))


def screen_keywords(cands: DataFrame, term: str = "term") -> tuple[DataFrame, DataFrame]:
    """Without empty terms; terms that hold the level separator are warnings (KEY3)."""
    df = cands.where(F.length(F.trim(F.coalesce(F.col(term), F.lit("")))) > 0)
    return df.where(~F.contains(F.col(term), F.lit(SEPARATOR))), df.where(F.contains(F.col(term), F.lit(SEPARATOR))).withColumn("reason", F.lit("contains_separator"))


def filter_band(cands: DataFrame, minimum: str = "medium") -> DataFrame:
    """Candidates of at least this confidence band: low < medium < high (KEY4)."""
    return cands.where(P.rank_of(F.col("confidence"), BANDS) >= BANDS.index(minimum))


def prefer_role(cands: DataFrame, image: str = "image_id") -> DataFrame:
    """One candidate per image and folded term: scene fields from the whole image, others from the subject (KEY5)."""
    wanted = F.when(F.col("field").isin(SCENE_FIELDS), "whole_image").otherwise("subject_isolated")
    rank = F.when(F.col("input_role") == wanted, 0).otherwise(1)
    w = Window.partitionBy(image, F.lower("term")).orderBy(rank, "input_role", "field", "position", "term")
    return cands.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def is_specific(c: Column) -> Column:
    """Capitalised words of two or more, or a binomial, which name something in particular (KEY6, a heuristic)."""
    return c.rlike(r"^[A-Z]\w*(?:[ _][A-Z]\w*)+$") | c.rlike(r"^[A-Z][a-z]+ [a-z]{3,}$")


def screen_specific(cands: DataFrame, allow: bool = False, term: str = "term") -> DataFrame:
    return cands if allow else cands.where(~F.coalesce(is_specific(F.col(term)), F.lit(False)))


def group_pairs(images: DataFrame, path: str = "relative_path") -> DataFrame:
    """Files of one folder and stem in any case: ``pair_key, n_files, has_raw, has_jpeg, target_path`` for two or more (KEY7)."""
    p = F.col(path)
    kind = P.detected_type(P.extension(p))
    key = F.concat_ws("/", P.folder(p), F.lower(P.stem(p)))
    g = images.groupBy(key.alias("pair_key")).agg(F.count("*").alias("n_files"), F.bool_or(F.coalesce(P.is_raw(kind), F.lit(False))).alias("has_raw"), F.bool_or(F.coalesce(kind.isin("jpg", "jpeg"), F.lit(False))).alias("has_jpeg"), F.min(path).alias("target_path"))
    return g.where("n_files > 1")


def resolve_pairs(cands: DataFrame, scope: str = "union") -> DataFrame:
    """``cands(target_path, source_path, is_raw, term)`` to a row per path, folded term and source of it (KEY8).

    scope: union, raw-only or jpeg-only. The spelling is the least source's; ``n_sources`` says how many rows a term has.
    """
    df = cands if scope == "union" else cands.where("is_raw" if scope == "raw-only" else "not is_raw")
    each = df.groupBy("target_path", F.lower("term").alias("folded"), "source_path").agg(F.min("term").alias("_term"))
    named = each.groupBy("target_path", "folded").agg(F.min_by("_term", F.struct("source_path", "_term")).alias("term"), F.count("source_path").alias("n_sources"))
    return each.join(named, ["target_path", "folded"]).select("target_path", "folded", "term", "n_sources", "source_path")


def change_plan(cands: DataFrame, existing: DataFrame, path: str = "target_path") -> DataFrame:
    """``action`` per path and folded term: add, keep what is there, skip what is both (KEY9). Of several spellings the least is taken."""
    a = cands.groupBy(path, F.lower("term").alias("folded")).agg(F.min("term").alias("new_term"))
    b = existing.groupBy(path, F.lower("term").alias("folded")).agg(F.min("term").alias("old_term"))
    df = a.join(b, [path, "folded"], "full")
    action = F.when(F.col("old_term").isNull(), "add").when(F.col("new_term").isNull(), "keep").otherwise("skip")
    return df.select(path, "folded", F.coalesce("old_term", "new_term").alias("term"), action.alias("action"), F.when(action == "skip", "already_present").alias("reason"))


def roundtrip_diff(before: DataFrame, after: DataFrame, expected: DataFrame, path: str = "target_path") -> DataFrame:
    """Terms that a write lost, and expected ones that it didn't bring: ``kind`` lost or missing (KEY10)."""
    lost = before.select(path, "term").distinct().join(after, [path, "term"], "left_anti").withColumn("kind", F.lit("lost"))
    return lost.union(expected.select(path, "term").distinct().join(after, [path, "term"], "left_anti").withColumn("kind", F.lit("missing")))


def validate_export(files: DataFrame, diff: DataFrame, path: str = "target_path") -> DataFrame:
    """restore a file with any difference, else ok; the batch goes on (KEY11)."""
    bad = diff.groupBy(path).agg(F.count("*").alias("n_differences"))
    return files.select(path).distinct().join(bad, path, "left").select(path, F.coalesce("n_differences", F.lit(0).cast("long")).alias("n_differences"), F.when(F.col("n_differences").isNull(), "ok").otherwise("restore").alias("outcome"))


def export_report(plan: DataFrame, path: str = "target_path") -> DataFrame:
    """Changes by path, by action and reason, and in all (KEY12)."""
    return plan.groupingSets([[path], ["action", "reason"], []], path, "action", "reason").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
