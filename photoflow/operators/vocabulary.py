"""Vocabulary checks and canonical terms (specified rules)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photoflow.operators.cycles import on_cycles
from photoflow.operators.keywords import fold
from photoflow.sources.shared import drop, written

ENTRY = "canonical_path string, parent_path string, flat_keyword string, synonyms array<string>, requires_review boolean, auto_apply_allowed boolean, mutually_exclusive_group string, export_flat_keyword boolean, export_hierarchical_keyword boolean"
#: Entries that are broadcast at most; beyond it terms are joined by a shuffle.
BROADCAST_ENTRIES = 200_000


def load_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Entries of a JSON file ``{"schema_version": "image-vocabulary/1.x", "entries": [...]}`` with defaults, and its content hash (VOC1).

    A vocabulary is one small document, checked on the driver: another name or major version raises.
    """
    schema = f"schema_version string, entries array<struct<{','.join(':'.join(f.strip().split(' ', 1)) for f in ENTRY.split(', '))}>>"
    df = spark.read.schema(schema).json(path, multiLine=True)
    version = df.first().schema_version or ""
    if not version.startswith("image-vocabulary/1."):
        raise ValueError(f"E_SCHEMA_UNSUPPORTED: {version}")
    digest = spark.read.text(path, wholetext=True).select(F.sha2("value", 256)).first()[0]
    e = df.select(F.explode("entries").alias("e")).select("e.*")
    yes, no = F.lit(True), F.lit(False)
    return e.withColumns({"synonyms": F.coalesce("synonyms", F.array().cast("array<string>")), "requires_review": F.coalesce("requires_review", no), "auto_apply_allowed": F.coalesce("auto_apply_allowed", yes), "export_flat_keyword": F.coalesce("export_flat_keyword", yes), "export_hierarchical_keyword": F.coalesce("export_hierarchical_keyword", yes)}), digest


def duplicate_paths(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("canonical_path").agg(F.count("*").alias("n")).where("n > 1")  # VOC2


def ambiguous_synonyms(vocab: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Folded names that stand for several entries, as synonyms or terms: ``name, n_entries, canonical_path``, a row per entry (VOC3)."""
    terms = vocab.select("canonical_path", fold(F.col("flat_keyword"), ascii_only).alias("name"), F.lit(0).alias("is_synonym"))
    syn = vocab.select("canonical_path", F.explode("synonyms").alias("s")).select("canonical_path", fold(F.col("s"), ascii_only).alias("name"), F.lit(1).alias("is_synonym"))
    each = terms.union(syn).groupBy("name", "canonical_path").agg(F.max("is_synonym").alias("m"))
    many = each.groupBy("name").agg(F.count("canonical_path").alias("n_entries"), F.max("m").alias("m")).where("n_entries > 1 and m = 1").select("name", "n_entries")
    return each.where("canonical_path is not null").join(many, "name").select("name", "n_entries", "canonical_path")


def orphan_parents(vocab: DataFrame) -> DataFrame:
    parents = vocab.select(F.col("canonical_path").alias("parent_path")).distinct()
    return vocab.where("parent_path is not null").join(parents, "parent_path", "left_anti").select("canonical_path", "parent_path")  # VOC4


def cycles(vocab: DataFrame) -> DataFrame:
    """Entries whose chain of parents comes back to them, however long (VOC5).

    Where every entry has one parent, steps are doubled in each round, and what 2^k steps reach shrinks to the entries of
    the cycles. With several parents (repeated paths) :func:`on_cycles` finds them; either takes space in proportion.
    """
    edges = vocab.where("parent_path is not null and canonical_path is not null").selectExpr("canonical_path as a", "parent_path as b").distinct()
    step = written(edges, "cycles")
    if not step.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        out = on_cycles(step).select(F.col("node").alias("canonical_path"))
        drop(step)
        return out
    size = None
    while True:
        reached = step.select("b").distinct()
        now = reached.count()
        if now == size:
            return reached.select(F.col("b").alias("canonical_path"))
        size = now
        twice = written(step.join(step.selectExpr("a as b", "b as c"), "b").selectExpr("a", "c as b"), "cycles")
        drop(step)
        step = twice


def canonicalize(cands: DataFrame, vocab: DataFrame, term: str = "term", ascii_only: bool = False) -> DataFrame:
    """``cands`` with ``canonical_path`` and the vocabulary's spelling, by folded term or synonym; null without an entry (VOC7).

    A term before a synonym, then the least path. The vocabulary is broadcast up to BROADCAST_ENTRIES names.
    """
    names = vocab.select("canonical_path", "flat_keyword", F.lit(0).alias("rank"), F.col("flat_keyword").alias("name"))
    names = names.union(vocab.select("canonical_path", "flat_keyword", F.lit(1).alias("rank"), F.explode("synonyms").alias("name")))
    names = names.withColumn("_key", fold(F.col("name"), ascii_only)).groupBy("_key").agg(F.min(F.struct("rank", "canonical_path", "flat_keyword")).alias("e"))
    names = names.select("_key", "e.canonical_path", F.col("e.flat_keyword").alias("canonical_term"))
    small = names.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    keyed = cands.withColumn("_key", fold(F.col(term), ascii_only))
    return keyed.join(F.broadcast(names) if small else names, "_key", "left").drop("_key")
