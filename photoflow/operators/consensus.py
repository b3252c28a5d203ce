"""Consensus over a session's images, decisions, and review state (specified rules)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photoflow.functions import paths as P
from photoflow.operators.keywords import BANDS, fold
from photoflow.sources.shared import written


def expand_ancestors(obs: DataFrame, path: str = "canonical_path") -> DataFrame:
    """An observation supports each prefix of its path (CNS1); one row per image, prefix and band."""
    parts = F.split(F.col(path), r"\|")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "|"))
    return obs.where(F.col(path).isNotNull()).withColumn(path, F.explode(prefixes))


def consensus_stats(obs: DataFrame, minimum: str = "medium", images: DataFrame | None = None) -> DataFrame:
    """Support per session and entry (CNS2), of observations of at least ``minimum`` (CNS3, before counting).

    ``obs(session_id, image_id, canonical_path, confidence, input_role)``. Eligible images are those of ``images``, or all
    that have an observation. A first aggregation by image keeps popular entries from being gathered by rows.
    """
    eligible = (images if images is not None else obs).select("session_id", "image_id").distinct().groupBy("session_id").agg(F.count("*").alias("eligible_images"))
    kept = obs.where(P.rank_of(F.col("confidence"), BANDS) >= BANDS.index(minimum)).where("canonical_path is not null")
    kept = kept.select("session_id", "image_id", "canonical_path", "confidence", "input_role").distinct()
    up = expand_ancestors(kept)
    per_image = up.groupBy("session_id", "canonical_path", "image_id").agg(F.count_if(F.col("confidence") == "high").alias("h"), F.count_if(F.col("confidence") == "medium").alias("m"), F.bool_or(F.col("input_role") == "whole_image").alias("w"), F.bool_or(F.col("input_role") == "subject_isolated").alias("s"))
    g = per_image.groupBy("session_id", "canonical_path").agg(F.count("*").alias("supporting_images"), F.sum("h").alias("n_high"), F.sum("m").alias("n_medium"), F.bool_or("w").alias("in_whole"), F.bool_or("s").alias("in_subject"))
    return g.join(eligible, "session_id").withColumn("frequency", F.col("supporting_images").cast("double") / F.col("eligible_images"))


def conflicts(stats: DataFrame, vocab: DataFrame) -> DataFrame:
    """Pairs of entries of a session that exclude each other: leaves of one parent, or one exclusion group (CNS4).

    Grouping by parent or group is an equality; pairs are of vocabulary entries, not of observations.
    """
    leaf = vocab.select("canonical_path").join(vocab.where("parent_path is not null").select(F.col("parent_path").alias("canonical_path")).distinct(), "canonical_path", "left_anti").withColumn("leaf", F.lit(True))
    v = vocab.select("canonical_path", "parent_path", "exclusive_group").join(leaf, "canonical_path", "left")
    x = stats.select("session_id", "canonical_path", "frequency").join(v, "canonical_path")
    keys = F.filter(F.array(F.when(F.col("leaf"), F.concat(F.lit("parent:"), F.col("parent_path"))), F.concat(F.lit("group:"), F.col("exclusive_group"))), lambda k: k.isNotNull())
    x = x.select("session_id", "canonical_path", "frequency", F.explode(keys).alias("key"))
    y = x.select("session_id", "key", F.col("canonical_path").alias("other_path"), F.col("frequency").alias("other_frequency"))
    return x.join(y, ["session_id", "key"]).where("canonical_path <> other_path").select("session_id", "canonical_path", "other_path", "other_frequency").distinct()


def propagate(stats: DataFrame, vocab: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``decision`` and ``rule`` per session and entry (CNS5, CNS6).

    review: an entry that needs review never propagates; below: too rare; not_allowed; conflict: another entry that
    excludes it reaches the threshold too; else propagate.
    """
    stats = written(stats, "stats")  # read twice, worked out once
    strong = conflicts(stats, vocab).where(F.col("other_frequency") >= threshold).select("session_id", "canonical_path").distinct().withColumn("_c", F.lit(True))
    df = stats.join(vocab.select("canonical_path", "requires_review", "auto_apply_allowed"), "canonical_path").join(strong, ["session_id", "canonical_path"], "left")
    rule = F.when(F.col("frequency") < threshold, "below_threshold").when(F.col("requires_review"), "requires_review").when(~F.col("auto_apply_allowed"), "not_allowed").when(F.col("_c"), "conflict").otherwise("consensus")
    df = df.withColumn("rule", rule).withColumn("decision", F.when(F.col("rule") == "consensus", "propagate").otherwise("hold"))
    return df.select("session_id", "canonical_path", "supporting_images", "eligible_images", "frequency", "decision", "rule")


def resolve_subject(subjects: DataFrame, canonical: DataFrame, allow_unknown: bool = False) -> DataFrame:
    """``subjects(session_id, subject)`` with the entry that ``canonical(term, canonical_path)`` names: known, unnormalised or rejected (CNS8).

    Names are compared folded; of several entries of a name the least path is taken.
    """
    names = canonical.groupBy(fold(F.col("term")).alias("_k")).agg(F.min("canonical_path").alias("canonical_path"))
    df = subjects.join(names, fold(F.col("subject")) == F.col("_k"), "left").drop("_k")
    return df.withColumn("outcome", F.when(F.col("canonical_path").isNotNull(), "known").otherwise("unnormalised" if allow_unknown else "rejected"))


def apply_session_subject(subjects: DataFrame, images: DataFrame, conflicted: DataFrame, support: DataFrame, allowed: bool = True) -> DataFrame:
    """The session's subject on each of its images but the conflicted ones; images without own support are ``weak`` (CNS7).

    The subject of a session is joined by session, so there is no product of all subjects and images.
    """
    df = images.select("session_id", "image_id").distinct().join(subjects.select("session_id", "canonical_path"), "session_id")
    df = df.join(conflicted.select("session_id", "image_id").distinct(), ["session_id", "image_id"], "left_anti")
    own = support.select("session_id", "image_id", "canonical_path").distinct().withColumn("_s", F.lit(True))
    df = df.join(own, ["session_id", "image_id", "canonical_path"], "left").withColumn("weak", F.col("_s").isNull()).drop("_s")
    return df if allowed else df.limit(0)


def flat_export(keywords: DataFrame, path: str = "canonical_path") -> DataFrame:
    """Keywords of an image that aren't an ancestor of another one of it (CNS9)."""
    up = expand_ancestors(keywords.withColumn("_own", F.col(path)), path).where(F.col(path) != F.col("_own")).select("image_id", path).distinct()
    return keywords.join(up, ["image_id", path], "left_anti")


def decisions(obs: DataFrame, propagated: DataFrame, images: DataFrame, mode: str = "batch_conservative") -> DataFrame:
    """Per image and entry: its own observation, or the session's consensus, and which rule it is (CNS10, CNS11).

    mode: off gives none, single_image own observations only, batch_conservative both; own ones take precedence.
    """
    own = obs.where("canonical_path is not null").select("session_id", "image_id", "canonical_path").distinct().withColumn("rule", F.lit("own_observation"))
    if mode == "off":
        return own.limit(0)
    if mode == "single_image":
        return own
    spread = images.select("session_id", "image_id").distinct().join(propagated.where("decision = 'propagate'").select("session_id", "canonical_path"), "session_id")
    spread = spread.join(own, ["session_id", "image_id", "canonical_path"], "left_anti").withColumn("rule", F.lit("batch_consensus"))
    return own.unionByName(spread)


def check_stale(decided: DataFrame, images: DataFrame, override: bool = False, path: str = "relative_path") -> DataFrame:
    """E_SESSION_STALE where an asset's identity (policy and hash) isn't the decision's any more, or is gone (CNS12)."""
    now = images.select(path, F.struct("identity.policy", "identity.sha256").alias("_now"))
    df = decided.join(now, path, "left")
    stale = ~F.struct("identity.policy", "identity.sha256").eqNullSafe(F.col("_now"))
    return df.withColumn("error_code", F.when(stale & ~F.lit(override), "E_SESSION_STALE")).drop("_now")


def asset_state(events: DataFrame, error_code: str | None = None) -> DataFrame:
    """Latest state of each asset; with ``error_code``, assets whose latest state has it (REV1)."""
    key = F.struct("ts", "event_id")
    out = events.groupBy("source_path").agg(F.max_by("status", key).alias("status"), F.max_by("error_code", key).alias("error_code"))
    return out if error_code is None else out.where(F.col("error_code") == error_code)


def needs_reprocess(docs: DataFrame, target: dict[str, str]) -> DataFrame:
    """Documents any of whose versions isn't the target's, with the names of these (REV2)."""
    stale = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.lit(v)), F.lit(c)) for c, v in target.items()]), lambda x: x.isNotNull())
    return docs.withColumn("stale", stale).where("size(stale) > 0")


def apply_correction(tags: DataFrame, scope: DataFrame, old: str, new: str, keys: list[str] | None = None) -> DataFrame:
    """``tags(image_id, term, ...)`` with ``old`` replaced by ``new`` on the images in ``scope`` (REV3); twins become one."""
    keys = keys or ["image_id"]
    hit = tags.join(scope.select(*keys).distinct().withColumn("_in", F.lit(True)), keys, "left")
    return hit.withColumn("term", F.when(F.col("_in") & (F.col("term") == old), new).otherwise(F.col("term"))).drop("_in").distinct()


def remerge(snapshot: DataFrame, current: DataFrame, approved: DataFrame) -> DataFrame:
    """Terms of a file after its base changed outside: ``file_id, term, keep, why`` (REV4).

    What was added outside survives, what was deleted outside doesn't come back, and approved changes are applied to the
    rest: terms of ``approved`` are added, and those of the snapshot that it lacks are removed.
    """
    own = lambda df, c: df.select("file_id", "term").distinct().withColumn(c, F.lit(True))
    keys = ["file_id", "term"]
    df = own(snapshot, "s").join(own(current, "c"), keys, "full").join(own(approved, "a"), keys, "full")
    s, c, a = (F.coalesce(x, F.lit(False)) for x in ("s", "c", "a"))
    why = F.when(c & ~s, "added_outside").when(s & ~c, "deleted_outside").when(a & ~s, "approved").when(s & ~a, "removed").otherwise("unchanged")
    return df.select(*keys, why.isin("added_outside", "approved", "unchanged").alias("keep"), why.alias("why"))


