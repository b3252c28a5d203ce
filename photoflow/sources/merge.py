"""Documents merged level by level in Spark (JSN7): objects by key, arrays by place, all else replaced.

Only what both sides hold as objects, or both as arrays, is taken apart, a level at a time; every other value goes over whole.
Then the levels are put together again from below. There are as many rounds as the two sides' common structure is deep, and
documents without an update are never parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photoflow.functions import json_schema as J
from photoflow.sources.shared import drop, written

#: Levels beyond which documents aren't taken apart, as of JSON parsers.
DEPTH = 1000


def _both(a: str, b: str) -> Column:
    """object or array, where both sides are one; else null."""
    x, y = J.kind(F.col(a)), J.kind(F.col(b))
    return F.when((x == y) & x.isin("object", "array"), x)


def _children(front: DataFrame, side: str) -> DataFrame:
    """Members or elements of ``side`` with their ``step``: a key, or a place that sorts as text."""
    out = front.select("row", "path", "kind", F.col(side).alias("v")).lateralJoin(front.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return out.select("row", "path", "kind", F.when(F.col("kind") == "object", F.col("key")).otherwise(F.lpad(F.col("pos").cast("string"), 10, "0")).alias("step"), F.col("value").alias(side))


def merge_documents(base: DataFrame, updates: DataFrame, key: str = "path", text: str = "json") -> DataFrame:
    """Documents of ``base`` with ``updates`` merged in, unknown fields kept (JSN7); those of either side alone stay as they are.

    Arrays have the update's length. Merged documents are canonical JSON (keys sorted). A text that isn't JSON counts as
    none; repeated keys meet each of the other side's rows, and null keys none.
    """
    joined = base.select(key, F.col(text).alias("_a")).join(updates.select(key, F.col(text).alias("_b")), key, "full").withColumn("_row", F.monotonically_increasing_id())
    pairs = written(joined, "merge")
    a, b = F.try_parse_json("_a"), F.try_parse_json("_b")
    front = pairs.where("_a is not null and _b is not null").select(F.col("_row").alias("row"), F.array().cast("array<string>").alias("path"), a.alias("a"), b.alias("b"))
    whole = front.where(_both("a", "b").isNull())  # nothing to take apart: the update, if it is JSON
    top = written(whole.select("row", "path", F.to_json(F.coalesce("b", "a")).alias("json")), "merge")
    front = written(front.select("*", _both("a", "b").alias("kind")).where("kind is not null"), "merge")
    levels, tables = [], [pairs, top, front]
    while not front.isEmpty():
        if len(levels) == DEPTH:
            raise ValueError(f"documents are deeper than {DEPTH} levels")
        own, new = _children(front, "a"), _children(front, "b").withColumn("there", F.lit(True))
        met = own.join(new, ["row", "path", "kind", "step"], "full").where("kind = 'object' or there")
        met = written(met.select("row", F.concat("path", F.array("step")).alias("path"), "a", "b", "there", _both("a", "b").alias("both")), "merge")
        leaves = met.where("both is null").select("row", "path", F.to_json(F.when(F.col("there"), F.col("b")).otherwise(F.col("a"))).alias("json"))
        levels.append((front.select("row", "path", "kind"), leaves))
        front = met.where("both is not null").select("row", "path", "a", "b", F.col("both").alias("kind"))
        tables.append(met)
    below = None
    for containers, leaves in reversed(levels):
        parts = leaves if below is None else leaves.union(below)
        step = F.element_at("path", -1)
        named = parts.select("row", F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), F.struct(step.alias("step"), "json").alias("part"))
        parts = named.groupBy("row", "path").agg(F.sort_array(F.collect_list("part")).alias("parts"))  # a container's own members
        joined = containers.join(parts, ["row", "path"], "left").withColumn("parts", F.coalesce("parts", F.array().cast(parts.schema["parts"].dataType)))
        members = F.array_join(F.transform("parts", lambda p: F.concat(F.to_json(p["step"].cast("variant")), F.lit(":"), p["json"])), ",")
        json = F.when(F.col("kind") == "object", F.concat(F.lit("{"), members, F.lit("}"))).otherwise(F.concat(F.lit("["), F.array_join(F.transform("parts", lambda p: p["json"]), ","), F.lit("]")))
        below = written(joined.select("row", "path", json.alias("json")), "merge")
        tables.append(below)
    done = (top if below is None else top.union(below)).select(F.col("row").alias("_row"), F.col("json").alias("_m"))
    out = written(pairs.join(done, "_row", "left").select(key, F.coalesce("_m", F.when(b.isNotNull(), F.col("_b")), F.when(a.isNotNull(), F.col("_a")), "_a", "_b").alias(text)), "merged")
    for table in tables:
        drop(table)
    return out
