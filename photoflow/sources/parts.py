"""One JSON document per key that may be larger than any row or task: ordered parts, whose texts in order are the document.

A document is a header's fields and one array. The array's elements are dealt out by ranges of (key, order), so each task
writes a stretch of them in order, a line each; header and end are written beside them, a row for each key. No document is
ever gathered. In ``path``, ``cat header/k=v/part* items/k=v/part* end/k=v/part*`` is the document of key v.
"""

from __future__ import annotations

import glob
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photoflow.sources.shared import drop, written

SECTIONS = ["header", "items", "end"]
_NULLS = {"ignoreNullFields": "false"}


def write_parts(headers: DataFrame, items: DataFrame, path: str, key: str, order: list[str], field: str, item: Column) -> None:
    """Write a document for each row of ``headers`` (one for each ``key``): its columns by name, and the array ``field``.

    ``item`` is an expression over ``items``, written as JSON; items are in ``order``, nulls first, equal ones by their
    text. Items whose key is null or has no header belong to no document and are left out; a header without items has an
    empty array. ``path`` is a folder that doesn't exist yet.
    """
    some = written(headers.where(F.col(key).isNotNull()), "headers")
    own = items.where(F.col(key).isNotNull()).select(key, F.struct(*order).alias("_order"), F.to_json(item, _NULLS).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    own = written(own.join(some.select(key), key, "left_semi"), "items")
    first = own.groupBy(key).agg(F.min(F.struct("_order", "_text", "_row")).alias("_first"))  # combined before the shuffle
    head = F.to_json(F.struct(*sorted(headers.columns)), _NULLS)
    some.select(key, F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(f",{json.dumps(field)}:[")).alias("value")).write.partitionBy(key).text(f"{path}/header")
    some.select(key, F.lit("]}").alias("value")).write.partitionBy(key).text(f"{path}/end")
    sorted_ = own.join(first.select(key, F.col("_first._row").alias("_first")), key).repartitionByRange(key, "_order", "_text", "_row").sortWithinPartitions(key, "_order", "_text", "_row")
    sorted_.select(key, F.concat(F.when(F.col("_row") == F.col("_first"), "").otherwise(","), "_text").alias("value")).write.partitionBy(key).text(f"{path}/items")
    drop(some)
    drop(own)


def read_headers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The documents' headers, a row each."""
    text = spark.read.schema("value string").text(f"{path}/header/*")
    return text.select(F.from_json(F.concat(F.regexp_replace("value", r',"(?:[^"\\]|\\.)*":\[$', ""), F.lit("}")), schema).alias("h")).select("h.*")


def read_items(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The documents' elements, a row each: ``key`` (as text) and ``item``."""
    text = spark.read.schema(f"value string, {key} string").option("basePath", f"{path}/items").text(f"{path}/items")
    return text.select(key, F.from_json(F.regexp_replace("value", "^,", ""), schema).alias("item"))


def document_text(path: str, folder: str) -> Iterator[str]:
    """The text of one document, ``folder`` being ``key=value``, from mounted files, line by line."""
    for section in SECTIONS:
        for file in sorted(glob.glob(f"{glob.escape(f'{path}/{section}/{folder}')}/part-*")):
            with open(file, encoding="utf-8") as f:
                yield from f
