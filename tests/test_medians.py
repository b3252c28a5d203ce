"""Upper medians by radix selection are those of sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from photoflow.operators import reports as A


def plain(rows):
    out = {}
    for *key, x, y in rows:
        for k, v in enumerate((x, y)):
            own = out.setdefault(tuple(key), ([], []))
            if v is not None:
                own[k].append(v)
    return {k: tuple(sorted(v)[len(v) // 2] if v else None for v in both) for k, both in out.items()}


@pytest.mark.parametrize(("bits", "top", "few"), [(6, 50, 0), (16, 1, 100), (16, 2**63 - 1, 100)])
def test_medians(spark, monkeypatch, bits, top, few):
    r = random.Random(top)
    value = lambda: None if r.random() < 0.1 else r.randint(-top - 1 if top != 50 else 0, top)
    rows = [(r.choice([None, "a", "b", "c"]), r.choice([None, 1, 2]), value(), value()) for _ in range(900)]
    rows += [("one", 1, 5, None), ("none", 1, None, None), ("ends", 1, -(2**63), 2**63 - 1), ("ends", 1, 2**63 - 1, -(2**63)), *[("same", 1, -7, 7)] * 4]
    df = spark.createDataFrame(rows, "g string, _c int, n long, rank long")  # names that the passes use too
    monkeypatch.setattr(A, "BROADCAST_GROUPS", few)
    got = {(x.g, x["_c"]): (x.a, x.b) for x in A.upper_medians(df, ["g", "_c"], {"a": "n", "b": "rank"}, bits).collect()}
    assert got == plain(rows)


def test_no_rows(spark):
    none = spark.createDataFrame([], "g string, v int")
    assert A.upper_medians(none, ["g"], {"m": "v"}).collect() == []
    assert [tuple(x) for x in A.upper_medians(spark.createDataFrame([("a", None)], none.schema), ["g"], {"m": "v"}).collect()] == [("a", None)]


def test_a_group_of_ten_million_values(spark):
    df = spark.range(10_000_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 10_000_019).alias("v"))
    want = int(np.partition(np.arange(10_000_000) * 7919 % 10_000_019, 5_000_000)[5_000_000])
    assert A.upper_medians(df, ["g"], {"m": "v"}).first().m == want
