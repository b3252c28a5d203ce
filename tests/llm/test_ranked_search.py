import math
import random
import re

import duckdb
import numpy as np
import pytest

from photoflow.llm.k2_treap import K2Treap, pack
from photoflow.llm.ranked_search import OP11_SQL, TOP, build_index, op11_ranked_search, search


@pytest.mark.parametrize(("n_rows", "n_cols", "points", "top"), [(1, 1, 1, 9), (1, 40, 20, 5), (50, 1, 20, 5), (40, 40, 0, 9), (60, 45, 900, 3), (500, 64, 3000, 1000), (3000, 700, 20_000, 50)])
def test_tree_finds_what_sorting_finds(n_rows, n_cols, points, top):
    r = np.random.default_rng(points)
    for k, n_terms in ((1, 1), (10, 3), (50, 20)):
        grid = np.zeros((n_rows, n_cols), np.int64)
        grid[r.integers(0, n_rows, points) ** 2 // n_rows, r.integers(0, n_cols, points)] = r.integers(1, top + 1, points)
        at = np.nonzero(grid)
        tree = K2Treap(pack(at[0], at[1], grid[at]), n_cols)
        rows = r.choice(n_rows, min(n_terms, n_rows), replace=False)
        weights = r.integers(1, 9, len(rows))
        score = weights @ grid[rows]
        want = [(int(c), int(score[c])) for c in np.lexsort((np.arange(n_cols), -score)) if score[c] > 0][:k]
        columns, scores = tree.best(rows, weights, tree.roots(rows), k)
        assert list(zip(columns.tolist(), scores.tolist(), strict=True)) == want
        if want:
            least = want[-1][1]
            columns, scores = tree.best(rows, weights, tree.roots(rows), k, least)
            assert list(zip(columns.tolist(), scores.tolist(), strict=True)) == want


def brute(docs, items, k):
    low = lambda t: re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))
    own = [(i, terms(t)) for i, t in docs]
    n, length = sum(bool(t) for _, t in own), sum(len(t) for _, t in own)
    df = {}
    for _, t in own:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for item, t in items:
        asked.setdefault(item, set()).update(x for x in terms(t) if x in df)
    out = []
    for item, words in asked.items():
        found = []
        for i, t in own:
            m = 50 + 50 * len(t) * n // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 20 * m)) for x in words)
            found += [(-s, i is not None, i)] if s > 0 else []
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def test_odd_rows(spark):
    r = random.Random(3)
    words = ["a", "B", "été", "x9", "naïve", "the", "of", "日本"]
    docs = [(k, " ".join(r.choice(words) + r.choice(["", ",", "."]) for _ in range(r.choice([0, 1, 5, 40])))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "..."), (None, "the of"), (None, "the of"), (7, "the of"), (7, "the of"), (103, "the " * 30_000 + "unique")]
    items = [(1, "The of A"), (2, None), (3, ""), (4, "nothing known"), (5, "x9! Été"), (5, "unique 日本"), (None, "B"), (6, "THE the tHe")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").repartition(3)
    q = spark.createDataFrame([(*i, 0) for i in items], "item_id int, text string, rank int")
    for per_tree in (1, 7, 4096):
        got = sorted(map(tuple, search(build_index(df, docs_per_tree=per_tree), q, k=9).collect()), key=str)
        assert got == brute(docs, items, 9)
    none = df.limit(0)
    assert search(build_index(none), q).collect() == [] and search(build_index(df), q.limit(0)).collect() == []
    names = spark.createDataFrame([("b", "the"), ("a", "the"), (None, "the")], "doc_id string, text string")
    assert [x["doc_id"] for x in search(build_index(names.union(spark.createDataFrame([("c", "of")], names.schema))), q.where("item_id = 6")).orderBy("rank").collect()] == [None, "a", "b"]


def test_items_in_blocks(spark, monkeypatch):
    from photoflow.llm import ranked_search

    monkeypatch.setattr(ranked_search, "QUERIES", 3)
    docs = [(k, f"a b{k % 5} c{k % 7}") for k in range(50)]
    items = [(k, f"b{k % 6} c{k}") for k in range(10)]
    got = search(build_index(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 5)


def test_query_is_its_sql(spark, sf01):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf01}/{t}.parquet')")
    got = op11_ranked_search(spark, sf01)
    want = con.execute(OP11_SQL).fetchall()
    assert [d[0] for d in con.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 40 * TOP
