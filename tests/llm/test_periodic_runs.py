import hashlib
import random

import duckdb
import numpy as np
import pytest

from photoflow.llm.periodic_runs import OP13_SQL, find_runs, op13_periodic_runs, periodic_runs, planted
from photoflow.llm.recompression import STOP, Grammar


def brute(words, least=12):
    """Runs by their definition: for each period the maximal stretches that agree with themselves; the least period wins."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start >= q and i - start + q >= least:
                best.setdefault((start, i - start + q), q)
    return sorted((s, n, q) for (s, n), q in best.items())


def sequences(seed):
    r = random.Random(seed)
    out = [[], [0], [0] * 11, [0] * 12, [0] * 300, [0, 1] * 6, [0, 1] * 40 + [0], [*range(12)] * 2]
    for _ in range(60):
        n, letters = r.choice([5, 20, 60, 200]), r.choice([1, 2, 3, 10])
        t = [r.randrange(letters) for _ in range(n)]
        for _ in range(r.randrange(3)):
            a, p = r.randrange(n), r.randint(1, 12)
            t[a:a] = (t[a : a + p] or [0]) * r.randint(2, 9)
        out.append(t)
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    return [*out, b]


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_those_of_the_definition(seed):
    texts = sequences(seed)
    doc, start, length, period = find_runs([np.array(t, dtype=np.int64) for t in texts])
    for k, t in enumerate(texts):
        own = doc == k
        assert list(zip(start[own].tolist(), length[own].tolist(), period[own].tolist(), strict=True)) == brute(t), t


@pytest.mark.parametrize("seed", range(3))
def test_extensions(seed):
    r = random.Random(seed)
    text = [STOP]
    for t in sequences(seed):
        text += [*t, STOP]
    g = Grammar(np.array(text))
    places = [k for k, s in enumerate(text) if s != STOP]
    a = np.array([r.choice(places) for _ in range(3000)])
    stop = np.array([next(j for j in range(k, len(text)) if text[j] == STOP) for k in a])
    b = np.array([r.randrange(x, y) if x < y else x for x, y in zip(a, stop, strict=True)])
    a, b = a[a < b], b[a < b]
    for step in (1, -1):
        for x, y, n in zip(a.tolist(), b.tolist(), g.extend(a, b, step).tolist(), strict=True):
            at, want = (0 if step > 0 else -1), 0
            while text[x + at + step * want] == text[y + at + step * want] != STOP:
                want += 1
            assert n == want


def test_levels_are_few_and_shrink():
    g = Grammar(np.concatenate(([STOP], np.random.default_rng(1).integers(0, 500, 50_000), [STOP])))
    assert len(g.levels) < 120 and sum(len(x[0]) for x in g.levels) < 6 * 50_000


def test_odd_rows(spark):
    same = " ".join(["w"] * 30)
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "one", "x"), (5, same, "x"), (5, same, "x"), (None, same, "x"), (6, "á b " * 20, "x"), (7, "a " + "b c d " * 40_000 + "e", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")  # a column of the result's name
    got = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(df).collect())
    assert got == [
        (0, 30, [(0, 30, 1)], "w"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 1, [], "one"), (5, 30, [(0, 30, 1)], "w"), (5, 30, [(0, 30, 1)], "w"),
        (6, 20, [(0, 20, 1)], "á b"), (7, 120_002, [(1, 120_000, 3)], "a b c d e"),
    ]
    assert periodic_runs(df.limit(0)).collect() == []


def test_query_is_the_plain_one(spark, sf):
    want = {}
    for doc_id, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        words = planted(doc_id, (text or "").encode().split())
        runs = brute(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        n, s, q = min(((-n, s, q) for s, n, q in runs), default=(0, None, None))
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want[doc_id] = (len(runs), s, -n or None, q, 1000 * -n // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))
    got = {r[0]: tuple(r[1:]) for r in op13_periodic_runs(spark, sf).collect()}
    assert got == want and any(v[0] > 1 for v in want.values())


def test_query_is_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    got = op13_periodic_runs(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(OP13_SQL).fetchall())
    assert [d[0] for d in con.description] == got.columns
