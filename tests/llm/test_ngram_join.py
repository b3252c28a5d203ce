import random

import pytest

from photoflow.llm.ngram_join import jaccard_groups


def brute(rows, n, percent):
    sets = {}
    for i, text in rows:
        w = text.encode().lower().split() if text else []
        sets[i] = {tuple(w[k : k + min(n, len(w))]) for k in range(len(w) - min(n, len(w)) + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(seed, bases=6, per=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 6)))
    texts = [None, "", " \n\t", "one", "ONE", "two words", "Two words", "x" * 50_000, "a b c"]
    for _ in range(bases):
        base = [word() for _ in range(r.choice([9, 14, 30, 70, 150, 400]))]
        texts.append(" ".join(base))
        pool = [base]
        for _ in range(per):
            t = list(r.choice(pool))
            for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9])):
                k = r.randrange(len(t))
                what = r.random()
                if what < 0.5:
                    t[k] = word()
                elif what < 0.75 and len(t) > 4:
                    del t[k]
                elif what < 0.85:
                    t = t[: max(3, len(t) - r.randint(1, 8))]
                else:
                    t.insert(k, word())
            if r.random() < 0.3:
                pool.append(t)
            texts.append((" " if r.random() < 0.8 else "\n ").join(t))
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 3, 90), (2, 5, 80), (3, 3, 90)])
def test_same_groups_as_brute_force(spark, seed, n, percent):
    rows = copies(seed)
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), n=n, percent=percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_grams, r.component_id) for r in got} == brute(rows, n, percent)


def test_base_absent_and_many_near_copies(spark):
    r = random.Random(7)
    base = [f"w{r.randrange(10_000)}" for _ in range(120)]
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(r.choice([1, 2, 2, 3])):
            t[r.randrange(len(t))] = f"v{r.randrange(40)}"
        rows.append((i, " ".join(t)))
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_grams, x.component_id) for x in got} == brute(rows, 3, 90)


def test_real_documents(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = jaccard_groups(docs).collect()
    assert {r.doc_id: (r.n_grams, r.component_id) for r in got} == brute(rows, 3, 90)


def test_empty_table_repeats_and_clashing_columns(spark):
    assert jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c d", 5, "x"), (1, "a b c d", 5, "x"), (2, "A b\nc d", 6, "y")], "doc_id long, text string, sig int, fp string")
    assert sorted((r.doc_id, r.n_grams, r.component_id) for r in jaccard_groups(df).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_a_gram_of_all_documents_is_an_entry_a_batch():
    import numpy as np
    import pandas as pd

    from photoflow.llm.ngram_join import _counted, _dealt, _first_ones

    texts = [f"the same words {k} own end" for k in range(3000)]

    class Context:
        @staticmethod
        def get():
            return Context

        partitionId = staticmethod(lambda: 0)  # noqa: N815

    import photoflow.llm.ngram_join as J

    before, J.TaskContext = J.TaskContext, Context
    try:
        dealt = pd.concat(_dealt(3, 64)(iter([pd.DataFrame({"id": range(3000), "body": [t.encode() for t in texts]})])))
    finally:
        J.TaskContext = before
    entries = np.concatenate([np.frombuffer(x, np.uint32) for x in dealt["grams"] if x is not None])
    assert len(entries) == 1 + 3 * 3000  # "the same words" once
    counted = pd.concat([_counted(x) for _, x in dealt.groupby("part")])
    out = pd.concat([_first_ones(90)(x) for _, x in counted.groupby("batch")])
    assert sorted(out["id"]) == list(range(3000)) and set(out["size"]) == {4}
