import random
import zlib

from photoflow.llm.toxicity import fit, op2_toxicity, scored, train

DOCS, LABELS = "doc_id long, text string, score string, label int", "doc_id long, toxic int"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op2_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p for y, p in held if y) >= 0.8 * sum(y for y, _ in held)
    assert sum(p for y, p in held if not y) <= 0.03 * sum(1 - y for y, _ in held)


def test_risk_learns_from_positives_and_unlabelled_only():
    r = random.Random(3)
    text = lambda bad: [*{f"w{r.randrange(200)}" for _ in range(30)}, *([r.choice(["vile", "foul", "rank"])] if bad else [])]
    model = train([text(True) for _ in range(200)], [text(r.random() < 0.1) for _ in range(2000)], 0.1)
    assert set(model.weights) >= {"vile", "foul", "rank"}
    assert model.score("w1 w2 vile") > 0.3 > model.score("w1 w2 w3")


def test_held_out_labels_and_other_columns_are_no_inputs(spark):
    rows = [(i, f"some plain words {'awful' if i % 9 == 0 else 'fine'} here", "s", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = [(i, int(i % 9 == 0)) for i in range(300)]
    wrong = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a, b = fit(docs, spark.createDataFrame(labels, LABELS)), fit(docs, spark.createDataFrame(wrong, LABELS))
    assert a.weights == b.weights and a.bias == b.bias and "awful" in a.weights


def test_odd_rows(spark):
    texts = [None, "", "\n", "a" * 100_000, "BAD word", "bad word"]
    docs = spark.createDataFrame([(i, t, "old", 0) for i, t in enumerate(texts)] * 2, DOCS)
    for labels in ([], [(4, 1), (5, 0), (5, None), (None, 1)]):
        got = scored(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
        by = {r.doc_id: r.score for r in got}
        assert by[0] == by[1] == by[2] and by[4] == by[5]
    assert scored(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def test_repeated_rows_of_one_id_count_once(spark, monkeypatch):
    from photoflow.llm import toxicity

    seen = {}
    monkeypatch.setattr(toxicity, "train", lambda pos, unl, prior, **o: seen.update(pos=len(pos), unl=len(unl)) or train(pos, unl, prior, **o))
    docs = spark.createDataFrame([(4, f"bad words {k % 7}", "s", 0) for k in range(5_000)] + [(k, "fine words", "s", 0) for k in range(100, 140)], DOCS)
    fit(docs, spark.createDataFrame([(4, 1)] * 50, LABELS))
    assert seen == {"pos": 1, "unl": 1 + sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(100, 140))}
