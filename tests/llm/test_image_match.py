import numpy as np

from photoflow.llm.image_match import edited, op7_image_match, rendered, search

SCHEMA = "id long, height int, width int, pixels binary"


def test_edited_copies_find_their_source(spark, sf01):
    rows = op7_image_match(spark, sf01).collect()
    vectors = spark.read.parquet(f"{sf01}/embeddings.parquet").collect()
    assert {r.id for r in rows} == {v.vec_id for v in vectors if v.vec_id % 20 == 0}
    same = {}
    for v in sorted(vectors, key=lambda v: v.vec_id):
        same.setdefault(tuple(v.embedding), v.vec_id)
    source = {v.vec_id: same[tuple(v.embedding)] for v in vectors}
    hit = [r.best_class == source[r.id] for r in rows]
    assert sum(hit) >= 0.9 * len(hit)
    assert np.mean([r.n_matches for r in rows]) < 3


def test_odd_images(spark):
    r = np.random.default_rng(1)
    good = np.kron(r.integers(0, 256, (16, 16)), np.ones((4, 4))).astype(np.uint8)
    other = np.kron(r.integers(0, 256, (16, 16)), np.ones((4, 4))).astype(np.uint8)
    flat = np.full((64, 64), 7, np.uint8)
    rows = [(1, 64, 64, good.tobytes()), (2, 64, 64, good.tobytes()), (3, 64, 64, other.tobytes()), (4, 64, 64, flat.tobytes()), (5, 3, 3, bytes(9)), (6, 64, 64, b"short"), (7, None, None, None), (8, 0, 0, b"")]
    df = spark.createDataFrame([(i, h, w, None if p is None else bytearray(p)) for i, h, w, p in rows], SCHEMA)
    turned = spark.createDataFrame([(40, 64, 64, bytearray(np.ascontiguousarray(np.rot90(good)).tobytes())), (41, 48, 48, bytearray(np.ascontiguousarray(good[8:56, 8:56]).tobytes())), (7, None, None, None)], SCHEMA)
    got = {x.id: x for x in search(turned, df).collect()}
    assert got[40].best_class == 1 and got[40].n_matches == 1 and got[41].best_class == 1
    assert got[7].n_matches == 0 and got[7].best_class is None
    assert search(turned.limit(0), df).count() == 0 and search(turned, df.limit(0)).where("n_matches > 0").count() == 0
    assert rendered(spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")).where("pixels is null").count() == 2
    assert edited(df.where("id in (1, 7)")).count() == 2
