import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from photoflow.llm.piece_lattice import decode, encode, model_type, op4_sentencepiece, piece_table

ODD = [None, "", " ", "  ", "a", " a ", "the  end", "é日本\U0001f600", "line\nbreak\ttab", "x" * 300, "▁mark", "word " * 50, "Thntblere of then, edtioner"]


def as_unigram(table, path):
    """The same pieces and scores as a unigram model for the library; nothing is trained."""
    import public_tokenizers

    model = pb.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for p, r in zip(model.pieces, table, strict=True):
        p.score = r.score
    path.write_bytes(model.SerializeToString())
    return sentencepiece.SentencePieceProcessor(model_file=str(path))


@pytest.fixture(scope="module")
def table(spark):
    rows = piece_table(spark).collect()
    r = random.Random(2)  # scores almost without ties, and exact in the single precision of the library
    return spark.createDataFrame([(x.id, x.piece, -r.randrange(12 * 4096) / 4096 - 1 if x.kind == 1 else x.score, x.kind) for x in rows], "id int, piece string, score double, kind int").cache()


def test_ids_equal_the_librarys_unigram_encoder(spark, table, tmp_path, sf):
    lib = as_unigram(table.orderBy("id").collect(), tmp_path / "m.model")
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(25).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in encode(docs, table).collect()}
    score = {r.id: r.score for r in table.collect()}
    for i, t in enumerate(texts):
        want = lib.encode(t) if t else []  # ties in the sum may be broken otherwise
        assert got[i] == want or (sum(score[k] for k in got[i]) == sum(score[k] for k in want) and lib.decode(got[i]) == lib.decode(want))


def test_ids_equal_the_librarys_bpe_encoder(spark, sf):
    import public_tokenizers

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t for t in ODD if t is None or "▁" not in t] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: list(r.ids) for r in encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), piece_table(spark), algorithm=model_type()).collect()}
    assert got == {i: lib.encode(t) if t else [] for i, t in enumerate(texts)}


def test_long_words_equal_the_librarys(spark):
    import public_tokenizers

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(4)
    letters = lambda n, some="abcdefghijklmnopqrstuvwxyz": "".join(r.choice(some) for _ in range(n))
    texts = [letters(n) for n in (62, 63, 64, 65, 127, 128, 129, 5000)] + ["a" * 700, "ab" * 400, letters(600, "aeé日\U0001f600"), "日" * 150, letters(300) + " " + letters(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = piece_table(spark)
    ids = encode(docs, table, algorithm=model_type()).cache()
    assert {x.doc_id: list(x.ids) for x in ids.collect()} == {i: lib.encode(t) for i, t in enumerate(texts)}
    assert {x.doc_id: x.text for x in decode(ids, table).collect()} == dict(enumerate(texts))


def test_a_word_of_100_000_letters(spark):
    import public_tokenizers

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(5)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    assert list(encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), piece_table(spark), algorithm="bpe").first().ids) == lib.encode(text)


def test_round_trip(spark, sf):
    table = piece_table(spark)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD) if t and "▁" not in t], "doc_id long, text string")
    docs = docs.union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id >= 100").limit(20))
    back = {r.doc_id: r.text for r in decode(encode(docs, table), table).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}


def test_query_counts_what_encode_gives(spark, sf):
    got = {r.doc_id: r.n_pieces for r in op4_sentencepiece(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got == {r.doc_id: len(r.ids) for r in encode(docs, piece_table(spark), algorithm=model_type()).collect()}


def test_empty_table(spark, table):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), table).count() == 0
