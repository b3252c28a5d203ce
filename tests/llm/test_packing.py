import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from photoflow.llm.packing import Encoder, fillings, op9_best_fit_packing, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b", "x\n y", "x \ny", "x\n\n y", "  a", "a b", "a  b", "it's we'll\t\tgo ", "<|endoftext|> a", "é è  ñ\r\n z", "1234 56 7a8", "!!! ??\n", "日本語 テキスト", "a  b", "x" * 3000]


def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_tokenizer(spark, sf01):
    r = random.Random(1)
    texts = ODD + ["".join(r.choice([" ", "  ", "\n", "a", "the", "é", "1", ".", "'s", "\t"]) for _ in range(40)) for _ in range(500)]
    texts += [x.text for x in spark.read.parquet(f"{sf01}/documents.parquet").limit(200).collect()]
    enc = Encoder(PATH)
    assert enc.fast is not None
    want = [e.ids for e in plain().encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in map(enc.encode, texts)] == want


@pytest.mark.parametrize("seed", range(5))
def test_first_bin_is_as_full_as_brute_force(seed):
    r = random.Random(seed)
    items = [r.randint(1, 60) for _ in range(14)]
    counts = defaultdict(int)
    for n in items:
        counts[n] += 1
    plan = fillings(counts, 100)
    used = defaultdict(int)
    for lengths, bins in plan:
        assert sum(n * k for n, k in lengths) <= 100
        for n, k in lengths:
            used[n] += k * bins
    assert used == counts
    items.remove(max(items))
    best = max(sum(c) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= 100 - max(counts))
    assert sum(n * k for n, k in plan[0][0]) == max(counts) + best


def holds(rows, texts, max_len=2048):
    tok = plain()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids = [*tok.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        at = 0
        for p, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (p, at)
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            assert p == 0 or r.length == max_len
            at += r.length
        assert at == len(ids)
        assert len(own) == -(-len(ids) // max_len)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= max_len
    return len(by_seq), sum(r.length for r in rows)


def test_whole_table(spark, sf01):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    n, total = holds(op9_best_fit_packing(spark, sf01).collect(), texts)
    assert n <= -(-total // 2048) + 1


def test_odd_rows(spark):
    texts = dict(enumerate([None, *ODD, "word " * 5000, " ".join(["a"] * 2047), " ".join(["a"] * 2048)]))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, length int, salt string")
    holds(pack(df).collect(), texts)
    rows = pack(df, with_ids=True).collect()
    assert all(zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in rows)
    assert pack(df.limit(0)).count() == 0
    twice = pack(df.union(df).where("doc_id > 0"))
    assert twice.count() == 2 * pack(df.where("doc_id > 0")).count()
    assert twice.select("sequence_id", "offset").distinct().count() == twice.count()


def test_repeated_rows_are_dealt_out(spark):
    docs = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same row").alias("text"))
    out = pack(docs)
    assert out.count() == 100_000 and out.select("sequence_id", "offset").distinct().count() == 100_000
