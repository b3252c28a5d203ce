"""Best-fit packing of tokenised documents into sequences by minimum bin slack.

What is planned is the histogram of piece lengths, ``max_len`` counts at most however large the corpus is. A bin takes the
longest piece left, and a bitset subset-sum over the lengths still available finds the fullest filling of the rest; this
filling is repeated while the counts allow, so that there are about as many fillings as lengths. Pieces are numbered
within their length in salted blocks, and a piece's number gives its sequence and its place by arithmetic.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photoflow.llm.common import materialise

MAX_LEN = 2048
#: Pieces of one length that are numbered together.
BLOCK = 5_000


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to ``Tokenizer.encode(add_special_tokens=False)``.

    Where the file at ``path`` is a byte-level BPE whose ids are in the order of its merges, the same vocabulary goes to
    ``tiktoken`` as ranks, which takes a third of the time. Texts that hold an added token's string, and everything with
    another kind of tokenizer, are encoded by ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [a["content"] for a in spec.get("added_tokens", [])]
        self.fast = self._ranked(spec)

    def _ranked(self, spec: dict):
        import tiktoken
        from public_tokenizers import PATTERN

        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space", True) or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("type", "BPE") != "BPE":
            return None
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.added}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged) or len(vocab) != 256 + len(merged):
            return None
        # the usual byte alphabet: printable bytes stand for themselves, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(letter[c] for c in token): i for token, i in vocab.items()}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(a in text for a in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(path: str, max_len: int, end_id: int, with_ids: bool):
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, tag = encoder(path), 0
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                ids = enc.encode(text or "") + end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    to = (n % max_len or max_len) if at == 0 else at + max_len
                    part = ids[4 * at : 4 * to]
                    rows.append((i, piece, at, to - at, zlib.crc32(part), tag, *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else [])))
                    at, piece, tag = to, piece + 1, (tag + 1) % 2**31
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", "tag", *["ids"] * with_ids])

    return run


def fillings(counts: dict[int, int], max_len: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Minimum bin slack over a histogram: ``([(length, times), ...], bins)`` in order; each count is used up exactly."""
    left = {n: c for n, c in counts.items() if c}
    order = sorted(left, reverse=True)
    out = []
    while left:
        order = [n for n in order if n in left]
        seed = order[0]
        room = max_len - seed
        left[seed] -= 1
        reach, seen, goal = 1, [], 1 << room
        mask = (goal << 1) - 1
        for n in order:
            times = min(left[n], room // n)
            if times and not reach & goal:
                seen.append((n, times, reach))
                step = 1
                while times:  # a bounded number of copies, by doubling
                    k = min(step, times)
                    reach |= (reach << (n * k)) & mask
                    times -= k
                    step *= 2
            elif reach & goal:
                break
        left[seed] += 1
        full = reach.bit_length() - 1
        used = {seed: 1}
        for n, _times, before in reversed(seen):
            k = 0
            while not before >> full & 1:
                full -= n
                k += 1
            if k:
                used[n] = used.get(n, 0) + k
        bins = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= bins * k
            if not left[n]:
                del left[n]
        out.append((sorted(used.items(), reverse=True), bins))
    return out


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack every document's ids, followed by ``end_id``, into sequences of at most ``max_len`` ids; one row per piece.

    Only documents longer than ``max_len`` are cut, into pieces of that length, the first of which may be shorter.
    Returns ``id_col, piece, start, length, ids_crc32, sequence_id, offset`` and, ``with_ids``, the ids. A null text is an
    empty one, and yields ``end_id`` alone. Repeated rows are packed as often as they occur; ids may be null. An empty
    table gives no rows. Other columns are not looked at. Sequences are numbered from 0 without gaps.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(src.dtypes)['id']}, piece int, start long, length long, ids_crc32 long, tag int" + ", ids array<int>" * with_ids
    pieces = materialise(src.mapInPandas(_pieces(path, max_len, end_id, with_ids), schema), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # max_len rows at most
    runs, used, first = [], dict.fromkeys(counts, 0), 0
    for lengths, bins in fillings(counts, max_len):
        place = 0
        for n, k in lengths:
            runs.append((n, used[n], used[n] + k * bins, first, k, place))
            used[n] += k * bins
            place += k * n
        first += bins
    plan = spark.createDataFrame(runs, "length long, lo long, hi long, first long, times long, place long")
    blocks = spark.createDataFrame([(n, -(-c // BLOCK)) for n, c in counts.items()], "length long, blocks long")
    # both are bounded by max_len, not by the corpus
    # a task's running number deals out repeated rows
    salted = pieces.join(F.broadcast(blocks), "length").withColumn("salt", F.expr("pmod(xxhash64(id, piece, ids_crc32, tag), blocks)"))
    size = salted.groupBy("length", "salt").count()
    before = size.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32", "tag")
    number = salted.withColumn("own", F.row_number().over(own)).join(before, ["length", "salt"]).withColumn("rank", F.col("own") - 1 + F.col("before"))
    out = number.join(F.broadcast(plan), "length").where("rank >= lo and rank < hi")
    return out.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.expr("first + (rank - lo) div times").alias("sequence_id"),
        F.expr("place + (rank - lo) % times * length").alias("offset"), *(["ids"] if with_ids else []),
    )


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
