"""Periodic runs: stretches of words that repeat themselves with a period, by recompression.

A run of period q holds a multiple of q at which its words and those q further on agree, so places are tried on the
harmonic grid (0, q, 2 q, ... for each q, n ln n in all). Longest common extensions of the grammar to both sides give a
candidate's whole extent. Documents are independent: nothing is shuffled, and a task holds some 200,000 words at a time,
or one text if it is longer.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photoflow.llm.recompression import STOP, Grammar

#: Least words of a run, which has two whole periods too.
MIN_WORDS = 12
#: Words that are looked at together, and pairs of places.
WORDS, PAIRS = 200_000, 2_000_000


def find_runs(texts: list[np.ndarray], min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of sequences of word numbers: ``(sequence, start, length, period)``, in this order, the period the least."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    base = np.cumsum(sizes + 1) - sizes  # a STOP before each and one after all
    text = np.full(int(sizes.sum()) + len(texts) + 1, STOP, dtype=np.int64)
    for at, t in zip(base, texts, strict=True):
        text[at : at + len(t)] = t
    grammar = Grammar(text)
    most = np.where(sizes >= min_words, sizes // 2, 0)
    owner = np.repeat(np.arange(len(texts)), most)  # a row for each sequence and period
    period = np.arange(len(owner)) - np.repeat(np.cumsum(most) - most, most) + 1
    points = (sizes[owner] - 1) // period
    ends = np.cumsum(points)
    found, lo = [], 0
    while lo < len(owner):
        before = ends[lo] - points[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        n = points[lo:hi]
        row = np.repeat(np.arange(lo, hi), n)
        q = period[row]
        i = base[owner[row]] + (np.arange(before, before + len(row)) - (ends - points)[row]) * q
        hit = np.flatnonzero(text[i] == text[i + q])
        i, q, row = i[hit], q[hit], row[hit]
        # half of the least run agrees, so a neighbour does
        near = np.flatnonzero((text[i + 1] == text[i + 1 + q]) | (text[i - 1] == text[i - 1 + q])) if min_words >= 4 else slice(None)
        i, q, row = i[near], q[near], row[near]
        right, left = grammar.extend(i, i + q), grammar.extend(i, i + q, -1)
        whole = np.flatnonzero((left + right >= q) & (left + right + q >= min_words))
        if len(whole):
            start = i[whole] - left[whole]
            once = whole[~pd.Series(row[whole] * len(text) + start).duplicated().to_numpy()]  # a run is met at several points
            found.append(np.stack((owner[row[once]], i[once] - left[once] - base[owner[row[once]]], (left + right + q)[once], q[once])))
        lo = hi
    if not found:
        return (np.zeros(0, np.int64),) * 4
    all_ = np.concatenate(found, axis=1)
    all_ = all_[:, np.lexsort(all_[::-1])]  # by sequence, start, length and period
    least = np.ones(all_.shape[1], dtype=bool)
    least[1:] = (all_[:3, 1:] != all_[:3, :-1]).any(axis=0)  # the multiples of a period have its extent
    doc, start, length, q = all_[:, least]
    order = np.lexsort((q, start, doc))
    return doc[order], start[order], length[order], q[order]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words if keep.all() else [words[k] for k in np.flatnonzero(keep)])


def _runs(min_words: int, rewrite: Callable[[object, list[bytes]], list[bytes]] | None):
    def rows(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        flat = pa.array([w for words in texts for w in words], pa.binary())
        numbers = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
        doc, start, length, period = find_runs(np.split(numbers, np.cumsum([len(words) for words in texts])[:-1]), min_words)
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        own = [list(zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"]))
        text = pa.array([_collapsed(w, r) for w, r in zip(texts, own, strict=True)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array([len(w) for w in texts], pa.int64()), runs, text], ["id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, n = [], [], 0
        for batch in batches:
            column = batch.column(1).cast(pa.binary())
            for k in range(batch.num_rows):
                words = (column[k].as_py() or b"").split()  # bytes split at \x20 and \x09-\x0D
                ids.append(batch.column(0).slice(k, 1))
                texts.append(rewrite(ids[-1][0].as_py(), words) if rewrite else words)
                n += len(words)
                if n >= WORDS:
                    yield rows(ids, texts)
                    ids, texts, n = [], [], 0
        if ids:
            yield rows(ids, texts)

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """A row per document: ``id_col, n_words, runs array<struct<start, length, period>>, collapsed``.

    Words are what lies between spaces and the controls 9 to 13. A run is a stretch of at least ``min_words`` words and two
    periods that neither neighbour extends; its period is the least, and runs are ordered by start, then period. In
    ``collapsed`` the words of any run but those of its first period are gone, and one space is between words.
    ``rewrite(id, words)`` may change the words of a document first. Null, empty and wordless texts have no words and no
    runs, and an empty ``collapsed``; repeated rows and null ids are rows as any; an empty table gives none. Other columns
    are not looked at.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = src.mapInArrow(_runs(min_words, rewrite), f"id {dict(src.dtypes)['id']}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's rewriting: in one document of ten, by its id's checksum, a tail becomes periodic. Without an id none."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs, rewrite=planted)
    # greatest length, then least start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Matching words of a document q apart, in stretches of consecutive places; a checksum's table-less form, bit by bit.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384::BIGINT * (s & 1)) END), 4294967295::BIGINT) AS h FROM documents),
e AS (SELECT doc_id, words, h, len(words) AS n, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a FROM d),
f AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - a) // (3 + (h // 10) % 8) END AS p FROM e),
w AS (SELECT doc_id, i, words[1 + CASE WHEN p IS NOT NULL AND i >= a THEN a + (i - a) % p ELSE i END] AS word, n FROM f, unnest(range(n)) AS t(i)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS k
    FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
r AS (SELECT doc_id, start, length, min(q) AS period FROM
    (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM m GROUP BY doc_id, q, k HAVING count(*) >= q AND count(*) + q >= 12) GROUP BY 1, 2, 3),
s AS (SELECT doc_id, count(*) AS n_runs, arg_max({'s': start, 'l': length, 'p': period}, (length, -start, -period)) AS b,
    sha256(string_agg(start::VARCHAR || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs FROM r GROUP BY 1),
c AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS kept FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.p::BIGINT AS period, (1000 * b.l // b.p)::BIGINT AS exponent_milli,
    coalesce(s.runs, sha256('')) AS runs_sha256, coalesce(c.kept, sha256('')) AS collapsed_sha256
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)
"""
