"""Ranked lexical search: each task turns its documents into K2-treaps of impacts, and queries descend all of them.

Two passes over the corpus: one counts documents and terms, the other builds a tree for each few thousand documents,
without a shuffle. A search reads the trees' vocabularies for how many documents hold its terms, then the trees; a task
keeps the best documents of each query over all its trees, and what they score bounds the next tree's descent.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photoflow.llm.common import materialise, used
from photoflow.llm.hashing import span_hashes, spans
from photoflow.llm.k2_treap import K2Treap, pack

#: Documents of a tree, and bytes of their texts from which it gets no more.
DOCS, BYTES = 4096, 12_000_000
#: Queries that are searched together, and bytes of their texts: they are what tasks are sent.
QUERIES, QUERY_BYTES = 1000, 4_000_000
TOP = 50

#: By byte of UTF-8, the byte in lower case where it is of a term (A-Z, a-z, 0-9 and all beyond ASCII), else 0.
_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], dtype=np.uint8)
_TERM = re.compile(rb"[0-9a-z\x80-\xFF]+")


def _spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes in lower case, where terms start and end, and whose they are."""
    low = _BYTES[np.frombuffer(b"\0".join(texts), dtype=np.uint8)]
    starts, ends = spans(low == 0)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    return low, starts, ends, np.searchsorted(np.cumsum(sizes), starts, side="right")


def _groups(batches: Iterator[pa.RecordBatch], docs: int, size: int) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and texts of a tree's documents."""
    ids, texts, n = [], [], 0
    for batch in batches:
        column = batch.column(1).cast(pa.binary())
        for k in range(batch.num_rows):
            ids.append(batch.column(0).slice(k, 1))
            texts.append(column[k].as_py() or b"")
            n += len(texts[-1])
            if len(ids) >= docs or n >= size:
                yield pa.concat_arrays(ids), texts
                ids, texts, n = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), texts


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n_docs = n_terms = 0
    for _ids, texts in _groups(batches, DOCS, BYTES):
        _low, starts, _ends, doc = _spans(texts)
        n_docs, n_terms = n_docs + len(np.unique(doc)), n_terms + len(starts)
    yield pa.RecordBatch.from_pydict({"docs": [n_docs], "terms": [n_terms]})


def _order(ids: list) -> list[int]:
    return sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k]))


def _trees(n_docs: int, n_terms: int, docs: int):
    """A row for each tree: documents in ascending order of id as columns, terms as rows, those of most documents first."""

    def tree(ids: pa.Array, texts: list[bytes]) -> dict:
        order = _order(ids.to_pylist())
        texts = [texts[k] for k in order]
        low, starts, ends, doc = _spans(texts)
        term, hashes = pd.factorize(span_hashes(low, starts, ends))
        at = np.zeros(len(hashes), np.int64)
        at[term[::-1]] = np.arange(len(term))[::-1]
        pair, keys = pd.factorize(term * len(texts) + doc)
        tf, term, doc = np.bincount(pair, minlength=len(keys)), keys // len(texts), keys % len(texts)
        df = np.bincount(term, minlength=len(hashes))
        by_df = np.lexsort((hashes, -df))
        row = np.empty(len(by_df), np.int64)
        row[by_df] = np.arange(len(by_df))
        m = np.array([50 + 50 * n * n_docs // max(n_terms, 1) for n in np.bincount(doc, tf, minlength=len(texts)).astype(np.int64).tolist()], dtype=np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
        some = impact > 0
        text = low.tobytes()
        words = b"\n".join(text[a:b] for a, b in zip(starts[at[by_df]].tolist(), ends[at[by_df]].tolist(), strict=True))
        return {"ids": ids.take(pa.array(order)), "terms": words, "dfs": df[by_df], **pack(row[term][some], doc[some], impact[some])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _groups(batches, docs, BYTES):
            t = tree(ids, texts)
            one = lambda x, kind: pa.array([x], kind)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), t["ids"]), one(t["terms"].decode(), pa.string()), one(t["dfs"].tolist(), pa.list_(pa.int32())), one(t["side"], pa.int32()), one(t["levels"], pa.list_(pa.int32()))]
                + [one(t[c], pa.binary()) for c in ("kids", "lacks", "rows", "cols")],
                ["ids", "terms", "dfs", "side", "levels", "kids", "lacks", "rows", "cols"],
            )

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs_per_tree: int = DOCS) -> DataFrame:
    """The index of all documents, a table in the shared folder: a row for each tree.

    Terms are stretches of letters and digits of ASCII, A-Z lower-cased, and of all characters beyond it. An impact is
    ``10**9 tf div (1000 tf + 20 m)`` with ``m = 50 + 50 n N div L`` (n the document's terms, N the documents with terms,
    L all terms). Null, empty and termless texts are documents without points; ids may repeat or be null.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = src.mapInArrow(_counts, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    n_docs, n_terms = total["docs"] or 0, total["terms"] or 0
    schema = f"ids array<{dict(src.dtypes)['id']}>, terms string, dfs array<int>, side int, levels array<int>, kids binary, lacks binary, rows binary, cols binary"
    index = materialise(src.mapInArrow(_trees(n_docs, n_terms, docs_per_tree), schema), "trees")
    index._photoflow_docs = n_docs
    return index


def _document_counts(queries: dict):
    """How many documents of a task's trees hold each term of the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = dict.fromkeys((t for terms in queries.values() for t in terms), 0)
        for batch in batches:
            for terms, dfs in zip(batch.column(0), batch.column(1), strict=True):
                for t, n in zip(terms.as_py().encode().split(b"\n"), dfs.values.to_numpy(), strict=False):
                    if t in wanted:
                        wanted[t] += int(n)
        found = {t: n for t, n in wanted.items() if n}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["term", "df"])

    return run


def _descend(queries: dict, k: int, item_type: pa.DataType, id_type: pa.DataType):
    """The best documents of each query over all trees of a task; ``queries``: item to {term: weight}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[object, list[tuple]] = {item: [] for item in queries}
        for batch in batches:
            for t in batch.to_pylist():
                ids = t["ids"]
                row = {term: n for n, term in enumerate(t["terms"].encode().split(b"\n"))}
                tree = K2Treap(t, len(ids))
                for item, terms in queries.items():
                    own = [(row[x], w) for x, w in terms.items() if x in row]
                    if not own:
                        continue
                    rows, weights = (np.array(x, dtype=np.int64) for x in zip(*own, strict=True))
                    have = best[item]
                    columns, scores = tree.best(rows, weights, tree.roots(rows), k, -have[-1][0] if len(have) == k else 1)
                    if len(columns):
                        have += [(-s, ids[c] is not None, ids[c]) for c, s in zip(columns.tolist(), scores.tolist(), strict=True)]
                        have.sort()
                        del have[k:]
        flat = [(item, i, -s) for item, have in best.items() for s, _, i in have]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], item_type), pa.array([x[1] for x in flat], id_type), pa.array([x[2] for x in flat], pa.int64())], ["item_id", "doc_id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = TOP, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``item_col, rank, id_col, score``: each item's ``k`` documents of the highest scores above 0, equal scores by ascending id, null first.

    A term weighs ``floor(1000 ln((2 N + 2) / (2 df + 1)))``; a score sums weights times impacts over an item's terms, once
    each. Rows of one item id are one item with the terms of all; items without a known term, empty or null ones, have no
    rows. Repeated documents are ranked each. Items go to the tasks in blocks of some QUERIES, or less if they are long.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    src = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    size = src.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    blocks = 1 + max(size["n"] // QUERIES, (size["b"] or 0) // QUERY_BYTES)
    n_docs, found = index._photoflow_docs, None
    item_type, id_type = to_arrow_type(src.schema["item_id"].dataType), to_arrow_type(index.schema["ids"].dataType.elementType)
    kinds = f"item_id {dict(src.dtypes)['item_id']}, doc_id {index.schema['ids'].dataType.elementType.simpleString()}, score long"
    for block in range(blocks):
        queries: dict = {}
        for item, text in src.where(F.expr(f"pmod(xxhash64(item_id), {blocks}) = {block}")).collect():  # some QUERIES rows
            queries.setdefault(item, {}).update(dict.fromkeys(_TERM.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))))
        counts = index.select("terms", "dfs").mapInArrow(_document_counts(queries), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
        df = {bytes(r["term"]): r["df"] for r in counts.collect()}  # the block's terms
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        queries = {item: {t: weight[t] for t in terms if weight.get(t, 0) > 0} for item, terms in queries.items()}
        got = index.mapInArrow(_descend(queries, k, item_type, id_type), kinds)
        found = got if found is None else found.union(got)
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    some = found.withColumn("salt", F.spark_partition_id() % 64)  # so that an item's rows of all tasks don't meet at once
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return used(out.select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score"), index)


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search(build_index(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY 1, 2),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY 1),
g AS (SELECT count(*)::BIGINT AS N, sum(n)::BIGINT AS L FROM d),
m AS (SELECT doc_id, 50 + (50 * d.n * g.N) // g.L AS m FROM d, g),
w AS (SELECT term, floor(1000 * ln((2 * g.N + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, g.N),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= {TOP}
"""
