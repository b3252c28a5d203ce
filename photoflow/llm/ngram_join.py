"""N-gram Jaccard self-join by vertical partitioning, reduced to linked groups.

A document is a set of word n-gram hashes. The global order of n-grams puts those of the fewest documents first. It is
cut twice. For candidates, equal ranges of hashes go to one group each, which counts in how many documents each n-gram
is; two linked sets share one of their first n-grams (prefix filter), and of these only the ones of two documents or
more can meet. For overlaps, each candidate's set is cut into fragments, partial overlaps are counted as rows of
(fragment, pair), and summed per pair.

A group of N near copies isn't expanded into N * N pairs. Each bucket (the documents with one n-gram among their first)
has a leader, the member whose n-grams are the most common, and members are compared with leaders. Let ``l`` be a
reference set, taken as the leader with what most of its candidates change put right, and let a set lack ``m`` and add
``p`` grams against it: ``weight = 100 m + t p``. Two sets with ``s`` changes in common are linked if and only if
``weight1 + weight2 <= (100 - t) l + (100 + t) s``. Without common changes, whoever is linked to anyone is linked to the
lightest member; what remains shares an added gram, or passes the test with ``s`` at its most; only such pairs, and
only those of different groups so far, are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photoflow.llm.common import connected_components, discard, materialise
from photoflow.llm.hashing import P, mix, span_hashes, spans

#: Fragments of the global order in which a pair's overlap is counted.
VERIFY_FRAGMENTS = 8
#: Rows of ids or of buckets that are broadcast at most; beyond it the same joins are shuffles.
BROADCAST_IDS = 2_000_000
#: Bytes of text whose grams a task handles at a time, and grams of a group that counts them: some so many, and LEAST_GROUPS groups.
SOME_BYTES, SOME_GRAMS, LEAST_GROUPS = 4_000_000, 2_000_000, 512

_U = np.uint64
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.diff(x, prepend=~x[:1]) != 0]


def gram_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word grams of each UTF-8 text; of all its words as one if there are fewer."""
    sizes = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b"\n".join(t or b"" for t in texts), dtype=np.uint8)
    starts, ends = spans(_SPACE[data])
    h = span_hashes(_LOWER[data], starts, ends)
    doc = np.searchsorted(np.cumsum(sizes + 1), starts, side="right")
    words = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(words) - words
    with np.errstate(over="ignore"):

        def grams(at: np.ndarray, k: int) -> np.ndarray:
            g = np.full(len(at), k, dtype=np.uint64)
            for i in range(k):
                g = g * P[5] + h[at + i] * P[i % 3]
                g ^= g >> _U(31)
            return mix(g)

        whole = np.arange(max(0, len(h) - n + 1))
        whole = whole[doc[whole] == doc[whole + n - 1]]
        g = grams(whole, n)
        of = np.searchsorted(doc[whole], np.arange(len(texts) + 1))
        out = [_distinct(g[of[i] : of[i + 1]]) for i in range(len(texts))]
        for k in range(1, n):
            for i in np.flatnonzero(words == k):
                out[i] = grams(first[i : i + 1], k)
    return out


def _some(batches: Iterator[pd.DataFrame], most: int = 60_000) -> Iterator[tuple[list, list]]:
    """Ids and texts of some documents at a time."""
    ids, texts, size = [], [], 0
    for pdf in batches:
        for i, text in zip(pdf["id"], pdf["body"], strict=True):
            ids.append(i)
            texts.append(text)
            size += len(text) if text else 0
            if size >= SOME_BYTES or len(ids) >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _dealt(n: int, groups: int):
    """A row for each (batch of documents, group): the low halves of the grams of the group's range, and their documents' numbers.

    A gram is a row's entry once, with one of its documents and how many there are in the batch, so that one which all
    documents hold is an entry a batch and not one a document. One more row of a batch, without grams, has its documents'
    ids, how many grams each has, and the other documents of grams of several, in the order of groups and grams.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = TaskContext.get().partitionId() << 32
        for ids, texts in _some(batches):
            sets = gram_sets(texts, n)
            size = np.array([len(s) for s in sets])
            g = np.concatenate(sets)
            doc = np.repeat(np.arange(len(sets)), size).astype(np.uint16)
            token = ((((g >> _U(32)) * _U(groups)) >> _U(32)) << _U(32)) | (g & _U(0xFFFFFFFF))
            order = np.argsort(token, kind="stable")
            token, doc = token[order], doc[order]
            new = np.concatenate((np.ones(min(1, len(token)), bool), token[1:] != token[:-1]))
            others, count = doc[~new], np.diff(np.append(np.flatnonzero(new), len(token))).astype(np.uint16)
            token, doc = token[new], doc[new]
            group, g = token >> _U(32), token.astype(np.uint32)
            cut = np.concatenate((np.flatnonzero(np.diff(group, prepend=_U(groups))), [len(g)]))
            rows = [(batch % groups, batch, len(g), ids, size, others.tobytes(), None, None)]
            rows += [(int(group[s]), batch, 0, None, None, doc[s:e].tobytes(), g[s:e].tobytes(), count[s:e].tobytes()) for s, e in zip(cut[:-1], cut[1:], strict=True)]
            yield pd.DataFrame(rows, columns=["part", "batch", "total", "ids", "sizes", "docs", "grams", "counts"])
            batch += 1

    return run


def _counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one range of grams: what is left of each row are grams of two documents or more, and in how many each is."""
    full = pdf["grams"].notna()
    head, rest = pdf[~full].assign(dfs=None), pdf[full]
    if len(rest) == 0:
        return head
    grams = [np.frombuffer(x, np.uint32) for x in rest["grams"]]
    docs, counts = [[np.frombuffer(x, np.uint16) for x in rest[c]] for c in ("docs", "counts")]
    _, which = np.unique(np.concatenate(grams), return_inverse=True)
    count = np.minimum(np.bincount(which, weights=np.concatenate(counts)), 2**32 - 1)
    dfs = np.split(count[which].astype(np.uint32), np.cumsum([len(x) for x in grams])[:-1])
    left = lambda xs: [x[df > 1].tobytes() for x, df in zip(xs, dfs, strict=True)]
    rest = rest.assign(total=[-len(x) for x in grams], docs=left(docs), grams=left(grams), counts=left(counts), dfs=left(dfs))
    return pd.concat([head, rest]) if len(head) else rest


def _first_ones(percent: int):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one batch of documents: id, number of grams, and which of their first ones are of two documents or more."""
        if pdf["total"].sum() != 0:
            raise RuntimeError("grams of a batch are missing: the input gives other rows when it is read again")
        head, rest = pdf[pdf["ids"].notna()].iloc[0], pdf[pdf["grams"].notna()]
        size = np.asarray(head["sizes"], dtype=np.int64)
        join = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in rest[c]] or [np.empty(0, t)])
        part = np.repeat(rest["part"].to_numpy(dtype=np.int64), [len(x) // 4 for x in rest["grams"]])
        token = (part << 32) | join("grams", np.uint32).astype(np.int64)
        order = np.argsort(token)
        token, one, df, count = token[order], join("docs", np.uint16)[order], join("dfs", np.uint32)[order], join("counts", np.uint16)[order].astype(np.int64)
        # grams of several documents of the batch have the others in the batch's own row, in this order
        docs, at = np.empty(count.sum(), dtype=np.int64), np.cumsum(count) - count
        rest_of = np.ones(len(docs), dtype=bool)
        rest_of[at] = False
        docs[at], docs[rest_of] = one, np.frombuffer(head["docs"], np.uint16)
        token, df = np.repeat(token, count), np.repeat(df, count)
        order = np.lexsort((token, df, docs))
        token, docs = token[order], docs[order]
        own = np.bincount(docs, minlength=len(size))
        # a document's grams that no other has come first, and meet nothing
        first = size + 1 + (-percent * size) // 100 - (size - own)
        start = np.cumsum(own) - own
        token = token[np.arange(len(docs)) - start[docs] < first[docs]]
        count = np.clip(np.minimum(first, own), 0, None)
        return pd.DataFrame({"id": head["ids"], "size": size, "sigs": np.split(token, np.cumsum(count)[:-1])})

    return of


def _fragmented(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in _some(batches):
            rows = []
            for i, g in zip(ids, gram_sets(texts, n), strict=True):
                cut = np.searchsorted(((g >> _U(32)) * _U(VERIFY_FRAGMENTS)) >> _U(32), np.arange(1, VERIFY_FRAGMENTS, dtype=np.uint64))
                rows += [(i, f, x.view(np.int64)) for f, x in enumerate(np.split(g, cut))]
            yield pd.DataFrame(rows, columns=["id", "f", "grams"])

    return run


def _facing(pairs: DataFrame, frags: DataFrame) -> DataFrame:
    """A row for each pair(a, b) and fragment, with both sides' grams ``ga`` and ``gb``."""
    x, y = frags.select(F.col("id").alias("a"), "f", F.col("grams").alias("ga")), frags.select(F.col("id").alias("b"), "f", F.col("grams").alias("gb"))
    return pairs.join(x, "a").join(y, ["b", "f"])


def _linked(pairs: DataFrame, frags: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Which pairs(a, b) are linked, as edges: partial overlaps are counted by (fragment, pair) and summed per pair."""
    x, y = sizes.select(F.col("id").alias("a"), F.col("size").alias("size_a")), sizes.select(F.col("id").alias("b"), F.col("size").alias("size_b"))
    can = pairs.join(x, "a").join(y, "b").where(f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)")
    partial = _facing(can, frags).select("a", "b", "size_a", "size_b", F.size(F.array_intersect("ga", "gb")).alias("c"))
    overlap = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("c").alias("overlap"))
    return overlap.where(f"{100 + percent} * overlap >= {percent} * (size_a + size_b)").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """Link documents whose sets of n-word grams have ``100 * |A & B| >= percent * |A | B|``; one row per document.

    Words are runs other than ASCII white space, A-Z lower-cased. With fewer than n words the whole sequence is one
    gram. Returns ``id_col, n_grams, representative, component_id``: the least id with the same text, and the least id
    reachable over links. Null, empty and wordless texts have an empty set, no link, and are their own component. An id
    stands for one text; repeated rows give repeated rows, rows with a null id are left out. Other columns are not
    looked at. An empty table gives an empty result. ``docs`` has to give the same rows in the same order when it is
    read again, as a table does; where it doesn't, this ends with an error.
    """
    body = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body"))
    id_type = dict(body.dtypes)["id"]
    keyed = materialise(body.select("id", F.md5(F.coalesce("body", F.lit(b""))).alias("h"), F.octet_length("body").cast("long").alias("bytes")), "keyed")
    members = materialise(keyed.select("id", "h").join(keyed.groupBy("h").agg(F.min("id").alias("rep")), "h").select("id", "rep"), "members")
    total = keyed.agg(F.sum("bytes")).first()[0] or 0
    discard(keyed)
    copies = members.where("id <> rep").select("id").distinct()
    few = copies.count() <= BROADCAST_IDS  # else the texts are shuffled
    body = body.join(F.broadcast(copies), "id", "left_anti") if few else materialise(body.join(copies, "id", "left_anti"), "bodies")
    groups = max(LEAST_GROUPS, total // 6 // SOME_GRAMS)
    layout = f"part int, batch long, total int, ids array<{id_type}>, sizes array<int>, docs binary, grams binary, counts binary"
    counted = body.mapInPandas(_dealt(n, groups), layout).groupBy("part").applyInPandas(_counted, layout + ", dfs binary")
    sets = counted.groupBy("batch").applyInPandas(_first_ones(percent), f"id {id_type}, size int, sigs array<bigint>").where("size > 0")
    sets = materialise(sets.dropDuplicates(["id"]), "sets")

    sigs = sets.select(F.explode("sigs").alias("sig"), "id")
    often = sigs.groupBy("sig").agg(F.count("*").alias("c"), F.min("id").alias("x"), F.max("id").alias("y")).where("c > 1")
    often = materialise(often, "often")
    # two members are known; only where there are more are the rows looked at again, without a shuffle if these are few
    full = often.where("c > 2").select("sig", "c")
    few = full.count() <= BROADCAST_IDS
    two = often.where("c = 2").select("sig", F.explode(F.array("x", "y")).alias("id"), "c")
    hits = materialise(two.union(sigs.join(F.broadcast(full) if few else full, "sig").select("sig", "id", "c")), "hits")
    score = hits.groupBy("id").agg(F.sum("c").alias("score"))
    lead = hits.join(score, "id").groupBy("sig").agg(F.max_by("id", F.struct("score", F.xxhash64("id"))).alias("b"))
    star = materialise(hits.join(lead, "sig").where("id <> b").select(F.col("id").alias("a"), "b").distinct(), "star")

    wanted = star.select(F.col("a").alias("id")).union(star.select(F.col("b").alias("id"))).distinct()
    wanted = materialise(wanted, "wanted")
    few = wanted.count() <= BROADCAST_IDS  # else the texts are shuffled
    frags = body.join(F.broadcast(wanted) if few else wanted, "id", "left_semi").mapInPandas(_fragmented(n), f"id {id_type}, f int, grams array<bigint>")
    frags = materialise(frags.dropDuplicates(["id", "f"]), "frags")
    sizes = materialise(sets.join(wanted, "id").select("id", "size"), "sizes")

    t = percent
    first = materialise(connected_components(_linked(star, frags, sizes, t)), "first")

    # groups around a leader that still hold members of different components
    own = star.select("b").distinct().select(F.col("b").alias("a"), "b")
    comp = own.union(star).join(first.select(F.col("node").alias("a"), "component"), "a", "left").select("a", "b", F.coalesce("component", "a").alias("comp"))
    open_ = comp.groupBy("b").agg(F.count("*").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("members > 2 and lo <> hi").select("b", "members")
    open_ = materialise(open_, "open")
    none = F.array().cast("array<bigint>")
    changes = _facing(star.join(open_.select("b"), "b"), frags).select("a", "b", F.array_except("ga", "gb").alias("plus"), F.array_except("gb", "ga").alias("minus"))
    changes = changes.groupBy("a", "b").agg(F.flatten(F.collect_list("plus")).alias("plus"), F.flatten(F.collect_list("minus")).alias("minus"))
    changes = changes.union(own.select("a", "b", none.alias("plus"), none.alias("minus")))
    rows = changes.join(open_, "b").join(sizes.select(F.col("id").alias("b"), F.col("size").alias("l")), "b").join(comp, ["a", "b"])
    rows = materialise(rows, "rows")
    item = rows.select("b", "members", F.explode("plus").alias("g"), F.lit(True).alias("added")).union(rows.select("b", "members", F.explode("minus").alias("g"), F.lit(False).alias("added")))
    flips = item.groupBy("b", "g", "added", "members").agg(F.count("*").alias("c")).where("2 * c > members")
    # at most as many as the members' mean number of changes, times two, for one leader
    flips = flips.groupBy("b").agg(F.collect_list(F.when(F.col("added"), F.col("g"))).alias("fp"), F.collect_list(F.when(~F.col("added"), F.col("g"))).alias("fm"))
    centred = rows.join(flips, "b", "left").withColumns({"fp": F.coalesce("fp", none), "fm": F.coalesce("fm", none)})
    centred = centred.select(
        "a", "b", "comp", F.concat(F.array_except("plus", "fp"), F.array_except("fm", "minus")).alias("plus"),
        (F.size(F.array_except("minus", "fm")) + F.size(F.array_except("fp", "plus"))).alias("m"), (F.col("l") - F.size("fm") + F.size("fp")).alias("l"),
    )
    centred = centred.withColumns({"p": F.size("plus"), "w": 100 * F.col("m") + t * F.size("plus")})
    centred = materialise(centred, "centred")
    lightest = centred.groupBy("b").agg(F.min(F.struct("w", "a")).alias("x")).select("b", F.col("x.a").alias("dst"), F.col("x.w").alias("w2"))
    certain = centred.join(lightest, "b").where(f"a <> dst and w + w2 <= {100 - t} * l").select(F.col("a").alias("src"), "dst")
    second = connected_components(first.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(certain))
    second = materialise(second, "second")
    centred = centred.drop("comp").join(second.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("comp", F.coalesce("component", "a")).drop("component")
    still = centred.groupBy("b").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("b")
    centred = materialise(centred.join(still, "b", "left_semi"), "left")

    can = f"w + w2 <= {100 - t} * l + {100 + t} * (least(m, m2) + %s)"
    other = [F.col(c).alias(f"{c}2") for c in ("a", "m", "p", "w", "comp")]
    # (1) a common added gram
    x = centred.select("b", F.explode("plus").alias("g"), "a", "m", "p", "w", "l", "comp")
    shared = x.groupBy("b", "g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("b", "g")
    x = x.join(shared, ["b", "g"])
    y = x.select("b", "g", *other)
    by_gram = x.join(y, ["b", "g"]).where("a < a2 and comp <> comp2").where(can % "least(p, p2)").select("a", F.col("a2").alias("b")).distinct()
    # (2) common missing grams alone: first the pairs of (m, p) for which they can be enough, a few for any leader
    shape = centred.groupBy("b", "l", "m", "p", "w").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    shape2 = shape.select("b", *[F.col(c).alias(f"{c}2") for c in ("m", "p", "w", "lo", "hi")])
    fits = shape.join(shape2, "b").where(can % "0").where(f"w + w2 > {100 - t} * l and not (lo = hi and lo2 = hi2 and lo = lo2)").select("b", "m", "p", "m2", "p2")
    by_shape = centred.join(fits, ["b", "m", "p"]).select("a", "b", "comp", "m2", "p2").join(centred.select("b", *other), ["b", "m2", "p2"])
    by_shape = by_shape.where("a < a2 and comp <> comp2").select("a", F.col("a2").alias("b")).distinct()
    more = _linked(by_gram.union(by_shape).distinct(), frags, sizes, t)
    final = connected_components(second.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(more))
    final = final.select(F.col("node").alias("rep"), "component")

    # a text's copies go with it, but for texts without words
    groups = sets.select(F.col("id").alias("rep"), "size").join(final, "rep", "left").select("rep", "size", F.coalesce("component", "rep").alias("component"))
    out = materialise(members.join(groups, "rep", "left"), "members")
    for table in (members, sets, often, hits, star, wanted, frags, sizes, first, open_, rows, centred, second):
        discard(table)
    own_id = lambda c: F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col(c))
    return out.select(F.col("id").alias(id_col), F.coalesce("size", F.lit(0)).cast("long").alias("n_grams"), own_id("rep").alias("representative"), own_id("component").alias("component_id"))


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_groups(docs).select("doc_id", F.col("n_grams").alias("n_shingles"), "component_id")


_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All pairs that share a shingle, counted, and a recursion over links: for small tables.
OP10_SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM t),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.to_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY 1) m ON m.doc_id = d.doc_id
"""
