"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut into units where no piece of the vocabulary can lie across, and each distinct unit is encoded once: its
substrings of bounded length are exploded and joined with the piece table by equality, the edges are grouped by unit, and
folded by a higher-order aggregate: for a unigram model in Viterbi's order of places, for a BPE model, whose ids aren't
those of a best path, in the order of the merges. The piece table is a vocabulary of fixed size and broadcast.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photoflow.llm.common import discard, materialise

MARK = "▁"
#: Units that are joined by broadcast at most, the most frequent ones, of FREQUENT_LENGTH characters at most; the rest go by shuffle.
FREQUENT, FREQUENT_LENGTH = 400_000, 64
#: Starts that are looked at together in a long unit, and characters of a unit whose parts are folded as an array.
WINDOW, SHORT = 128, 64
#: What an edge of a character without a piece costs beyond the least score.
UNKNOWN_PENALTY = 10.0
#: Kinds of characters: letters, digits, spaces and their marks, others.
KINDS = {"L": r"\p{L}\p{M}", "N": r"\p{N}", "S": f" {MARK}", "O": rf"^\p{{L}}\p{{M}}\p{{N}} {MARK}"}


def piece_table(spark, path: str | None = None) -> DataFrame:
    """``id, piece, score, kind`` (1 normal, 2 unknown, 3 control, 6 byte) of a SentencePiece model file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rows = [(i, p.piece, float(p.score), int(p.type)) for i, p in enumerate(model.pieces)]
    return spark.createDataFrame(rows, "id int, piece string, score double, kind int")


def model_type(path: str | None = None) -> str:
    """``unigram`` or ``bpe``, as a model file says."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return {1: "unigram", 2: "bpe"}[model.trainer_spec.model_type]


def _kind(c: str) -> str:
    return "S" if c in (" ", MARK) else {"L": "L", "M": "L", "N": "N"}.get(unicodedata.category(c)[0], "O")


def unit_pattern(pieces: list[str]) -> str:
    """What units of a text look like, as a regular expression: runs within which pieces have such kinds of neighbours.

    Between two characters whose kinds no piece has in this order, every way to cut the text has a cut. If kinds can
    follow each other in turn, units are words, or whole texts where a piece has a mark within.
    """
    after = {k: {_kind(b) for p in pieces for a, b in zip(p, p[1:], strict=False) if _kind(a) == k} for k in KINDS}

    def of(k: str, seen: str) -> str:
        nexts = sorted(after[k] - {k})
        if set(nexts) & set(seen):
            raise ValueError(k)
        more = "|".join(of(n, seen + k) for n in nexts)
        return f"[{KINDS[k]}]" + "++" * (k in after[k]) + (f"(?:{more})?+" if more else "")

    try:
        return "|".join(of(k, k) for k in KINDS)
    except ValueError:
        inner = any("S" in after[k] for k in "LNO")
        return "(?s).++" if inner else f"[ {MARK}]*+[^ {MARK}]++|[ {MARK}]++"


def _units(text: Column, pattern: str) -> Column:
    """The units of a text behind a space, marks as spaces; none of a null or empty one."""
    return F.when(F.octet_length(text) > 0, F.regexp_extract_all(F.concat(F.lit(" "), F.replace(text, F.lit(MARK), F.lit(" "))), F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _rows(table: DataFrame) -> list:
    return table.select("id", "piece", "score", "kind").collect()  # a vocabulary, of fixed size


def _spelling(rows: list) -> list[int]:
    """The ids of all 256 bytes, or of the unknown piece alone."""
    byte = {int(r.piece[3:5], 16): r.id for r in rows if r.kind == 6}
    return [byte[b] for b in range(256)] if len(byte) == 256 else [next((r.id for r in rows if r.kind == 2), 0)]


def _codes(char: Column, spelling: list[int]) -> Column:
    """Of a code point, marked as -2 less it, what ids it has where no piece is alike: its bytes', or the unknown piece's."""
    if len(spelling) < 256:
        return F.array(F.lit(spelling[0]))
    c = F.when(char == -2 - ord(" "), ord(MARK)).otherwise(-2 - char)
    last = lambda k: 128 + F.shiftright(c, 6 * k).bitwiseAND(63)
    utf8 = F.when(c < 1 << 7, F.array(c)).when(c < 1 << 11, F.array(192 + F.shiftright(c, 6), last(0)))
    utf8 = utf8.when(c < 1 << 16, F.array(224 + F.shiftright(c, 12), last(1), last(0))).otherwise(F.array(240 + F.shiftright(c, 18), last(2), last(1), last(0)))
    return F.transform(utf8, lambda b: F.get(F.array(*[F.lit(x) for x in spelling]), b))


def lattice(units: DataFrame, table: DataFrame, algorithm: str, *keep: str) -> DataFrame:
    """``units(unit)``, distinct, to ``unit, edges`` and the columns ``keep``: all pieces that occur in it, in the order to fold them in.

    An edge has its start, its end and its id; that of a character without a piece is -2 less its code point. For ``bpe``
    edges of one character are apart, as ``chars``, in order, and edges carry their end and id in one number.
    Long units are looked at in windows of WINDOW starts.
    """
    rows = _rows(table)
    normal = [r for r in rows if r.kind in (1, 4)]
    longest = max((len(r.piece) for r in normal), default=1)
    unknown = min((r.score for r in normal), default=0.0) - UNKNOWN_PENALTY
    # units stay the key, so that edges are grouped where the units lie, without an exchange
    windows = F.when(F.length("unit") <= WINDOW, F.array(F.struct(F.lit(0).alias("base"), F.col("unit").alias("part"))))
    windows = windows.otherwise(F.expr(f"transform(sequence(0, length(unit) - 1, {WINDOW}), b -> struct(b as base, substring(unit, b + 1, {WINDOW + longest - 1}) as part))"))
    spread = units.where("unit <> ''").select("unit", *keep, F.explode(windows).alias("w")).select("unit", *keep, "w.*")
    spread = spread.select("*", F.explode(F.expr(f"sequence(0, least({WINDOW}, length(part)) - 1)")).alias("p"))
    spread = spread.select("*", F.explode(F.expr(f"sequence(1, least(length(part) - p, {longest}))")).alias("n"))
    spread = spread.select("unit", *keep, (F.col("base") + F.col("p")).alias("s"), "n", F.expr("substring(part, p + 1, n)").alias("piece"))
    pieces = table.where("kind in (1, 4)").select(F.replace("piece", F.lit(MARK), F.lit(" ")).alias("piece"), "id", "score")
    edges = spread.join(F.broadcast(pieces), "piece", "left").where("id is not null or n = 1")
    code = F.coalesce("id", F.lit(-2) - F.ascii("piece"))
    if algorithm == "bpe":
        value = (F.shiftleft((F.col("s") + F.col("n")).cast("long"), 32) + code + (1 << 31)).alias("v")
        multi = F.struct((-F.col("score")).alias("rank"), F.col("s"), (F.col("s") + F.col("n")).alias("e"), value)
        found = [F.sort_array(F.collect_list(F.when(F.col("n") > 1, multi))).alias("edges"), F.transform(F.sort_array(F.collect_list(F.when(F.col("n") == 1, F.struct("s", value)))), lambda x: x["v"]).alias("chars")]
    else:
        one = F.struct((F.col("s") + F.col("n")).alias("e"), F.col("s"), F.coalesce("score", F.lit(unknown)).alias("score"), code.alias("id"))
        found = [F.sort_array(F.collect_list(one)).alias("edges")]
    return edges.groupBy("unit").agg(*found, *[F.first(c).alias(c) for c in keep])


def _merges() -> str:
    """A fold over the edges of more than one character; a place holds the part that starts there, its end and id in one number.

    An edge over two parts, the second of which starts where the first ends, makes them one. Spark copies an array that is
    folded into at each step, but no binary value, so the places of long units are one of 8 bytes each.
    """
    first = "int(shiftright(get(a, x.s), 32))"
    flat = f"""filter(aggregate(edges, chars, (a, x) -> if(int(shiftright(get(a, {first}), 32)) = x.e,
        concat(slice(a, 1, x.s), array(x.v), slice(a, x.s + 2, {first} - x.s - 1), array(-1L), slice(a, {first} + 2, size(a))), a)), v -> v >= 0)"""
    number = lambda p, at: f"cast(conv(hex(substring(a, 8 * ({p}) + {at}, 4)), 16, 10) as bigint)"
    first = f"int({number('x.s', 1)})"
    # a place that is within a part ends where the unit does, where no part starts
    within = "unhex(concat(lpad(hex(size(chars)), 8, '0'), 'FFFFFFFF'))"
    deep = f"""filter(transform(array(aggregate(edges, unhex(array_join(transform(chars, v -> lpad(hex(v), 16, '0')), '')), (a, x) -> if({number(first, 1)} = x.e,
        concat(substring(a, 1, 8 * x.s), unhex(lpad(hex(x.v), 16, '0')), substring(a, 8 * x.s + 9, 8 * ({first} - x.s - 1)), {within}, substring(a, 8 * {first} + 9)), a))),
        a -> transform(sequence(0, size(chars) - 1), p -> {number("p", 5)}))[0], v -> v < 4294967295L)"""
    return f"transform(if(size(chars) <= {SHORT}, {flat}, {deep}), v -> int((v & 4294967295L) - 2147483648L))"


def encoded_units(units: DataFrame, table: DataFrame, algorithm: str = "unigram", *keep: str) -> DataFrame:
    """``units(unit)``, distinct, to ``unit, ids`` and the columns ``keep``.

    ``unigram``: the pieces of the greatest sum of scores; of equal sums the one whose last piece starts first wins, and
    so on to the left. ``bpe``: the neighbours with the best piece are joined, the leftmost of equals, while there are
    any. Characters without a piece become their bytes' pieces, or the unknown piece in a table without bytes.
    """
    spelling = _spelling(_rows(table))
    found = lattice(units, table, algorithm, *keep)
    if algorithm == "bpe":
        # a piece that is better than one it is made of could come too early; tests find no unit of the tables where it does
        raw, ways = _merges(), found
    else:
        # best[p] is the best way to place p: its score, and the start and id of its last piece; edges come by their end
        fold = """aggregate(edges, array(struct(0D as score, 0 as s, -1 as id)), (best, x) -> if(x.e = size(best),
            concat(best, array(struct(best[x.s].score + x.score as score, x.s as s, x.id as id))),
            if(best[x.s].score + x.score > best[x.e].score, concat(slice(best, 1, x.e), array(struct(best[x.s].score + x.score as score, x.s as s, x.id as id))), best)))"""
        ways = found.select("unit", *keep, F.explode(F.array(F.expr(fold))).alias("best"))
        raw = """aggregate(sequence(1, size(best)), struct(size(best) - 1 as e, cast(array() as array<int>) as way),
            (a, k) -> if(a.e <= 0, a, struct(best[a.e].s as e, concat(array(best[a.e].id), a.way) as way)), a -> a.way)"""
    known = lambda way: F.when(F.array_min(way) >= 0, way).otherwise(F.flatten(F.transform(way, lambda i: F.when(i >= 0, F.array(i)).otherwise(_codes(i, spelling)))))
    ids = F.get(F.transform(F.array(F.expr(raw)), known), F.lit(0))
    return ways.select("unit", *keep, ids.alias("ids"))


def encode(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text", algorithm: str = "unigram") -> DataFrame:
    """``id_col, ids`` for each text; null and empty texts have no ids.

    An id stands for one text; repeated rows give one row. Other columns are not looked at. An empty table gives none.
    """
    pattern = unit_pattern([r.piece for r in _rows(table) if r.kind in (1, 4)])
    each = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).dropDuplicates(["doc"]).select("doc", F.posexplode(_units(F.col("text"), pattern)).alias("at", "unit"))
    known = materialise(encoded_units(each.select("unit").distinct(), table, algorithm), "units")
    out = each.join(known, "unit").groupBy("doc").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
    return docs.select(id_col).distinct().join(out.withColumnRenamed("doc", id_col), id_col, "left").select(id_col, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def _spelled(ids: Column, rows: list) -> Column:
    """The text of ids, marks and all: bytes are put together as UTF-8, control pieces are left out."""
    known = {r.id: r.piece[3:5] if r.kind == 6 else "" if r.kind in (2, 3) else r.piece.encode().hex() for r in rows}
    spelled = F.split(F.lit(",".join(known.get(i, "") for i in range(max(known, default=0) + 1))), ",")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(spelled, i)), "")), "UTF-8")


def decode(encoded: DataFrame, table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, text`` of ``id_col, ids``; byte pieces are put together as UTF-8, control pieces are left out."""
    text = F.replace(_spelled(F.col("ids"), _rows(table)), F.lit(MARK), F.lit(" "))
    return encoded.select(id_col, F.regexp_replace(text, "^ ", "").alias("text"))


def _frequent(known: DataFrame) -> DataFrame:
    """The most frequent of ``known(unit, count, ...)``, FREQUENT rows at most: those above a count that is taken from a histogram."""
    size = F.floor(8 * F.log2("count")).cast("int")
    above, least = 0, None
    for r in known.where(f"length(unit) <= {FREQUENT_LENGTH}").groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect():  # 512 rows at most
        if (above := above + r.n) > FREQUENT:
            break
        least = r["size"]
    return known.where(f"length(unit) <= {FREQUENT_LENGTH}").where(size >= least) if least is not None else known.limit(0)


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Per document: how many units and pieces, a digest of the ids in order, and how many units are decoded to themselves.

    The digest is a sum over the units of a hash of place and ids, so rows are combined before the shuffle.
    """
    docs, table = spark.read.parquet(f"{sf_dir}/documents.parquet"), piece_table(spark)
    rows = _rows(table)
    units = _units(F.col("text"), unit_pattern([r.piece for r in rows if r.kind in (1, 4)]))
    counts = docs.select(F.explode(units).alias("unit")).groupBy("unit").agg(F.count("*").alias("count"))
    known = encoded_units(counts, table, model_type(), "count")
    back = F.replace(_spelled(F.col("ids"), rows), F.lit(MARK), F.lit(" ")) == F.col("unit")
    known = materialise(known.select("unit", "count", F.size("ids").alias("n"), F.xxhash64("ids").alias("h"), back.cast("int").alias("same")), "units")
    top = materialise(_frequent(known).drop("count"), "top")
    # one pass: what the frequent units give is summed per document before the shuffle, each other unit is a row that is looked up
    each = docs.select("doc_id", F.posexplode(units).alias("at", "unit")).join(F.broadcast(top), "unit", "left")
    rare, value = F.col("h").isNull(), F.xxhash64("at", "h").cast("decimal(38,0)")
    rows_of = each.groupBy("doc_id", F.when(rare, F.col("unit")).alias("unit"), F.when(rare, F.col("at")).alias("at"))
    parts = rows_of.agg(F.count("*").alias("c"), F.sum("n").alias("pn"), F.sum("same").alias("ps"), F.sum(F.when(~rare, value)).alias("pv"))
    # sums have keys of their own, so that no key is hot
    parts = parts.withColumn("key", F.when(F.col("unit").isNull(), F.concat(F.lit("d"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("u"), "unit"))).drop("unit")
    found = parts.join(known.select(F.concat(F.lit("u"), "unit").alias("key"), "n", "same", "h"), "key", "left")
    v = F.when(F.col("h").isNull(), F.col("pv")).otherwise((value * F.col("c")).cast("decimal(38,0)"))
    sums = found.groupBy("doc_id").agg(F.sum("c").alias("n_units"), F.sum(F.coalesce("pn", F.col("n") * F.col("c"))).alias("n_pieces"), F.sum(F.coalesce("ps", F.col("same") * F.col("c"))).alias("n_same"), F.sum(v).alias("digest"))
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(c, zero).alias(c) for c in ("n_units", "n_pieces", "n_same")]
    return docs.select("doc_id").join(sums, "doc_id", "left").select("doc_id", *counts, F.coalesce(F.col("digest").cast("string"), F.lit("0")).alias("ids_digest"))
