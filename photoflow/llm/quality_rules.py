"""Quality rules: fixed base rules and a learned decision list, in DataFrame operations only.

Sequential covering grows one conjunction of thresholds at a time on two thirds of the labelled rows, by information
gain over binned statistics, prunes its last conditions on the other third, and then covers what the rules so far leave.
What is learned is a few conditions; each step is one aggregation that combines before its shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photoflow.llm.common import WS, discard, materialise, used

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks"]
FEATURES = {
    "words": "double(n_words)", "word_length": "try_divide(word_chars, n_words)", "symbols": "try_divide(n_symbols, word_chars)", "dup_lines": "try_divide(n_dup_lines, n_lines)",
    "repeats": "try_divide(n_repeat_words, n_words)", "upper": "try_divide(n_upper, word_chars)", "digits": "try_divide(n_digits, word_chars)", "marks": "try_divide(n_marks, n_words)",
}
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def _let(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` whose results later expressions read as they are: a generator of one row, which isn't merged into them."""
    one = F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))
    return df.select("*", F.inline(one))


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, and STATS of the whole text (long; of a null text, as of an empty one).

    Words are runs other than ASCII white space. ``n_repeat_words``: words in 5-word windows that occur twice or more in
    the text. ``n_dup_lines``: lines with a word that equal an earlier one. Lengths are in code points.
    """
    t = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    df = _let(
        docs.select(F.struct("*").alias("row")),
        _words=F.filter(F.split(t, WS), lambda w: w != ""),
        _lines=F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        n_symbols=(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        n_upper=(F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).cast("long"),
        n_digits=(F.length(t) - F.length(F.translate(t, "0123456789", ""))).cast("long"),
        n_marks=(F.length(t) - F.length(F.translate(t, "!?", ""))).cast("long"),
        word_chars=F.length(F.regexp_replace(t, WS, "")).cast("long"),
    )
    df = _let(
        df, n_words=F.size("_words").cast("long"), n_lines=F.size("_lines").cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), _h=F.transform("_words", lambda w: F.xxhash64(w)),
    ).drop("_words", "_lines")
    window = lambda i: F.struct(F.xxhash64(*[F.get("_h", i + k) for k in range(5)]).alias("h"), i.alias("i"))
    df = _let(df, _w=F.when(F.col("n_words") >= 5, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_h") - 5), window))).otherwise(F.array())).drop("_h")
    same = lambda x, k: F.coalesce(F.get("_w", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_w", k + 1)["h"] == x["h"], F.lit(False))
    df = _let(df, _at=F.sort_array(F.transform(F.filter("_w", same), lambda x: x["i"]))).drop("_w")
    # each start covers 5 words less those that the start before it covers
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("sum"))
    covered = F.aggregate("_at", start, lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.least(F.lit(5), x - a["last"])).alias("sum")), lambda a: a["sum"].cast("long"))
    return _let(df, n_repeat_words=covered).select("row", *STATS)


class DecisionList:
    """Ordered rules; each is a conjunction of (feature, "<=" or ">", threshold), and rejects what it matches."""

    def __init__(self, rules: list[list[tuple[str, str, float]]]):
        self.rules = rules

    @staticmethod
    def condition(rule: list[tuple[str, str, float]]) -> str:
        return " and ".join(f"coalesce({FEATURES[f]}, 0D) {op} {t!r}D" for f, op, t in rule)

    def kept(self) -> Column:
        out = None
        for rule in self.rules:
            c = F.expr(self.condition(rule))
            out = F.when(c, F.lit(False)) if out is None else out.when(c, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(labelled: DataFrame, max_rules: int = 8, max_conditions: int = 4, bins: int = 40, min_precision: float = 0.95, min_cover: int = 3) -> DecisionList:
    """Learn which rows to reject from ``labelled``: columns STATS, ``id`` and ``quality`` (0: reject; nulls are left out).

    No labelled rows, or no rejected ones, give an empty list, which keeps everything. Ties go to the first feature.
    """
    names = list(FEATURES)
    x = labelled.where("quality is not null").select("id", (F.col("quality") == 0).cast("long").alias("y"), *[F.expr(f"coalesce({e}, 0D)").alias(n) for n, e in FEATURES.items()])
    x = materialise(x, "labelled")
    cuts = x.approxQuantile(names, [k / bins for k in range(bins)], 0.002)
    cuts = {n: sorted(set(c)) for n, c in zip(names, cuts, strict=True)}
    # a value's bin: how many cuts are below it; "> cut k" is "bin > k", in order of the cuts
    binned = x.select("y", (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("test"), *[sum((F.col(n) > c).cast("int") for c in cuts[n]).alias(n) if cuts[n] else F.lit(0).alias(n) for n in names])
    left = materialise(binned.groupBy("y", "test", *names).agg(F.count("*").alias("n")), "binned")

    def where(rule):
        return " and ".join(f"{f} {op} {k}" for f, op, k in rule) or "true"

    def gains(rule, uncovered):
        """Of each condition that can be added: rejected and kept rows that then match, of the growing part."""
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("b")) for n in names]))
        got = left.where(uncovered).where("not test").where(where(rule)).select("y", "n", pairs.alias("x")).groupBy("x.f", "x.b").agg(F.sum(F.expr("n * y")).alias("p"), F.sum(F.expr("n * (1 - y)")).alias("q")).collect()
        for name in names:
            by = {r["b"]: (r["p"], r["q"]) for r in got if r["f"] == name}
            tp, tq = sum(v[0] for v in by.values()), sum(v[1] for v in by.values())
            p = q = 0
            for k in range(len(cuts[name])):
                p, q = p + by.get(k, (0, 0))[0], q + by.get(k, (0, 0))[1]
                yield (name, "<=", k), p, q, tp, tq
                yield (name, ">", k), tp - p, tq - q, tp, tq

    rules: list[list[tuple[str, str, int]]] = []
    while len(rules) < max_rules:
        uncovered = " and ".join(f"not ({where(r)})" for r in rules) or "true"
        rule: list[tuple[str, str, int]] = []
        while len(rule) < max_conditions:
            best = (0.0, None, 0)
            for cond, p, q, tp, tq in gains(rule, uncovered):
                if p >= min_cover and p + q < tp + tq:
                    gain = p * (math.log2(p / (p + q)) - math.log2(tp / (tp + tq)))
                    if gain > best[0] + 1e-9:
                        best = (gain, cond, q)
            if best[1] is None:
                break
            rule.append(best[1])
            if best[2] == 0:
                break
        if not rule:
            break
        parts = [rule[: k + 1] for k in range(len(rule))]
        sums = [F.sum(F.expr(f"if({where(r)}, n * {y}, 0)")).alias(f"{c}{k}") for k, r in enumerate(parts) for c, y in (("p", "y"), ("q", "(1 - y)"))]
        got = left.where(uncovered).where("test").agg(*sums).first()
        score = [((got[f"p{k}"] or 0) - (got[f"q{k}"] or 0)) / max(1, (got[f"p{k}"] or 0) + (got[f"q{k}"] or 0)) for k in range(len(parts))]
        k = max(range(len(parts)), key=lambda k: (score[k], -k))
        p, q = got[f"p{k}"] or 0, got[f"q{k}"] or 0
        if p < 1 or p < min_precision * (p + q):
            break
        rules.append(parts[k])
    discard(x)
    discard(left)
    return DecisionList([[(f, op, float(cuts[f][k])) for f, op, k in rule] for rule in rules])


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DecisionList:
    """``stats``: STATS and ``id_col``; ``labels``: ``id_col`` and ``quality``. The join moves numbers only, no texts."""
    own = labels.select(F.col(id_col).alias("id"), "quality")
    return learn(stats.select(F.col(id_col).alias("id"), *STATS).join(own, "id"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, STATS, ``base_failed`` and ``kept``.

    Base: under 10 words, or more than a fifth of the words in repeated windows; what fails it isn't kept. Null, empty
    and wordless texts fail. Empty tables give no rows, and empty labels the base alone. Repeated ids are judged each.
    """
    stats = with_stats(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select(F.col("row.id").alias(id_col), *STATS)
    stats = materialise(stats, "stats")
    rules = fit(stats, labels, id_col)
    failed = F.expr(BASE_FAILED)
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & rules.kept())


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with their own columns; texts aren't shuffled.

    Rows and statistics are one table in the shared folder, so that these are computed once; the result reads it.
    """
    stats = materialise(with_stats(docs, text_col), "stats")
    rules = fit(stats.select(F.col(f"row.{id_col}").alias(id_col), *STATS), labels, id_col)
    return used(stats.where(~F.expr(BASE_FAILED) & rules.kept()).select("row.*"), stats)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper", "n_digits", "n_marks")
