import re
from collections import Counter

import pytest

from photoflow.llm.quality_rules import DecisionList, judge, kept_documents, op5_quality_rules

LABELS = "doc_id long, quality int"


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeats = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(repeats) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeats), failed


def digest(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_whole_table_statistics_and_verdicts(spark, sf01):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op5_quality_rules(spark, sf01).collect()}
    assert {i: digest(r) for i, r in got.items()} == {i: plain(t) for i, t in texts.items()}
    assert not any(r.kept and r.base_failed for r in got.values())
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf01}/labels.parquet").collect()}
    left = [(quality[i], r.kept) for i, r in got.items() if i in quality and not r.base_failed]
    assert sum(k for q, k in left if q == 1) >= 0.98 * sum(q == 1 for q, _ in left)
    assert sum(not k for q, k in left if q == 0) >= 0.9 * sum(q == 0 for q, _ in left)


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_texts(spark, labelled):
    texts = [None, "", " \n\t ", "one two three four", "a " * 30, "x" * 200_000, "é#|<\n\n b c \x0bd\x85e f g h i j k l m", "same line here\n" * 12, "a b c d e f a b c d e g h i j k l m n o p q r s t u v w x y z", "word " * 60_000]
    rows = [(i, t, 3, "x", False) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, row string, kept boolean")
    labels = spark.createDataFrame([(0, 0), (1, 1), (6, None), (99, 0)] if labelled else [], LABELS)
    got = judge(docs, labels).collect()
    assert len(got) == 2 * len(texts)
    assert all(digest(r) == plain(texts[r.doc_id]) for r in got)
    back = kept_documents(docs, labels)
    assert back.columns == docs.columns
    assert sorted(r.doc_id for r in back.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert judge(docs.limit(0), labels).count() == 0


def test_learns_and_prunes_thresholds(spark):
    words = "in the old house they read a long letter by the lamp".split()
    rows = [(i, " ".join(words[(i * k) % 12] + (str(i) if k % 4 else "") for k in range(1, 31))) for i in range(400)]
    rows = [(i, t.replace(" ", "$ ") if i % 5 == 0 else t) for i, t in rows]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 != 0)) for i, _ in rows], LABELS)
    got = judge(docs, labels).collect()
    assert all(r.kept == (r.doc_id % 5 != 0) for r in got if not r.base_failed)


def test_rules_are_ordered_conditions():
    assert DecisionList.condition([("symbols", ">", 0.5), ("words", "<=", 3.0)]) == "coalesce(try_divide(n_symbols, word_chars), 0D) > 0.5D and coalesce(double(n_words), 0D) <= 3.0D"
