import re

from photoflow.llm.license_scan import TEMPLATES, op6_license_scan, scanned

DOCS = "doc_id long, text string, license string"


def test_every_whole_notice_line_of_the_table_is_confirmed(spark, sf01):
    known = {text: name for name, text in TEMPLATES}
    want = {(r.doc_id, known[line]) for r in spark.read.parquet(f"{sf01}/documents.parquet").collect() for line in r.text.split("\n") if line in known}
    got = op6_license_scan(spark, sf01).collect()
    assert want and {(r.doc_id, r.license) for r in got if r.confirmed} == want


def test_wording_decides(spark):
    mit = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 100)
    rows = [
        "Released under the MIT License.", "Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 2.",
        mit.replace(" of this ", "\n of this ").upper(), "our license was revoked by the old house", "words " * 5000 + TEMPLATES[1][1] + " words" * 5000, None, "", "no marks here",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], DOCS)
    got = {r.doc_id: r for r in scanned(df).collect()}
    assert {i: r.license for i, r in got.items() if r.confirmed} == {0: "MIT", 1: "CC-BY-4.0", 2: "CC-BY-NC-4.0", 4: "MIT", 6: "GPL-3.0"}
    assert "-3" in got[3].differences and set(got) == {0, 1, 2, 3, 4, 5, 6}
    assert scanned(df.union(df)).count() == 2 * len(got) and scanned(df.limit(0)).count() == 0


def test_template_marks_are_found():
    from photoflow.llm.license_scan import _MARK

    assert all(re.search(_MARK, t) for _, t in TEMPLATES)


def test_short_notices_within_prose_and_two_in_one_block(spark):
    prose = "the old house stood by the river where nobody had gone since the long winter when snow lay deep upon every field and road and the miller told his children of wolves that came down from the hills at night ".strip()
    short = ["Released under the MIT License.", "Licensed under CC BY 4.0.", "Licensed under the Apache License, Version 2.0."]
    rows = [f"{prose[:n]} {x} {prose}" for n in (40, 180) for x in short]
    rows += [" ".join([short[0], prose, short[1]]), f"{short[0]}\n{short[2]}", "we asked what license the old house has", " ".join([prose] * 8 + [short[0]] + [prose] * 8 + [short[1]])]
    got = [sorted(r.license for r in scanned(spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], DOCS)).where(f"confirmed and doc_id = {i}").collect()) for i in range(len(rows))]
    assert got == [["MIT"], ["CC-BY-4.0"], ["Apache-2.0"]] * 2 + [["CC-BY-4.0", "MIT"], ["Apache-2.0", "MIT"], [], ["CC-BY-4.0", "MIT"]]


def test_each_of_adjacent_notices_is_a_row():
    from photoflow.llm.license_scan import Scanner

    scan = Scanner(TEMPLATES).scan
    for name, text in TEMPLATES:
        assert [r[2] for r in scan(f"{text} {text}") if r[4]] == [name] * 2, text


def test_places_are_those_of_a_search_over_all_words():
    """Exact wordings, wrapped at random widths into lines of a long text, against a plain search for runs of words."""
    import random

    from photoflow.llm.license_scan import Scanner, words

    r = random.Random(4)
    scanner = Scanner(TEMPLATES)
    for _ in range(12):
        own, want = [], []
        for _ in range(3):
            own += [r.choice("river stone winter field miller wolf".split()) for _ in range(r.randint(0, 900))]
            name, text = r.choice(TEMPLATES)
            want.append((len(words(" ".join(own))), name, len(words(text))))
            own += text.split()
        width, lines, line = r.randint(5, 40), [], []
        for w in own:
            line.append(w)
            if len(line) == width:
                lines.append(" ".join(line))
                line = []
        text = "\n".join([*lines, " ".join(line)])
        got = [x for x in scanner.scan(text) if x[4]]
        assert [x[2] for x in got] == [name for _, name, _ in want] and all(x[5] == "" for x in got)
        before = [len(words("\n".join(text.split("\n")[: x[0]]))) for x in got]
        assert all(b <= at < b + width * 4 for b, (at, _, _) in zip(before, want, strict=True))
