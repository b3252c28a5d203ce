import pytest

from photoflow.llm.url_filter import RULES, judged, op1_url_filter

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(RULES, "host string, path string, action string")


def test_sql_gives_the_same_rows(spark, sf01):
    import duckdb

    from photoflow.llm.url_filter import OP1_SQL

    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{sf01}/pages.parquet')")
    want = sorted(map(str, con.execute(OP1_SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in op1_url_filter(spark, sf01).collect()) == want


def test_urls_and_rules(spark, rules):
    urls = [None, "", "no scheme/en/", "http://A.Example.COM/en/7?x=/en/", "http://b.com/en/#x", "http://com/en/7", "http://xcom/en/", "https://net/de/81", "https://q.example.net/de/81", "http://x.org?y", "http://x.org/es", "http://x.org/es/://", "http://İ.com/en/"]
    got = judged(spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], SCHEMA), rules).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/7", "example.com/en/7", "allow"), ("b.com", "/en/", "com/en/", "block"),
        ("com", "/en/7", "com/en/", "block"), ("xcom", "/en/", None, "allow"), ("net", "/de/81", "net/de/", "allow"), ("q.example.net", "/de/81", "example.net/de/8", "block"),
        ("x.org", "", None, "allow"), ("x.org", "/es", None, "allow"), ("x.org", "/es/://", "org/es/", "block"), ("İ.com", "/en/", "com/en/", "block"),
    ]


def test_aliases_take_the_components_verdict(spark, rules):
    link = '<html><LINK href="%s" rel=canonical></html>'
    rows = [
        (1, "http://one.io/a", link % "http://bad.org/es/1"),
        (2, "http://two.io/b?q=1", '<meta http-equiv="Refresh" content="0; url=//one.io/a">'),
        (3, "http://three.io/x/y", link % "z"),
        (4, "http://three.io/x/z", link % "/w"),
        (5, "http://three.io/w", link % "http://s.example.com/en/77"),
        (6, "http://three.io/w", link % "http://bad.org/es/2"),
        (7, "http://bad.org/es/1", None),
        (8, "http://alone.io/", link % ""),
        (9, "http://moved.io/", ""),
        (9, "http://moved.io/", ""),
    ]
    moved = spark.createDataFrame([("https://moved.io/#top", "http://one.io/a"), (None, "http://x.io"), ("http://x.io", None)], "src string, dst string")
    got = judged(spark.createDataFrame(rows, SCHEMA), rules, moved).orderBy("page_id").collect()
    assert [(r.page_id, r.rule, r.verdict) for r in got] == [
        (1, None, "block"), (2, None, "block"), (3, None, "allow"), (4, None, "allow"), (5, None, "allow"), (6, None, "allow"), (7, "org/es/", "block"), (8, None, "allow"), (9, None, "block"), (9, None, "block"),
    ]
    assert {r.page_id: r.alias_verdict for r in got}[3] == "allow"


def test_long_chain_star_and_empty(spark, rules):
    chain = [(i, f"http://c{i}.io/", f'<link rel="canonical" href="http://c{i + 1}.io/">') for i in range(60)] + [(60, "http://c60.io/", '<link rel="canonical" href="http://b.org/es/">')]
    star = [(100 + i, f"http://s{i}.io/", '<link rel="canonical" href="http://ok.net/de/">') for i in range(300)]
    got = judged(spark.createDataFrame(chain + star, SCHEMA), rules).collect()
    assert {r.verdict for r in got if r.page_id <= 60} == {"block"}
    assert {r.alias_verdict for r in got if r.page_id >= 100} == {"allow"}
    assert judged(spark.createDataFrame([], SCHEMA), rules).count() == 0
    assert judged(spark.createDataFrame(chain[:1], SCHEMA), rules.limit(0)).first().verdict == "allow"


def test_host_of_very_many_labels(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    rows = [(1, "http://" + "a." * 100_000 + "com/en/x", ""), (2, "http://com/en/", ""), (3, "http://xcom/en/", "")]
    got = {r.page_id: (r.rule, r.verdict) for r in judged(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert got == {1: ("com/en/", "block"), 2: ("com/en/", "block"), 3: (None, "allow")}


def test_aliases_are_their_sql(spark, sf01):
    import duckdb

    from photoflow.llm.url_filter import URL_ALIASES_SQL, url_aliases

    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{sf01}/pages.parquet')")
    got = url_aliases(spark, sf01)
    want = con.execute(URL_ALIASES_SQL).fetchall()
    assert [d[0] for d in con.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {r[4] for r in want if r[3] is None} == {"allow", "block"}  # verdicts that only an alias gives


def test_columns_of_clashing_names(spark):
    from photoflow.llm.url_filter import judged

    pages = spark.createDataFrame([(1, "http://a.com/en/x", "", "y", "z", "w")], "page_id long, url string, html string, host string, rule string, node string")
    rules = spark.createDataFrame([("com", "/en/", "block")], "host string, path string, action string")
    assert [tuple(r) for r in judged(pages, rules).collect()] == [(1, "a.com", "/en/x", "com/en/", "block", None)]
