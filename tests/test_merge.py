"""Merging by levels in Spark is the merge by recursion."""

import json
import random

from photoflow.sources.documents import merge_documents


def merged(base, new):
    """Keys of objects by recursion, arrays by place and at the replacement's length, all else replaced."""
    if isinstance(base, dict) and isinstance(new, dict):
        return {**base, **{k: merged(base[k], v) if k in base else v for k, v in new.items()}}
    if isinstance(base, list) and isinstance(new, list):
        return [merged(base[k], v) if k < len(base) else v for k, v in enumerate(new)]
    return new


def value(r, depth):
    what = r.random()
    if depth and what < 0.35:
        return {r.choice(["a", "b", "é", "k\"\\\n\x01/", "", "0"]): value(r, depth - 1) for _ in range(r.randint(0, 4))}
    if depth and what < 0.65:
        return [value(r, depth - 1) for _ in range(r.randint(0, 12))]
    return r.choice([None, True, False, 0, -7, 12345678901, "x", "", "é\"\t\\u", "null", 0.5])


def test_random_documents(spark):
    r = random.Random(5)
    pairs = [(str(k), value(r, 5), value(r, 5)) for k in range(150)]
    pairs += [("deep", json.loads('{"a":' * 9 + "1" + "}" * 9), json.loads('{"a":' * 9 + '{"n":2}' + "}" * 9)), ("long", [{"i": k} for k in range(2000)], [{"j": k} for k in range(1500)])]
    dump = lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False)
    base = spark.createDataFrame([(k, dump(a)) for k, a, _ in pairs], "path string, json string")
    new = spark.createDataFrame([(k, dump(b)) for k, _, b in pairs], "path string, json string")
    texts = {x.path: x.json for x in merge_documents(base, new).collect()}
    assert {k: json.loads(t) for k, t in texts.items()} == {k: merged(a, b) for k, a, b in pairs}
    assert texts["deep"] == json.dumps(merged(*pairs[-2][1:]), sort_keys=True, separators=(",", ":"))


def test_one_side_and_odd_texts(spark):
    schema = "path string, json string"
    base = spark.createDataFrame([("only", ' {"b": 1,"a":2} '), ("bad", "{x"), ("worse", '{"a":1}'), ("null", None), (None, "{}"), ("two", '{"a":1}'), ("two", '{"a":2}'), ("same", '{"a":{"q":2,"x":1},"l":[{"p":1,"q":2},3],"z":0}')], schema)
    new = spark.createDataFrame([("new", "[1, 2]"), ("bad", '{"a":1}'), ("worse", "nothing"), ("null", '{"a":1}'), (None, "[]"), ("two", '{"b":3}'), ("same", '{"a":{"x":9},"l":[{"p":5}],"n":null}')], schema)
    got = sorted((x.path or "", x.json) for x in merge_documents(base, new).collect())
    assert got == sorted([
        ("only", ' {"b": 1,"a":2} '), ("new", "[1, 2]"), ("bad", '{"a":1}'), ("worse", '{"a":1}'), ("null", '{"a":1}'), ("", "{}"), ("", "[]"), ("two", '{"a":1,"b":3}'), ("two", '{"a":2,"b":3}'),
        ("same", '{"a":{"q":2,"x":9},"l":[{"p":5,"q":2}],"n":null,"z":0}'),
    ])
    assert merge_documents(base.limit(0), new.limit(0)).collect() == []


def test_what_has_no_update_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("a", "{}")], "path string, json string")
    plan = merge_documents(df, df.limit(0))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
