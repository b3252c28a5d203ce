import os
import random

import duckdb
import pytest

from photoflow.operators import vocabulary as V
from photoflow.operators.cycles import on_cycles
from photoflow.plans import catalog
from photoflow.sources.shared import mounted_dir


def components(edges):
    """Strongly connected components of more than a node, or of one with a loop, by Kosaraju's two searches."""
    out, back, nodes = {}, {}, {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
        nodes[a] = nodes[b] = True

    def search(start, to, seen):
        stack, order = [(start, iter(to.get(start, ())))], []
        seen.add(start)
        while stack:
            n, rest = stack[-1]
            nxt = next((x for x in rest if x not in seen), None)
            if nxt is None:
                order.append(n)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(to.get(nxt, ()))))
        return order

    seen, order = set(), []
    for n in nodes:
        if n not in seen:
            order += search(n, out, seen)
    seen, found = set(), set()
    for n in reversed(order):
        if n not in seen:
            own = search(n, back, seen)
            if len(own) > 1 or n in out.get(n, ()):
                found.add(frozenset(own))
    return found


@pytest.mark.parametrize(("seed", "n", "m"), [(2, 30, 45), (3, 200, 300)])
def test_components_are_those_of_two_searches(spark, seed, n, m):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)] + [(f"p{k}", f"p{k + 1}") for k in range(9)] + [("p9", "n0"), ("n1", "p0"), ("n2", None), (None, "n3")]
    got = {}
    for x in on_cycles(spark.createDataFrame(edges, "a string, b string")).collect():
        got.setdefault(x.component, set()).add(x.node)
    assert {frozenset(v) for v in got.values()} == components([e for e in edges if None not in e])


def test_many_entries_with_several_parents(spark):
    """20,000 entries of three parents each, a chain of 5,000 and a cycle of 1,000: no table is larger than some times the edges."""
    n = 20_000
    rows = [(f"e{k}", f"e{(k * 7919 + j) % (k or 1)}") for k in range(1, n) for j in range(3)]  # parents come before: no cycle
    rows += [(f"c{k}", f"c{k + 1}") for k in range(5_000)] + [(f"r{k}", f"r{(k + 1) % 1_000}") for k in range(1_000)] + [("r7", "c0"), ("e5", "r1"), ("c5000", "e19999")]
    before = set(os.listdir(mounted_dir(spark)))
    got = {x.canonical_path for x in V.cycles(spark.createDataFrame(rows, "canonical_path string, parent_path string")).collect()}
    assert got == {f"r{k}" for k in range(1_000)}
    assert len([x for x in set(os.listdir(mounted_dir(spark))) - before if x.startswith("cycles")]) == 1  # the result's


def test_long_cycles_and_several_parents(spark):
    rows = [(f"c{k}", f"c{(k + 1) % 40}") for k in range(40)]  # a cycle of 40
    rows += [(f"t{k}", f"t{k + 1}") for k in range(30)] + [("t30", "c0")] + [(f"e{k}", f"e{k + 1}") for k in range(25)] + [("self", "self"), ("top", None)]
    want = {f"c{k}" for k in range(40)} | {"self"}
    schema = "canonical_path string, parent_path string"
    found = lambda x: sorted(r.canonical_path for r in V.cycles(spark.createDataFrame(x, schema)).collect())
    assert found(rows) == sorted(want)
    more = [*rows, ("c3", "x"), ("x", "y"), ("y", "x"), ("x", "e0")]  # between cycles, and out of them
    assert found(more) == sorted(want | {"x", "y"})
    assert found(rows[:0]) == []


def test_violations_of_parts_beyond_the_first_2000(spark):
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"create view part as select * from read_parquet('{sf}/part.parquet')")
    want = sorted(con.execute(catalog.ORACLE_SQL["voc_violations_whole"]).fetchall())
    got = sorted(tuple(r) for r in catalog.QUERIES["voc_violations_whole"](spark, sf).select("kind", "name").collect())
    assert got == want
