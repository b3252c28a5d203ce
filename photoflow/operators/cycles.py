"""Nodes of a directed graph that lie on a cycle, in space that is linear in its edges.

Rounds trim what has no edge in or none out and take nodes of one edge in and one out off their chains (about half of
them a round, by a coin for each), so that trees and chains of any length are gone after some log n rounds, and a cycle
shrinks to a loop. What is left is coloured: each node gets the least node that reaches it; the nodes of a colour that
reach the colour's own node are a strongly connected component, and edges between colours lie on no cycle. Each round's
tables are written, and deleted when the next one's are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photoflow.sources.shared import drop, written

#: Rounds beyond which something is wrong.
ROUNDS = 500


def _trimmed(e: DataFrame) -> DataFrame:
    return e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")


def _shorter(e: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """Edges with some nodes of one edge in and one out taken off, and these nodes: ``node, a, c``, what was before and behind."""
    ins = e.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("a")).where("n = 1").select(F.col("b").alias("node"), "a")
    outs = e.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("c")).where("n = 1").select(F.col("a").alias("node"), "c")
    thin = ins.join(outs, "node").where("a <> node and c <> node")
    coin = lambda c: F.pmod(F.xxhash64(c, F.lit(number)), F.lit(2)) == 1
    # a node goes if its coin says so and the node before it stays, so no two neighbours go
    before = thin.where(coin(F.col("node"))).join(thin.select(F.col("node").alias("a"), F.lit(True).alias("thin")), "a", "left")
    gone = written(before.where(F.col("thin").isNull() | ~coin(F.col("a"))).select("node", "a", "c"), "cycles")
    ends = gone.select(F.col("node").alias("a")), gone.select(F.col("node").alias("b"))
    rest = e.join(ends[0], "a", "left_anti").join(ends[1], "b", "left_anti").select("a", "b")
    return rest.union(gone.select("a", F.col("c").alias("b"))).distinct(), gone


def _spread(start: DataFrame, edges: DataFrame, column: str, jump: bool) -> DataFrame:
    """``start(node, column)`` with the least value of ``column`` that comes along ``edges(a, b)``, in rounds until none changes."""
    state = written(start, "cycles")
    for _ in range(ROUNDS):
        come = edges.join(state.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), column)
        now = state.union(come).groupBy("node").agg(F.min(column).alias(column))
        if jump:  # what reaches the node that reaches this one reaches this one
            far = now.select(F.col("node").alias(column), F.col(column).alias("far"))
            now = now.join(far, column, "left").select("node", F.least(column, "far").alias(column))
        nxt = written(now, "cycles")
        same = nxt.join(state.withColumnRenamed(column, "was"), "node", "left").where(f"was is null or was <> {column}").isEmpty()
        drop(state)
        state = nxt
        if same:
            return state
    raise RuntimeError(f"no end after {ROUNDS} rounds")


def _core(e: DataFrame) -> list[DataFrame]:
    """Tables ``node, component`` of what lies on cycles of trimmed edges."""
    found = []
    for _ in range(ROUNDS):
        if e.isEmpty():
            break
        nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
        colour = _spread(nodes.withColumn("colour", F.col("node")), e, "colour", True)
        c = lambda k: colour.select(F.col("node").alias(k), F.col("colour").alias(f"c{k}"))  # noqa: E731, B023
        inside = written(e.join(c("a"), "a").join(c("b"), "b").where("ca = cb").select("a", "b"), "cycles")
        back = _spread(colour.where("node = colour"), inside.select(F.col("b").alias("a"), F.col("a").alias("b")), "colour", False)
        many = back.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour")
        found.append(written(back.join(many, "colour", "left_semi").select("node", F.col("colour").alias("component")), "cycles"))
        done = back.select(F.col("node").alias("a"))
        left = inside.join(done, "a", "left_anti").join(done.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b")
        nxt = written(_trimmed(left), "cycles")
        for table in (e, colour, inside, back):
            drop(table)
        e = nxt
    drop(e)
    return found


def on_cycles(edges: DataFrame) -> DataFrame:
    """``node, component`` of all nodes of ``edges(a, b)`` that lie on a cycle, a loop too; nodes of one component reach each other.

    Edges with a null end count for nothing, repeated ones once. No edges give no rows.
    """
    spark = edges.sparkSession
    e = written(edges.where("a is not null and b is not null").select("a", "b").distinct(), "cycles")
    rounds, sizes = [], [e.count()]
    for number in range(ROUNDS):
        shorter, gone = _shorter(_trimmed(e.where("a <> b")), number)
        nxt = written(shorter, "cycles")
        rounds.append((e, gone))  # the loops among a round's edges, and what went from its chains
        e = nxt
        sizes.append(e.count())
        if sizes[-1] == 0 or sizes[-3:] == [sizes[-1]] * 3:
            break
    else:
        raise RuntimeError(f"no end after {ROUNDS} rounds")
    parts = _core(written(_trimmed(e.where("a <> b")), "cycles"))
    found = spark.createDataFrame([], e.select(F.col("a").alias("node"), F.col("a").alias("component")).schema)
    for part in parts:
        found = found.union(part)
    rounds.append((e, None))
    # back again: what went from a chain is on a cycle if its neighbours are on one together, or are one node that is
    for own, gone in reversed(rounds):
        at = lambda k: found.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))  # noqa: E731, B023
        back = gone.join(at("a"), "a").join(at("c"), "c").where("ca = cc").select("node", F.col("ca").alias("component")) if gone is not None else found.limit(0)
        more = written(found.union(back), "cycles")
        loops = own.where("a = b").select(F.col("a").alias("node"))
        now = written(more.union(loops.join(more, "node", "left_anti").select("node", F.col("node").alias("component"))), "cycles")
        for table in (*parts, own, gone, more):
            if table is not None:
                drop(table)
        found, parts = now, [now]
    return found
