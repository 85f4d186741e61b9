"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.sources.shared import drop_path, written


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 100) -> DataFrame:
    """node, component (the least node reachable) for each node of an edge; edges have no direction.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each node's neighbours are pointed at the least of
    them until only stars are left, in about log(n) rounds. Minima are aggregated with partial ones on the map side, so
    gathering them costs a hot node a row a task; the join that brings a node's minimum back to its edges streams them, and
    splits a hot node where adaptive execution finds it skewed. Each round is written to the shared folder, where it
    replaces the one before. Nulls and loops are dropped. No edges: no rows.
    """
    start = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).filter(F.col(src).isNotNull() & F.col(dst).isNotNull())
    now, path = written(start.filter("a <> b").distinct(), "edges")
    seen = _signature(now)
    for _ in range(most_rounds):
        both = now.selectExpr("a AS u", "b AS v").union(now.selectExpr("b AS u", "a AS v"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").selectExpr("m AS a", "v AS b").filter("a <> b").distinct()
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lowest, "b").selectExpr("inline(array(struct(m AS a, a AS b), struct(m AS a, b AS b)))").filter("a <> b").distinct()
        old, (now, path) = path, written(small, "edges")
        drop_path(edges.sparkSession, old)
        before, seen = seen, _signature(now)
        if before == seen:
            return now.selectExpr("b AS node", "a AS component").union(now.selectExpr("a AS node", "a AS component").distinct())
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
