"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import Tables, met


#: Edges that one task takes as easily as many do: no node of so few is hot.
FEW = 1 << 16


def star(edges: DataFrame, small: bool, total: int) -> DataFrame:
    """One contraction: every node's neighbours (the smaller ones with `small`, else the larger ones) are linked to the
    least node about it. Minima are partial sums, and a node with very many of the `total` edges meets its minimum by
    broadcast, so that it is no one task's work."""
    both = edges if small else edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # rows (a, b): b is a neighbour of a; with `small`, b < a
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
    out = met(both, least, "a", "n", total) if total > FEW else both.join(least, "a")
    if small:
        return out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()
    return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of links (a, b): the least node that can be reached. Large-star and small-star
    alternate until the edges stay as they are; each step is written, so that a lost executor costs one, and the step
    before it dropped."""
    tables = Tables(links.sparkSession, "components")
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = tables.written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    last = state(edges)
    for _ in range(rounds):
        large = star(edges, False, last[0])
        if last[0] > FEW:
            large = tables.written(large, "large", [edges])
            edges = large
        edges = tables.written(star(large, True, last[0]), "edges", [edges])
        now = state(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b"), F.col("b"))).distinct()
    return tables.written(labels, "labels", [edges])
