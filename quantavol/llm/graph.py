"""Connected components of a link table, without collecting links anywhere.

Each round hooks every node to the smallest node among itself and its neighbours, follows those
pointers to their roots, and contracts the links to links between roots. Every tree of pointers
has at least two nodes, so the number of roots with links at least halves in each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantavol.llm._common import Stage


def components(stage: Stage, links: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node of its component.

    links: columns a and b of one orderable type; order, repeats and self-links don't matter. A
    node with very many links is pre-aggregated in the minimum, and joined from its side by
    joins that adaptive execution may split.
    """
    edges = stage.table(_clean(links.select("a", "b")), f"{name}-edges-0", "snappy")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        k = len(rounds)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        up = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        up, step = stage.table(up, f"{name}-up-{k}-0", "snappy"), 0
        while True:
            to = up.select(F.col("u").alias("x"), F.col("p").alias("q"))
            jumped = up.join(to, F.col("p") == F.col("x")).select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved"))
            step += 1
            jumped = stage.table(jumped, f"{name}-up-{k}-{step}", "snappy")
            still = not jumped.filter("moved").isEmpty()
            up = jumped.drop("moved")
            if not still:
                break
        rounds.append(up)
        pa_, pb = up.select(F.col("u").alias("ua"), F.col("p").alias("na")), up.select(F.col("u").alias("ub"), F.col("p").alias("nb"))
        next_ = edges.join(pa_, F.col("a") == F.col("ua")).join(pb, F.col("b") == F.col("ub")).select(F.col("na").alias("a"), F.col("nb").alias("b"))
        edges = stage.table(_clean(next_), f"{name}-edges-{k + 1}", "snappy")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    out = rounds[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for up in rounds[1:]:
        out = out.join(up, F.col("root") == F.col("u"), "left").select("node", F.coalesce("p", "root").alias("root"))
    return stage.table(out, f"{name}-components", "snappy")


def _clean(links: DataFrame) -> DataFrame:
    return links.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
