"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelens.llm.tables import staged


def components(links: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """``(node, root)`` for every node of a link; nodes of one component share a root.

    Each round hooks every node to the one of itself and its neighbours that a hash of the round puts first and replaces
    the nodes of all links by what they hooked to; links that become loops go. As the order is a new one in each round, a
    constant share of the nodes is expected to go, whatever the shape of the links (half of a long chain), so the number
    of rounds is logarithmic. The hooks of the rounds are then followed one after the other. Every round is a written
    table; aggregates combine before the shuffle and the joins can be split where a node has very many links.
    """
    spark = links.sparkSession
    a, b = F.col(left), F.col(right)
    rest = staged(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct(), "links")
    hooks = []
    while not rest.isEmpty():
        ends = rest.select(F.col("a").alias("node"), F.col("b").alias("other")).union(rest.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(hooks))).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        hook = staged(ends.groupBy("node").agg(F.min(rank("other")).alias("first"))
                      .select("node", F.least("first", rank("node"))["v"].alias("to")), "hooks")
        hooks.append(hook)
        moved = (rest.join(hook.select(F.col("node").alias("a"), F.col("to").alias("a_to")), "a")
                 .join(hook.select(F.col("node").alias("b"), F.col("to").alias("b_to")), "b"))
        rest = staged(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
                      .filter("a < b").distinct(), "links")
    if not hooks:
        return spark.createDataFrame([], f"node {links.schema[left].dataType.simpleString()}, "
                                         f"root {links.schema[left].dataType.simpleString()}")
    found = hooks[-1].select("node", F.col("to").alias("root"))
    for hook in reversed(hooks[:-1]):
        # what a node hooked to either goes on in a later round or is a root already
        later = found.select(F.col("node").alias("to"), "root")
        found = hook.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return found
