"""Connected components by hooking and contraction, in DataFrames only.

Each round hooks every node onto its smallest neighbour if that is smaller, follows
the hooks to their ends by doubling, and contracts the edges to these ends. What is
left after a round is the nodes that are less than all their neighbours, at most half of
them, so rounds are logarithmic in the nodes and the doublings of one round in the
longest chain of hooks: a path in the order of its ids takes one round. The least node of a
component is never hooked, so the last node standing is the component's smallest. Every
step ends in a settled table; nothing that grows with the data reaches the driver.

Defined cases: repeated edges and edges of a node with itself add nothing; a null end is no
edge; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import release, settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge between two different nodes."""
    live = settle(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
    found = None
    while live.limit(1).count():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to"))
        hooks = _ends(settle(hooks))
        first, second = hooks.toDF("a", "ra"), hooks.toDF("b", "rb")
        after = live.join(first, "a").join(second, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        after = settle(after.where("a < b").distinct())
        if found is None:
            found = hooks
        else:
            onward = hooks.toDF("to", "next")
            found = settle(found.join(onward, "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        release(live)
        live = after
    if found is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.select("node", F.col("to").alias("component"))


def _ends(hooks: DataFrame) -> DataFrame:
    """Where the chain of hooks that begins at each node ends."""
    while True:
        onward = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
        twice = settle(hooks.join(onward, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        release(hooks)
        if not twice.where("moved").limit(1).count():
            return twice.select("node", "to")
        hooks = twice
