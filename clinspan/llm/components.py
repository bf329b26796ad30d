"""Connected components of a graph given as links, without a driver-side graph.

Each task first reduces its links to a forest (union-find over one partition). Then large-star and
small-star steps alternate until nothing changes: every node ends up linked to the least node of its
component. Each round is written to the shared folder, so lineage stays short. A node with very many
links is no hot spot: its minimum is pre-aggregated, and the joins on it can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinspan.llm.stored import discard, store

MOST_ROUNDS = 60


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch[0].to_pylist(), batch[1].to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    high = [x for x in parent if parent[x] != x]
    for i in range(0, len(high), 10000):
        some = high[i:i + 10000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], ["high", "low"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; ``root`` is the least node of its component.

    Columns ``a`` and ``b`` are bigint. Links with a null end or to itself, repeated links and the
    order of the ends make no difference; an empty table gives no rows.
    """
    ends = links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where(
        f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL AND high <> low")
    edges = store(ends.mapInArrow(_forest, "high long, low long").distinct(), "links")
    seen = None
    for _ in range(MOST_ROUNDS):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = edges.select(F.col("high").alias("node"), F.col("low").alias("near")).union(
            edges.select(F.col("low").alias("node"), F.col("high").alias("near")))
        least = both.groupBy("node").agg(F.min("near").alias("least"))
        large = both.join(least, "node").where("near > node").select(
            F.col("near").alias("high"), F.least("node", "least").alias("low")).distinct()
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(least, "high")
        small = small.where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low")).union(
            small.select("high", F.col("least").alias("low"))).distinct()
        before, edges = edges, store(small, "links")
        discard(before)
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).union(
        edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
