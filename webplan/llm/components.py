"""Connected components of a table of links, by distributed union-find.

Each task first unites the links it holds and passes on a star per tree.  The stars are dealt anew to tasks of at most
``LINKS`` links each and united again: what fits in one task is then done.  Beyond that, stars of different tasks are
merged in rounds: every node hands its larger neighbours to its smallest one, then its smaller neighbours, until all
trees are stars.  Nothing but counts reach the driver, and each round's links are written to the checkpoint folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webplan.llm.common import settled

#: Links dealt to a task, and nodes that it holds before it passes its stars on and starts anew.
LINKS, NODES = 200_000, 500_000


class Forest:
    """Union-find whose roots are the smallest nodes."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, top)
        return top

    def unite(self, x, y) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self) -> tuple[list, list]:
        nodes = list(self.parent)
        return nodes, [self.root(x) for x in nodes]


def _task_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest, schema = Forest(), None
    for batch in batches:
        schema = batch.schema
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.unite(x, y)
        if len(forest.parent) > NODES:
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(forest.stars(), schema)], schema=schema)
            forest = Forest()
    if forest.parent:
        yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(forest.stars(), schema)], schema=schema)


def _small_star(links: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, go to its smallest neighbour."""
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = links.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours go to the smallest of its neighbours and itself."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _unsettled(links: DataFrame) -> bool:
    ends = links.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("top")).unionByName(
        links.select(F.col("lo").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("top"))
    )
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("top").alias("top"))
    return not seen.filter("up > 1 or (up = 1 and top = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of any ordered type -> (node, root): every node that reaches a smaller one, and the smallest.

    Roots and nodes without a link have no row; an empty table gives none.  Links to null are left out."""
    pairs = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter(
        "a is not null and b is not null and a <> b"
    )
    state = settled(pairs.mapInArrow(_task_stars, pairs.schema).distinct())
    while n := state.count():
        tasks = -(-n // LINKS)
        state = settled(state.repartition(tasks).mapInArrow(_task_stars, pairs.schema).distinct())
        if tasks == 1 or not _unsettled(state):
            break
        state = settled(_small_star(_large_star(state)))
    return state.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
