"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

A uniform random order of N rows cut into shards of fixed sizes sends from any set of n rows a multivariate
hypergeometric number to each shard.  So the counts can be drawn first: matrix[p, c] rows go from partition p to cell
c, with the partition sizes as row sums and the wished cell sizes as column sums.  Each partition then permutes its
own rows and deals them out by those counts, the rows are exchanged, and each cell permutes what it received.

Partitions are hash classes of the rows, not tasks, so a task that is run again deals the same rows to the same
shards.  A shard is a run of cells of known size, so that a slot number needs no sort of a whole shard.  The driver
holds the matrix only: at most ``MOST_PARTITIONS`` rows of counts, whose number of cells follows from the rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows that a partition or a cell is meant to hold, and bounds for the number of partitions.
PART_ROWS, CELL_ROWS, LEAST_PARTITIONS, MOST_PARTITIONS = 1_000_000, 4_000_000, 64, 4096


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows taken without replacement are good: inversion over the range of 12 standard
    deviations on either side of the mode, beyond which double precision holds no probability."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = (draws + 1) * (good + 1) // (total + 2)
    spread = math.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1)))
    low, high = max(low, int(mode - 12 * spread) - 12), min(high, int(mode + 12 * spread) + 12)
    k = np.arange(low, high, dtype=np.float64)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(step)])
    mass = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def communication_matrix(parts: list[int], cells: list[int], seed: int) -> list[list[int]]:
    """Counts with row sums ``parts`` and column sums ``cells``, as a uniform random order would give them."""
    rng, left, matrix = np.random.default_rng(seed), list(cells), []
    for n in parts:
        row, wanted, rest = [], n, sum(left)
        for cell in left:
            rest -= cell
            row.append(draw_hypergeometric(rng, cell, rest, wanted))
            wanted -= row[-1]
        left = [a - b for a, b in zip(left, row)]
        matrix.append(row)
    return matrix


def split_evenly(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def shuffle_into_shards(rows: DataFrame, shards: int = 16, seed: int = 0, key: Column | None = None) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (0 and up without gaps inside the shard): a uniform
    random arrangement in which shard sizes differ by one at most.

    ``key`` identifies a row (default: a hash of all columns); equal keys are repeated rows, which take any of their
    places.  Nulls hash like values.  An empty table gives an empty result.  Columns named shard or slot are
    replaced.  Two exchanges; the rows are never collected and only their counts reach the driver."""
    rows = rows.drop("shard", "slot")
    columns = [F.col(f"`{c}`") for c in rows.columns]
    own = F.xxhash64(*columns) if key is None else key
    keyed = rows.withColumn("__key", own)
    draw = lambda what: F.xxhash64(F.lit(f"{seed}:{what}"), F.col("__key"))
    total = keyed.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    n_parts = max(LEAST_PARTITIONS, min(MOST_PARTITIONS, -(-total // PART_ROWS)))
    dealt = keyed.withColumn("__part", F.pmod(draw("part"), F.lit(n_parts)).cast("int"))
    found = {r["__part"]: r["n"] for r in dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    per_shard = max(1, -(-total // (shards * CELL_ROWS)))
    sizes = split_evenly(sum(found.values()), shards)
    cells = [n for size in sizes for n in split_evenly(size, per_shard)]
    offset = [sum(split_evenly(size, per_shard)[:i]) for size in sizes for i in range(per_shard)]
    matrix = communication_matrix([found.get(p, 0) for p in range(n_parts)], cells, seed)
    upto = [np.cumsum(row).reshape(shards, per_shard) for row in matrix]
    plan = rows.sparkSession.createDataFrame(
        [(p, u[:, -1].tolist(), u.tolist()) for p, u in enumerate(upto)],
        "__part int, __shards array<bigint>, __cells array<array<bigint>>",
    )
    starts = F.array(*[F.lit(n).cast("long") for n in offset])
    ranked = dealt.withColumn("__at", F.row_number().over(W.partitionBy("__part").orderBy(draw("deal"), "__key")))
    passed = lambda ends: F.size(F.filter(ends, lambda end: end < F.col("__at")))
    placed = (
        ranked.join(plan, "__part").withColumn("__shard", passed("__shards"))
        .withColumn("__cell", F.col("__shard") * per_shard + passed(F.element_at("__cells", F.col("__shard") + 1)))
        .drop("__shards", "__cells")
    )
    arranged = placed.withColumn("__to", F.row_number().over(W.partitionBy("__cell").orderBy(draw("slot"), "__key")))
    return arranged.select(
        *columns,
        F.col("__shard").cast("int").alias("shard"),
        (F.element_at(starts, F.col("__cell") + 1) + F.col("__to") - 1).alias("slot"),
    )


def shard_digest(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: shard sizes differ by one at most.  A null text has no bytes: size 1, checksum 0, as the
    empty text.  Repeated rows get places of their own; other columns are left out."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = shuffle_into_shards(slim, shards, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
