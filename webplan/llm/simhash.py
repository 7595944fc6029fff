"""Near-duplicate documents: SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has 64 bits.  For radius r every bit position is given a vector m(i) of r + 1 bits; for each non-zero
vector v, table v keeps the positions with an odd inner product of m(i) and v.  The at most r positions in which two
close fingerprints differ give at most r linear conditions on v, so some non-zero v is orthogonal to all of them: the
pair agrees on every position that table v keeps.  With r = 4 these are 31 tables of 32 or so positions, and no pair
within the radius is missed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window as W

from webplan.llm.common import blocks, row_key, settled, utf8
from webplan.llm.components import components

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Fingerprints of one bucket that are compared in one task; larger buckets are compared block by block.
BUCKET_BLOCK = 2048
#: A-Z in lower case, the white space of the word rule as plain spaces.
FOLD = bytes((b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b) for b in range(256))


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, unsigned; 0 for a text without words."""
    words = text.translate(FOLD).split()
    if not words:
        return 0
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    width = min(width, len(words))
    first, last = start[: len(words) - width + 1].tolist(), end[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(first), 1 << 16):
        part = [digest(flat[a:b], SEED) for a, b in zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)])]
        lanes = np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(first)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints():
    """Column function: fingerprints of a column of bytes, as signed numbers."""

    @arrow_udf("bigint")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            found = [fingerprint(t) for block in blocks(column) for t in block]
            yield pa.array(np.array(found, dtype=np.uint64).view(np.int64), pa.int64())

    return made


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The 2^(radius+1) - 1 masks, as signed 64-bit numbers."""
    top = (1 << (radius + 1)) - 1
    vector = [1 + i % top for i in range(bits)]
    masks = [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() & 1) for v in range(1, top + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _spanning_links(radius: int):
    """Rows in the order of their group -> links that join each group's fingerprints within the radius as all of its
    pairs would; at most one fewer than the group has members."""

    def forest(members: np.ndarray, out: list) -> None:
        left = members
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                u = queue.pop()
                near = np.bitwise_count(left ^ u) <= radius
                if near.any():
                    out.extend((u, v) for v in left[near])
                    queue.extend(left[near])
                    left = left[~near]

    def emit(out: list) -> pa.RecordBatch:
        pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, np.empty(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)], axis=1)
            prints = np.asarray(batch.column(4)).view(np.uint64)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            edge = [0, *cut.tolist(), len(keys)]
            out: list = []
            for a, b in zip(edge[:-1], edge[1:]):
                key = tuple(keys[a])
                if key != held_key:
                    forest(held, out)
                    held_key, held = key, prints[a:b]
                else:
                    held = np.concatenate([held, prints[a:b]])
            if out:
                yield emit(out)
        out = []
        forest(held, out)
        if out:
            yield emit(out)

    return run


def print_links(prints: DataFrame, radius: int = RADIUS, block: int = BUCKET_BLOCK) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect exactly what links within the radius connect."""
    masks = F.array(*[F.lit(m).cast("long") for m in covering_masks(radius)])
    keyed = prints.select("fp", F.posexplode(masks).alias("t", "mask")).select(
        "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
    )
    bucket = W.partitionBy("t", "key")
    shared = (
        keyed.select("*", F.row_number().over(bucket.orderBy("fp")).alias("at"),
                     F.count(F.lit(1)).over(bucket).alias("n"))
        .filter("n > 1")
        .withColumn("own", F.floor((F.col("at") - 1) / block))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))))
        .select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    dealt = shared.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "fp")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return dealt.mapInArrow(_spanning_links(radius), schema).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) -> doc_id, row_key, fp, component_id, keeper.

    fp is the fingerprint; component_id the smallest doc_id of all rows reachable over links of at most ``radius``
    differing bits, itself included; keeper is true for one row of each component, that of the smallest (doc_id,
    row_key), nulls last.  Equal fingerprints are always linked.

    Null, empty and wordless texts have fingerprint 0 and are one group.  A null doc_id never becomes a component_id
    unless its whole component has none.  Repeated rows share all values, keeper included.  Other columns are left
    out.  An empty table gives an empty result."""
    rows = settled(docs.select("doc_id", row_key(docs).alias("row_key"), fingerprints()(utf8(F.col("text"))).alias("fp")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    prints = settled(rows.groupBy("fp").agg(first))
    return classed(rows, prints, components(print_links(prints.select("fp"), radius)), "fp")


def classed(rows: DataFrame, prints: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    """Rows (doc_id, row_key, ``key``), the first row of every key, and the keys' components (node, root) -> rows with
    component_id and keeper."""
    rooted = prints.join(linked.withColumnRenamed("node", key), key, "left").select(
        key, F.coalesce("root", key).alias("root"), "first"
    )
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    classes = rooted.select(key, "root").join(firsts, "root").select(key, "first")
    return rows.join(classes, key).select(
        "doc_id", "row_key", key, F.col("first.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_key") == F.col("first.row_key"))).alias("keeper"),
    )


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of every component (see near_duplicates), all columns kept.  Of rows that are repeated
    with equal doc_id and text one stays, the first in the order of their other columns."""
    return keepers_of(docs, near_duplicates(docs, radius))


def keepers_of(docs: DataFrame, told: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``told`` (see classed) names as keepers, repeated ones once."""
    keepers = told.filter("keeper").select(
        F.col("doc_id").alias("__id"), F.col("row_key").alias("__key")
    ).distinct()
    rows = docs.withColumn("__row", row_key(docs))
    # told as a case, so that rows are dealt by their key alone and the window below finds them where they are
    same = F.when(F.col("doc_id").isNull(), F.col("__id").isNull()).otherwise(F.col("doc_id") == F.col("__id"))
    kept = rows.join(keepers, (F.col("__row") == F.col("__key")) & F.coalesce(same, F.lit(False)), "left_semi")
    order = [F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)]
    return (
        kept.withColumn("__n", F.row_number().over(W.partitionBy("__row", "doc_id").orderBy(*order)))
        .filter("__n = 1").drop("__n", "__row")
    )
