"""Exact top-k by inner product on a bit-sliced index.

Rows are dealt into blocks.  In a block every dimension, quantised to whole numbers and counted from its least value,
is kept as bit slices: slice b is a bitmap of the rows whose value has bit b.  A query's scores are then sums of
shifted slices, one addend per bit of a query component, added for 64 rows at a time with carry-save adders on
bitmaps.  The k best rows are selected from the most significant slice of the sum downward; rows that are still equal
after the last slice have equal scores, and the boundary among them is resolved by the smaller id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: Rows of an index block, and queries answered with it in one task.
BLOCK_ROWS, QUERY_ROWS = 16_384, 512


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """Components as floor(scale * x); null unless every component is a finite number."""
    doubles = vector.cast("array<double>")
    whole = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(whole, F.transform(doubles, lambda x: F.floor(x * F.lit(scale)).cast("long")))


def _words(bits: np.ndarray) -> np.ndarray:
    """A 0/1 array as bitmap words, row i in bit i % 64 of word i // 64."""
    packed = np.packbits(bits.astype(np.uint8), bitorder="little")
    return np.pad(packed, (0, -len(packed) % 8)).view("<u8")


class SlicedBlock:
    """The bit-sliced index of a block of rows, in the order of their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.n = ids[order], len(ids)
        vectors = vectors[order]
        self.low = [int(c.min()) for c in vectors.T]
        self.slices = []
        for c, low in zip(vectors.T, self.low):
            up = c - low
            self.slices.append([_words((up >> b) & 1) for b in range(int(up.max()).bit_length())])
        self.zero = np.zeros(-(-self.n // 64), "<u8")
        self.rows = _words(np.ones(self.n, np.uint8))

    def sums(self, query: list[int]) -> tuple[list[np.ndarray], int]:
        """Slices of the scores, and the number to add to what they say.

        A negative component q times value v is |q| times the complement of v, less |q| times the complement's top."""
        base, waiting = 0, {}
        for q, low, slices in zip(query, self.low, self.slices):
            base += q * low
            size = abs(q)
            if not size or not slices:
                continue
            if q < 0:
                base -= size * ((1 << len(slices)) - 1)
            for b, s in enumerate(slices):
                s = ~s if q < 0 else s
                for shift in range(size.bit_length()):
                    if size >> shift & 1:
                        waiting.setdefault(b + shift, []).append(s)
        out, weight = [], 0
        x, y = np.empty_like(self.zero), np.empty_like(self.zero)
        while waiting:
            column = waiting.pop(weight, [])
            while len(column) > 2:  # a full adder: three bitmaps of a weight become one of it and one of the next
                a, b, c = column.pop(), column.pop(), column.pop()
                np.bitwise_xor(a, b, out=x)
                np.bitwise_and(a, b, out=y)
                carry = x & c
                np.bitwise_or(carry, y, out=carry)
                column.append(x ^ c)
                waiting.setdefault(weight + 1, []).append(carry)
            if len(column) == 2:
                a, b = column
                waiting.setdefault(weight + 1, []).append(a & b)
                column = [a ^ b]
            out.append(column[0] if column else self.zero)
            weight += 1
        return out, base

    def top(self, query_id: int, query: list[int], k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows other than the query's own."""
        slices, base = self.sums(query)
        equal, above = self.rows, self.zero
        a, b = np.searchsorted(self.ids, query_id, "left"), np.searchsorted(self.ids, query_id, "right")
        if a < b:
            own = np.zeros(self.n, np.uint8)
            own[a:b] = 1
            equal = equal & ~_words(own)
        taken = 0
        for s in reversed(slices):
            best = equal & s
            n = int(np.bitwise_count(best).sum())
            if taken + n > k:
                equal = best
            else:
                above, equal, taken = above | best, equal & ~s, taken + n
                if taken == k:
                    break
        rows = self._positions(above)
        if taken < k:
            rows = np.concatenate([rows, self._positions(equal, k - taken)])
        return [(int(self.ids[i]), base + sum(int(s[i >> 6] >> np.uint64(i & 63) & np.uint64(1)) << w for w, s in enumerate(slices)))
                for i in rows.tolist()]

    @staticmethod
    def _positions(bitmap: np.ndarray, most: int | None = None) -> np.ndarray:
        """Rows of a bitmap in order, or the first ``most`` of them."""
        at = np.flatnonzero(bitmap)
        if most is not None:
            at = at[:most]
        bits = np.unpackbits(bitmap[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        word, bit = np.nonzero(bits)
        return (at[word] * 64 + bit)[:most]


def _answer(k: int):
    def run(key: tuple, index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if index.num_rows and queries.num_rows:
            flat = index.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            block = SlicedBlock(index.column("id").to_numpy(), flat.reshape(index.num_rows, -1).astype(np.int64))
            for q, v in zip(queries.column("id").to_pylist(), queries.column("v").to_pylist()):
                out += [(q, i, s) for i, s in block.top(q, v, k)]
        return pa.table({
            "query_id": pa.array([x[0] for x in out], pa.int64()), "vec_id": pa.array([x[1] for x in out], pa.int64()),
            "score": pa.array([x[2] for x in out], pa.int64()),
        })

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0,
          block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """For every query row the k highest integer inner products among all rows of ``vectors`` but those of its own id.

    Both tables have vec_id and embedding; the result has query_id, rank, vec_id and score, ties to the smaller
    vec_id.  Rows with a null id, a null vector, or a null or non-finite component take no part; a query meets only
    vectors of its own length, and vectors without components score 0.  Repeated rows of an id count once per row as
    candidates; different vectors of one query id share one ranking.  Other columns are left out; an empty table gives an
    empty result.  Scores must fit in 64 bits."""
    ready = lambda df: df.select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding"), scale).alias("v")).filter(
        "id is not null and v is not null").withColumn("dims", F.size("v"))
    rows, asked = ready(vectors), ready(queries).distinct()
    n_blocks = max(1, -(-rows.count() // block_rows))
    n_parts = max(1, -(-asked.count() // query_rows))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part_of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    index = rows.withColumn("block", part_of(n_blocks)).withColumn("part", each(n_parts))
    posed = asked.withColumn("part", part_of(n_parts)).withColumn("block", each(n_blocks))
    keys = ["dims", "block", "part"]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])
    best = index.groupBy(*keys).cogroup(posed.groupBy(*keys)).applyInArrow(_answer(k), schema)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
