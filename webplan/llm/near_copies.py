"""Near copies of documents: five-word shingles with a Jaccard similarity of 0.8 or more.

Candidates come from the SimHash fingerprints of ``simhash``: texts within its radius share a bucket of a covering table.
Most pairs at 0.8 lie further apart, so MinHash signatures of the shingles, cut into bands, give buckets too.  Documents that
share a bucket of either kind are compared by the exact Jaccard similarity of their shingle sets (64-bit hashes of the
shingles), and those at or above the threshold are united.  A pair at 0.8 shares a band with probability 0.9998; only
pairs that share none and lie outside the radius are missed."""

from __future__ import annotations

from collections.abc import Iterator
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from webplan.llm.common import blocks, row_key, settled, utf8
from webplan.llm.components import components
from webplan.llm.line_dedup import SMALL_KEYS, bucket_groups, verified
from webplan.llm.lm_scoring import span_hashes
from webplan.llm.simhash import FOLD, classed, covering_masks, fingerprint, keepers_of

SHINGLE, BANDS, ROWS, SIMILARITY = 5, 16, 4, (4, 5)
#: Documents of a bucket that are compared in one task; larger buckets are compared block by block.
GROUP = 512
_RANDOM = np.random.default_rng(21)
_MULTIPLIER = (_RANDOM.integers(1 << 32, size=BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_OFFSET = _RANDOM.integers(1 << 32, size=BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_MASKS = np.array(covering_masks(), np.int64).view(np.uint64)
_TABLE = _RANDOM.integers(1 << 63, size=len(_MASKS), dtype=np.uint64)


def plain(text: bytes) -> bytes:
    """The words of a text as they are compared, with one space between."""
    return b" ".join(text.translate(FOLD).split())


def doc_shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of plain texts, and where each text's begin; fewer than five words, or none, are
    one shingle."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    flat = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    end = np.flatnonzero(flat == 32)
    start = np.concatenate([[0], end[:-1] + 1])
    words = np.diff(np.searchsorted(end, np.cumsum(size) - 1, side="right"), prepend=0)
    count = np.maximum(words - SHINGLE + 1, 1)
    begin = np.cumsum(count) - count
    first = np.repeat(np.cumsum(words) - words - begin, count) + np.arange(count.sum())
    last = first + np.repeat(np.minimum(words, SHINGLE) - 1, count)
    return span_hashes(flat, start[first], end[last]), begin


def band_keys(texts: list[bytes]) -> np.ndarray:
    """(texts x bands) keys of the signatures of plain texts."""
    hashes, begin = doc_shingles(texts)
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    keys, work = np.empty((len(texts), BANDS), np.uint64), np.empty_like(h)
    for band in range(BANDS):
        key = np.full(len(texts), band + 1, np.uint64)
        for row in range(band * ROWS, (band + 1) * ROWS):
            np.bitwise_xor(h, _OFFSET[row], out=work)
            np.multiply(work, _MULTIPLIER[row], out=work)
            key = (key ^ np.minimum.reduceat(work, begin)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys.view(np.int64)


def table_keys(texts: list[bytes]) -> np.ndarray:
    """(texts x covering tables) keys of the fingerprints of plain texts."""
    prints = np.array([fingerprint(t) for t in texts], np.uint64)
    keys = ((prints[:, None] & _MASKS) ^ _TABLE) * np.uint64(0x9E3779B97F4A7C15)
    return (keys ^ (keys >> np.uint64(29))).view(np.int64)


def signatures():
    """Column function: key (of the plain text) and keys of the buckets (tables and bands) of a column of bytes."""

    @arrow_udf("struct<line:binary,bands:array<bigint>>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            own, bands = [], [np.empty(0, np.int64)]
            for block in blocks(column):
                texts = [plain(t) for t in block]
                own += [hashlib.md5(t).digest() for t in texts]
                bands.append(np.hstack([table_keys(texts), band_keys(texts)]).reshape(-1))
            at = pa.array(np.arange(len(own) + 1, dtype=np.int32) * (len(_MASKS) + BANDS))
            yield pa.StructArray.from_arrays(
                [pa.array(own, pa.binary()), pa.ListArray.from_arrays(at, pa.array(np.concatenate(bands)))], names=["line", "bands"])

    return made


def same_set(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Pairs that unite all texts whose similarity reaches the threshold: from a text to those similar to it, from
    these on to the ones not met yet."""
    if len(texts) < 2:
        return
    hashes, begin = doc_shingles([plain(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(begin, len(hashes))))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))
    found, number = np.unique(hashes[new], return_inverse=True)
    size = np.bincount(owner[new], minlength=len(texts))
    stop = np.cumsum(size)
    begin, (num, den) = stop - size, SIMILARITY
    mark = np.zeros(len(found), bool)
    left = np.arange(len(texts))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = left[(size[left] * den >= num * size[i]) & (size[i] * den >= num * size[left])]
            mark[number[begin[i] : stop[i]]] = True
            both = np.array([np.count_nonzero(mark[number[begin[j] : stop[j]]]) for j in near.tolist()], np.int64)
            mark[number[begin[i] : stop[i]]] = False
            near = near[both * den >= num * (size[near] + size[i] - both)] if len(near) else near
            yield from ((i, j) for j in near.tolist())
            queue += near.tolist()
            left = left[~np.isin(left, near)]


def near_copies(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) -> doc_id, row_key, line, component_id, keeper; line is the key of the text's
    words, the others are as in ``simhash.near_duplicates``.  Texts with equal words are always united, so null, empty
    and wordless texts are one group."""
    signed = signatures()(utf8(F.col("text")))
    rows = settled(docs.select("doc_id", row_key(docs).alias("row_key"), signed.alias("s")).select("doc_id", "row_key", "s.line", "s.bands"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    prints = settled(rows.groupBy("line").agg(first, F.first("bands").alias("bands")))
    groups = bucket_groups(prints.select(F.explode("bands").alias("band_key"), "line"), group)
    wanted = prints.join(groups.select("line").distinct(), "line", "left_semi").select("line", F.col("first.row_key").alias("own"))
    wanted = F.broadcast(wanted) if wanted.count() <= SMALL_KEYS else wanted
    texts = docs.select(row_key(docs).alias("own"), utf8(F.col("text")).alias("text")).join(wanted, "own")
    texts = texts.groupBy("line").agg(F.min("text").alias("text"))
    dealt = groups.join(texts, "line").select("group", "line", "text")
    dealt = dealt.repartition("group").sortWithinPartitions("group", "line")
    links = dealt.mapInArrow(verified(same_set), "a binary, b binary").distinct()
    return classed(rows.select("doc_id", "row_key", "line"), prints.select("line", "first"), components(links), "line")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every component (see near_copies), all columns kept, as
    ``simhash.drop_near_duplicates`` chooses it."""
    return keepers_of(docs, near_copies(docs))
