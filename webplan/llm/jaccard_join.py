"""Exact Jaccard join of documents on five-word shingles, by signature trees.

Which documents can link at all: shingles get one order for the whole corpus, rare ones first, by a table of fixed size
that counts them in hashed slots.  A document's first n - ceil(0.8 n) + 1 shingles in that order are its probes; two
linked documents have a probe in common.  Documents with a common probe and sizes near each other form a run, runs with
the same smallest document one group, so every pair that can link meets in some group.

Only small bitmaps of the documents travel to the groups at first: a tree over them tells which documents of a group may
have a link in it, and the texts of those follow.

Within a group: a signature tree.  Its leaves are documents with a bitmap of their shingles, ordered so that like ones
are neighbours; a node above holds the OR of the bitmaps, the least and greatest size, and how many shingles at most
share bits with others of their document.  Two nodes are taken together from the root down; a pair of nodes is cut off
when their common bits, with those extra shingles, cannot reach the overlap that the smallest sizes would need.  Pairs of
documents that are left and not yet united are compared in full.

A group beyond ``ROOM`` shingles is dealt in blocks that each also hold its first document.  Then only members still
apart from that document are compared with the other blocks, so a large group of copies costs what its blocks cost."""

from __future__ import annotations

from collections.abc import Iterator
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from webplan.llm.common import blocks, combined, row_key, stored, table_rows, utf8
from webplan.llm.components import components
from webplan.llm.lm_scoring import span_hashes
from webplan.llm.simhash import FOLD

SHINGLE, SIMILARITY = 5, (4, 5)
#: Slots in which the corpus's shingles are counted.
SLOTS = 1 << 18
#: Shingles of a group that are compared in one task; children of a tree's node; pairs taken together.
ROOM, WIDTH, PAIRS = 1 << 19, 8, 1 << 12
#: A document counts as this many shingles more, so that a task never holds too many short ones.
BASE = 256
#: Rows up to which the keys of wanted texts go to every task; beyond, texts are joined by shuffle.
SMALL_KEYS = 500_000


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles (64-bit hashes, ascending) of texts, text by text, and the size of each set; fewer than five
    words are one shingle, none have none."""
    plain = [b" ".join(t.translate(FOLD).split()) for t in texts]
    flat = np.frombuffer(b" ".join([*plain, b""]), np.uint8)
    end = np.flatnonzero(flat == 32)
    start = np.concatenate([[0], end[:-1] + 1]).astype(np.int64)
    words = np.diff(np.searchsorted(end, np.cumsum([len(t) + 1 for t in plain]) - 1, side="right"), prepend=0)
    empty = np.array([not t for t in plain])
    count = np.maximum(words - SHINGLE + 1, 1)
    begin = np.cumsum(count) - count
    first = np.repeat(np.cumsum(words) - words - begin, count) + np.arange(count.sum())
    owner = np.repeat(np.arange(len(texts)), count)
    hashes = span_hashes(flat, start[first], end[first + np.repeat(np.minimum(words, SHINGLE) - 1, count)])
    full = ~empty[owner]
    hashes, owner = hashes[full], owner[full]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))[: len(hashes)]
    return hashes[new], np.bincount(owner[new], minlength=len(texts))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(46)).astype(np.int64)


def map_bits(n: int, each: int = 2) -> int:
    """Bits of the bitmap of n shingles: a power of two, ``each`` or more a shingle up to a bound."""
    return min(1 << 15, max(64, 1 << (each * n - 1).bit_length()))


def bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap of shingles, as bytes; folded in halves it is that of half as many bits."""
    held = np.zeros(bits, bool)
    held[((hashes >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(held, bitorder="little")


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for block in blocks(batch.column(0)):
            table += np.bincount(_slot(shingle_sets(block)[0]), minlength=SLOTS)
    yield from table_rows(table)


def _sets(counts):
    """Column function: key of the set, its size, its bitmap, and its probes."""

    @arrow_udf("struct<key:binary,n:bigint,map:binary,probes:array<bigint>>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = counts.value
        for column in batches:
            keys, maps, sizes, found, many = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for block in blocks(column):
                hashes, n = shingle_sets(block)
                stop = np.cumsum(n)
                keys += [hashlib.md5(hashes[a:b].tobytes()).digest() for a, b in zip(stop - n, stop)]
                maps += [bitmap(hashes[a:b], map_bits(b - a)).tobytes() for a, b in zip((stop - n).tolist(), stop.tolist())]
                order = np.lexsort((hashes, table[_slot(hashes)], np.repeat(np.arange(len(n)), n)))
                num, den = SIMILARITY
                probes = np.where(n > 0, n - -(-num * n // den) + 1, 0)
                at = np.repeat(stop - n - np.cumsum(probes) + probes, probes) + np.arange(probes.sum())
                sizes.append(n)
                many.append(probes)
                found.append(hashes[order[at]].view(np.int64))
            edge = np.concatenate([[0], np.cumsum(np.concatenate(many))]).astype(np.int32)
            yield pa.StructArray.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(np.concatenate(sizes)), pa.array(maps, pa.binary()), pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(found)))],
                names=["key", "n", "map", "probes"])

    return made


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (probe, n, id) in their order -> (head, id, n): the members of every run of at least two, with its first.

    A run ends where the probe changes or the next size is too great for any link across the gap."""
    num, den = SIMILARITY
    p0 = n0 = None
    head0, size0, told = 0, 0, True  # first of the run that is still open, and whether it was passed on
    for batch in batches:
        if not batch.num_rows:
            continue
        p, n, i = (np.asarray(batch.column(k)).astype(np.int64) for k in range(3))
        first = np.empty(len(p), bool)
        first[1:] = (p[1:] != p[:-1]) | (n[1:] * num > n[:-1] * den)
        first[0] = p0 is None or p[0] != p0 or n[0] * num > n0 * den
        start = np.flatnonzero(first)
        at = np.maximum.accumulate(np.where(first, np.arange(len(p)), -1))
        head = np.where(at < 0, head0, i[np.maximum(at, 0)])
        alone = np.append(first[1:], True)[start]  # a first row that the next row does not follow
        out = [(head[~first], i[~first], n[~first]), (i[start[~alone]], i[start[~alone]], n[start[~alone]])]
        if not first[0] and not told:
            out.append(([head0], [head0], [size0]))
            told = True
        if len(start):
            head0, size0, told = int(i[start[-1]]), int(n[start[-1]]), not alone[-1]
        p0, n0 = p[-1], n[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out]).astype(np.int64)) for k in range(3)], names=["head", "id", "n"])


# ---------------------------------------------------------------- trees


class Tree:
    """A signature tree over sets of shingles, given by bitmaps of equal width (as rows of bytes) and sizes."""

    def __init__(self, maps: np.ndarray, size: np.ndarray):
        maps = np.ascontiguousarray(maps).view(np.uint64)
        # like sets are neighbours
        self.order = np.lexsort((maps[:, -1], maps[:, 0], size))
        maps, size = maps[self.order], size[self.order]
        #: levels from the documents up: bitmaps, least and greatest size, most shingles beyond one a bit
        self.levels = [(maps, size, size, size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            maps, least, most, extra = self.levels[-1]
            at = np.arange(0, len(maps), WIDTH)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.maximum.reduceat(extra, at)))

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> "Tree":
        size = np.array([len(x) for x in sets], np.int64)
        bits = map_bits(int(np.median(size)), 4)
        return cls(np.stack([bitmap(x, bits) for x in sets]), size)

    def possible(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of nodes may hold a link."""
        maps, least, most, extra = self.levels[level]
        num, den = SIMILARITY
        small = (least[x] * num <= most[y] * den) & (least[y] * num <= most[x] * den)
        both = np.zeros(len(x), np.int64)
        at = np.flatnonzero(small)
        both[at] = np.bitwise_count(maps[x[at]] & maps[y[at]]).sum(axis=1, dtype=np.int64)
        both = np.minimum(both + np.minimum(extra[x], extra[y]), np.minimum(most[x], most[y]))
        # a pair links when (num + den) times the overlap reaches num times both sizes
        return small & ((num + den) * both >= num * (least[x] + least[y]))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of documents (places in the given order) that the tree does not rule out, some at a time."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, x, y = stack.pop()
            ok = self.possible(level, x, y) if level else self.possible(0, x, y) & (x != y)
            x, y = x[ok], y[ok]
            if not len(x):
                continue
            if not level:
                yield self.order[x], self.order[y]
                continue
            room = len(self.levels[level - 1][0])
            i, j = (k.ravel() for k in np.meshgrid(np.arange(WIDTH), np.arange(WIDTH), indexing="ij"))
            a, b = (x[:, None] * WIDTH + i).ravel(), (y[:, None] * WIDTH + j).ravel()
            ok = (a < room) & (b < room) & (a <= b)
            a, b = a[ok], b[ok]
            for at in range(len(a) - len(a) % PAIRS, -1, -PAIRS):
                if at < len(a):
                    stack.append((level - 1, a[at : at + PAIRS], b[at : at + PAIRS]))


def linked(sets: list[np.ndarray], label: np.ndarray, far: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Links that unite all sets whose similarity reaches the threshold and whose labels differ.  far: sides; sets of
    side 0 are not compared with each other."""
    label = label.copy()
    num, den = SIMILARITY
    for x, y in Tree.of(sets).pairs() if len(sets) > 1 else []:
        ok = label[x] != label[y]
        if far is not None:
            ok &= (far[x] != 0) | (far[y] != 0)
        for i, j in zip(x[ok].tolist(), y[ok].tolist()):
            if label[i] == label[j]:
                continue
            own, other = sets[i], sets[j]
            at = np.searchsorted(own, other)
            at[at == len(own)] = 0
            both = int(np.count_nonzero(own[at] == other))
            if both * den >= num * (len(own) + len(other) - both):
                label[label == label[j]] = label[i]
                yield i, j


def _sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, id, side, label, n, map) in the order of group and id -> group, id, side, label of the documents that
    may have a link in their group.

    Bitmaps of two widths that follow each other are taken together, the wider folded; links never span more."""
    held, rows = None, []

    def close() -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        size, side, label = (np.array([r[k] for r in rows], np.int64) for k in (3, 1, 2))
        wide, keep = np.array([len(r[4]) for r in rows]), np.zeros(len(rows), bool)
        for width in np.unique(wide).tolist():
            at = np.flatnonzero((wide == width) | (wide == 2 * width))
            if len(at) < 2:
                continue
            maps = np.empty((len(at), width), np.uint8)
            for k, i in enumerate(at.tolist()):
                own = np.frombuffer(rows[i][4], np.uint8)
                maps[k] = own if len(own) == width else own[:width] | own[width:]
            for x, y in Tree(maps, size[at]).pairs():
                x, y = at[x], at[y]
                ok = (label[x] != label[y]) & ((side[x] != 0) | (side[y] != 0)) & ((wide[x] == width) | (wide[y] == width))
                keep[x[ok]] = keep[y[ok]] = True
        left = [rows[i] for i in np.flatnonzero(keep).tolist()]
        if left:
            yield pa.RecordBatch.from_arrays(
                [pa.array([held] * len(left)), *[pa.array([r[k] for r in left], t) for k, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int64()))]],
                names=["group", "id", "side", "label"])

    for batch in batches:
        for group, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if group != held:
                yield from close()
                held, rows = group, []
            if not rows or rows[-1][0] != row[0]:
                rows.append(row)
    yield from close()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, id, side, label, text) in the order of group and id -> links (a, b) of ids."""
    held, ids, sides, labels, texts = None, [], [], [], []

    def close() -> Iterator[pa.RecordBatch]:
        if len(ids) > 1:
            sets: list[np.ndarray] = []
            for block in blocks(pa.array(texts, pa.binary())):
                hashes, n = shingle_sets(block)
                sets += np.split(hashes, np.cumsum(n)[:-1])
            _, label = np.unique(np.array(labels, np.int64), return_inverse=True)
            links = list(linked(sets, label, np.array(sides)))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in links]), pa.array([ids[j] for _, j in links])], names=["a", "b"])

    for batch in batches:
        for group, i, side, label, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if group != held:
                yield from close()
                held, ids, sides, labels, texts = group, [], [], [], []
            if not ids or ids[-1] != i:
                ids.append(i)
                sides.append(side)
                labels.append(label)
                texts.append(text)
    yield from close()


# ---------------------------------------------------------------- the join


def _texts_of(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text for every wanted id: id, text."""
    spot = sets.join(wanted, "id", "left_semi").select("id", F.col("first.row_key").alias("__key"), F.col("first.doc_id").alias("__doc"))
    spot = F.broadcast(spot) if spot.count() <= SMALL_KEYS else spot
    rows = docs.select(row_key(docs).alias("__row"), F.col("doc_id").alias("__own"), utf8(F.col("text")).alias("text"))
    found = rows.join(spot, (F.col("__row") == F.col("__key")) & F.col("__own").eqNullSafe(F.col("__doc"))).select("id", "text")
    return found.groupBy("id").agg(F.min("text").alias("text"))


def _links(docs: DataFrame, sets: DataFrame, dealt: DataFrame) -> DataFrame:
    """dealt (group, id, side, label) -> stored links (a, b) of ids, by the documents that a group's bitmaps leave."""
    order = ["group", "id", F.desc("side")]
    rows = dealt.join(sets.select("id", "n", "map"), "id").select("group", "id", "side", "label", "n", "map")
    left = stored(rows.repartition("group").sortWithinPartitions(*order).mapInArrow(_sifted, "group string, id bigint, side int, label bigint"))
    texts = _texts_of(docs, sets, left.select("id").distinct())
    rows = left.join(texts, "id").select("group", "id", "side", "label", "text")
    return stored(rows.repartition("group").sortWithinPartitions(*order).mapInArrow(_compared, "a bigint, b bigint").distinct())


def set_links(docs: DataFrame, sets: DataFrame, room: int = ROOM) -> DataFrame:
    """sets (id, n, map, probes, first) of ``docs`` -> links (a, b) of ids that unite exactly what links at the threshold unite."""
    probes = sets.filter("n > 0").select(F.explode("probes").alias("probe"), "n", "id")
    runs = probes.repartition("probe").sortWithinPartitions("probe", "n", "id").mapInArrow(_runs, "head bigint, id bigint, n bigint")
    members = stored(runs.distinct())
    sizes = members.groupBy("head").agg(F.sum(F.col("n") + BASE).alias("total"))
    sizes = stored(sizes.select("head", F.ceil(F.col("total") / room).alias("blocks")))
    large = sizes.filter("blocks > 1")
    # groups of one block as they are; larger ones in blocks that also hold the first member
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    none = [F.lit(2).alias("side"), F.col("id").alias("label")]
    placed = members.join(large, "head", "left").withColumn("block", F.when(F.col("id") == F.col("head"), F.lit(None)).otherwise(F.coalesce(block, F.lit(0))))
    heads = sizes.select("head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("head").alias("id"))
    near = placed.filter("block is not null").select("head", "block", "id").unionByName(heads)
    near = _links(docs, sets, near.select(F.concat_ws(":", "head", "block").alias("group"), "id", *none))
    if large.isEmpty():
        return near
    # members of large groups that are still apart from the first one meet the other blocks
    found = stored(components(near))
    root = found.select(F.col("node").alias("id"), "root")
    told = placed.filter("blocks > 1").join(root, "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")
    top = large.join(root.withColumnRenamed("id", "head"), "head", "left").select(F.col("head").alias("h"), F.coalesce("root", "head").alias("top"))
    told = told.join(top, F.col("head") == F.col("h")).withColumn("block", F.coalesce("block", F.pmod(F.xxhash64("id"), F.col("blocks"))))
    apart = stored(told.filter("label <> top").select("head", "id", "label", "blocks", F.col("block").alias("own"), "n"))
    few = apart.groupBy("head").agg(F.ceil(F.sum(F.col("n") + BASE) / room).alias("parts"))
    some = apart.join(few, "head").withColumn("part", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("parts")))
    left = some.select("head", "part", "id", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    right = told.join(few, "head").select("head", "block", "id", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    both = left.withColumn("side", F.lit(1)).unionByName(right.withColumn("side", F.lit(0)))
    far = _links(docs, sets, both.select(F.concat_ws(":", "head", "block", "part").alias("group"), "id", "side", "label"))
    return near.unionByName(far).distinct()


def jaccard_classes(docs: DataFrame, room: int = ROOM) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles (size of its set), component_id (smallest doc_id
    reachable over links of similarity 0.8 or more, itself included).

    A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``; fewer than five are one shingle.  Equal sets are always
    linked, but for empty ones: null, empty and wordless texts have 0 shingles and are linked with nothing.  A null doc_id
    is its own component_id only where its component has no other.  Repeated rows share all values.  Other columns are
    left out.  An empty table gives an empty result."""
    text = utf8(F.col("text"))
    counts = combined(docs.select(text.alias("text")).filter("text is not null").mapInArrow(_tally, "part int, cells binary"), SLOTS, np.int64)
    made = _sets(docs.sparkSession.sparkContext.broadcast(counts))
    rows = docs.select("doc_id", row_key(docs).alias("row_key"), made(text).alias("s"))
    rows = stored(rows.select("doc_id", "row_key", "s.key", "s.n", "s.map", "s.probes"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    sets = rows.filter("n > 0").groupBy("key").agg(first, F.min("n").alias("n"), F.any_value("map").alias("map"), F.any_value("probes").alias("probes"))
    sets = stored(sets.withColumn("id", F.monotonically_increasing_id()))
    found = components(set_links(docs, sets, room))
    rooted = stored(sets.join(found, F.col("id") == F.col("node"), "left").select("key", F.coalesce("root", "id").alias("root"), "first"))
    tops = rooted.groupBy("root").agg(F.min("first").alias("top")).select(F.col("root").alias("r"), F.col("top.doc_id").alias("component_id"))
    classes = rooted.join(tops, F.col("root") == F.col("r")).select(F.col("key").alias("k"), "component_id", F.lit(True).alias("known"))
    out = rows.select("doc_id", "key", "n").join(classes, F.col("key") == F.col("k"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
