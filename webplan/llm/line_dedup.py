"""Fuzzy line deduplication by MinHash.

Signatures of character shingles are cut into bands; lines that share a band are compared by their exact Jaccard
similarity, and those at or above the threshold are united.  One line of each component stays: its first occurrence.

Only band keys and 8-byte hashes of lines travel while candidates are sought, packed by slots of keys; lines that share a
hash are told apart as soon as their texts are there.  Lines that meet in a band form a group; equal groups of different
bands are compared once, and a bucket of more than ``GROUP`` lines is compared block by block.  Sketches of their shingles
tell which lines of a group may be similar.  The lines that these link, directly or by others, get their texts once, in
one place, and are compared there; in a set of more than ``GROUP`` lines, those that a group links are.  The bitmaps that
pick sketches and texts are of a fixed size and prune less as the corpus grows."""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, ByteType, IntegerType, StructField, StructType
from pyspark.sql.window import Window as W

from webplan.llm.common import CELLS, blocks, combined, discard, stored, table_rows, utf8
from webplan.llm.components import components

#: Characters of a shingle; bands and rows: a pair at 0.8 meets with probability 0.997, one at 0.9 with 1 - 2e-8.
SHINGLE, BANDS, ROWS, SIMILARITY = 4, 32, 8, (4, 5)
GROUP = 1024
#: Groups of more lines than this are sifted on bitmaps of so many bits; shingles held at once while comparing.
FEW, BITS, HELD = 3, 2048, 2_000_000
#: Least bits of the sketches that go to the groups before any text; bits of the bitmaps that pick sketches and texts to follow.
SIFT, PICK = 64, 1 << 25
#: Lines whose signatures, and whose bitmaps, are made at once.
SIGNED, MAPPED = 512, 512
#: Slots of band keys; entries (band key, line) that a task packs at once, and lines it knows before it starts anew.
SLOTS, PACKED, KNOWN = 1 << 12, 1 << 19, 1 << 17
_ENTRY = np.dtype([("key", "<u4"), ("line", "<u8")])
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Keys of candidate rows up to which ``near_copies`` sends them to every task.
SMALL_KEYS = 500_000
_RANDOM = np.random.default_rng(20)
#: Each gives four rows: the least and the greatest product, unsigned and signed, that is the shingles next to two opposite points of a circle.
_MULTIPLIER = (_RANDOM.integers(1 << 32, size=BANDS * ROWS // 4, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def characters(line: bytes) -> str:
    return line.decode("utf-8", "replace")


def line_shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles of UTF-8 lines, and where each line's begin; a short line is one shingle."""
    lines = [characters(x) for x in lines]
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    room = np.maximum(size, SHINGLE)
    flat = np.frombuffer("".join(x.ljust(SHINGLE, "\0") for x in lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(flat) - SHINGLE + 1
    h = np.zeros(n, np.uint32)
    for i in range(SHINGLE):
        h *= np.uint32(0x01000193)
        h += flat[i : i + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    count = room - SHINGLE + 1
    begin = np.cumsum(room) - room
    keep = np.ones(len(flat), bool)
    for i in range(1, SHINGLE):
        keep[begin + room - i] = False
    return h[keep[:n]], np.cumsum(count) - count


def band_keys(lines: list[bytes]) -> np.ndarray:
    """(lines x bands) keys of the signatures."""
    keys = np.empty((len(lines), BANDS), np.uint64)
    for at in range(0, len(lines), SIGNED):
        h, begin = line_shingles(lines[at : at + SIGNED])
        rows = np.empty((BANDS * ROWS, len(begin)), np.uint32)
        work = np.empty_like(h)
        for i, multiplier in enumerate(_MULTIPLIER):
            np.multiply(h, multiplier, out=work)
            for k, (view, own) in enumerate(((work, rows), (work.view(np.int32), rows.view(np.int32)))):
                np.minimum.reduceat(view, begin, out=own[4 * i + 2 * k])
                np.maximum.reduceat(view, begin, out=own[4 * i + 2 * k + 1])
        rows = rows.reshape(BANDS, ROWS, -1)
        key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(begin), axis=1)
        for row in range(ROWS):
            key = (key ^ rows[:, row]) * _MIX
            key ^= key >> np.uint64(29)
        keys[at : at + SIGNED] = key.T
    return keys.view(np.int64)


def line_hash(line: bytes) -> int:
    """As ``xxhash64`` of Spark has it."""
    return xxhash.xxh64_intdigest(line, 42)


def _distinct_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Texts -> the different lines of a block that are not blank, and their hashes."""
    for batch in batches:
        for block in blocks(batch.column(0)):
            lines = list({x for text in block for x in text.split(b"\n") if x.strip()})
            if lines:
                yield lines, np.fromiter(map(line_hash, lines), np.uint64, len(lines))


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> slot, entries: the band keys of that slot of every different line that is not blank, with the lines, packed."""
    known, keys, owners, n = set(), [], [], 0

    def packed() -> pa.RecordBatch:
        key, own = np.concatenate(keys).view(np.uint64).reshape(-1), np.repeat(np.concatenate(owners), BANDS)
        slot = (key >> np.uint64(52)).astype(np.uint16)
        order = np.argsort(slot, kind="stable")
        entries = np.empty(len(key), _ENTRY)
        entries["key"], entries["line"] = (key >> np.uint64(20)).astype(np.uint32)[order], own[order]
        count = np.bincount(slot, minlength=SLOTS)
        full = np.flatnonzero(count)
        at = np.append(0, np.cumsum(count[full])) * _ENTRY.itemsize
        rows = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(entries.view(np.uint8))])
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), rows], names=["slot", "entries"])

    for lines, own in _distinct_lines(batches):
        new = [i for i, x in enumerate(own.tolist()) if x not in known]
        known = set() if len(known) > KNOWN else known
        known.update(own[new].tolist())
        for at in range(0, len(new), PACKED // BANDS):
            some = new[at : at + PACKED // BANDS]
            keys.append(band_keys([lines[i] for i in some]))
            owners.append(own[some])
            n += keys[-1].size
            if n >= PACKED:
                yield packed()
                keys, owners, n = [], [], 0
    if n:
        yield packed()


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _met(slot: int, entries: np.ndarray, group: int) -> pa.RecordBatch:
    """The entries of a slot -> (group, line): different lines that share a band key.  Buckets with the same lines are told
    once, under an odd number made of these; the pairs of blocks of a large bucket have even numbers."""
    key, line = np.ascontiguousarray(entries["key"]), np.ascontiguousarray(entries["line"])
    order = np.argsort(key)
    size = np.diff(np.append(_runs(key[order]), len(order)))
    order = order[np.repeat(size > 1, size)]
    key, line = key[order], line[order]
    order = np.lexsort((line, key))
    key, line = key[order], line[order]
    one = _runs(key, line)
    key, line = key[one], line[one]
    begin = _runs(key)
    size = np.diff(np.append(begin, len(key)))
    mixed = line * _MIX
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
    number = (np.add.reduceat(mixed, begin) if len(begin) else mixed) * _MIX | np.uint64(1)
    first = np.zeros(len(begin), bool)
    small = np.flatnonzero((size > 1) & (size <= group))
    first[small[np.unique(number[small], return_index=True)[1]]] = True
    told = np.repeat(first, size)
    groups, lines = [np.repeat(number[first], size[first])], [line[told]]
    for at in np.flatnonzero(size > group).tolist():
        own = line[begin[at] : begin[at] + size[at]]
        blocks_of = -(-len(own) // group)
        mine, other = np.repeat(np.arange(len(own)) // group, blocks_of), np.tile(np.arange(blocks_of), len(own))
        name = (np.minimum(mine, other) * blocks_of + np.maximum(mine, other)).astype(np.uint64)
        name = (name ^ number[at] ^ (np.uint64(slot) << np.uint64(32) | np.uint64(key[begin[at]])) * _MIX) * _MIX
        groups.append((name ^ (name >> np.uint64(29))) * _MIX & ~np.uint64(1))
        lines.append(np.repeat(own, blocks_of))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(groups).view(np.int64)), pa.array(np.concatenate(lines).view(np.int64))], names=["group", "line"])


def _grouped(group: int):
    """Rows (slot, entries) in the order of their slot -> (group, line), slot by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []
        for batch in batches:
            for slot, entries in zip(batch.column(0).to_pylist(), batch.column(1)):
                if slot != held:
                    if parts:
                        yield _met(held, np.concatenate(parts), group)
                    held, parts = slot, []
                parts.append(np.frombuffer(entries.as_buffer(), _ENTRY).copy())
        if parts:
            yield _met(held, np.concatenate(parts), group)

    return run


#: What a task tells of a line's occurrence: blank; the first it has met, or at the same spot; or later than another.
BLANK, FIRST, LATER = 0, 1, 2


def lines_of(docs: DataFrame) -> DataFrame:
    """Documents -> doc_id, line_no, line (16-byte key; null for a blank line), state: one row per line.  A line has no more
    rows with the state FIRST than tasks have met it, so that a common one does not pile up."""
    kind = docs.schema["doc_id"].dataType
    out = StructType([StructField("doc_id", kind), StructField("line_no", IntegerType()), StructField("line", BinaryType()), StructField("state", ByteType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, rows, own = {}, [], pa.null()

        def emit() -> pa.RecordBatch:
            ids, numbers, keys, states = zip(*rows)
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, own), pa.array(numbers, pa.int32()), pa.array(keys, pa.binary()), pa.array(states, pa.int8())],
                names=["doc_id", "line_no", "line", "state"])

        def tell(state: int, key: bytes, spot: tuple, times: int) -> None:
            rows.extend([(spot[1], spot[2], key, state)] * times)

        for batch in batches:
            own = batch.column(0).type
            texts = (x.as_py() for x in batch.column(1))
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                none = doc_id is None
                for number, line in enumerate(text.split(b"\n")) if text is not None else ():
                    if not line.strip():
                        rows.append((doc_id, number, None, BLANK))
                        continue
                    key, spot = hashlib.md5(line).digest(), (none, doc_id, number)
                    met = firsts.get(key)
                    if met is None:
                        firsts[key] = spot, 1
                    elif met[0] == spot:
                        firsts[key] = spot, met[1] + 1
                    elif met[0][0] < none or met[0][0] == none and (met[0][2] < number if none or met[0][1] == doc_id else met[0][1] < doc_id):
                        rows.append((doc_id, number, key, LATER))
                    else:
                        tell(LATER, key, *met)
                        firsts[key] = spot, 1
                if len(firsts) > KNOWN:
                    for key, met in firsts.items():
                        tell(FIRST, key, *met)
                    firsts = {}
                if len(rows) >= 1 << 14:
                    yield emit()
        for key, met in firsts.items():
            tell(FIRST, key, *met)
            if len(rows) >= 1 << 14:
                yield emit()
        if rows:
            yield emit()

    return docs.select("doc_id", utf8(F.col("text")).alias("text")).mapInArrow(run, out)


def _plain(line: str) -> bool:
    """Whether every character has a 16-bit code, with one left for none."""
    return line.isascii() or len(line.encode("utf-16-le", "surrogatepass")) == 2 * len(line) and "\uffff" not in line


class _Lines:
    """The lines of a group, and which of them reach the threshold.

    Every shingle sets one of ``BITS`` bits of its line. A bit in which two bitmaps differ needs a shingle that only one
    of the lines has, and a similarity of 0.8 leaves at most a ninth of both lines' shingles to differ; pairs beyond
    that are ruled out on bitmaps, all others are compared in full."""

    def __init__(self, lines: list[bytes]):
        self.lines, self.sets, self.held = [characters(x) for x in lines], {}, 0
        self.room = np.array([max(1, len(x) - SHINGLE + 1) for x in self.lines])
        self.maps, self.rank = None, None
        if not all(map(_plain, self.lines)):
            # ranks of the characters that occur, from 1 on; more than 16 bits of them are compared as strings
            self.rank = {ord(x): i for i, x in enumerate(sorted(set().union(*self.lines)), 1)}
        if len(lines) > FEW:
            h, begin = line_shingles(lines)
            owner = np.repeat(np.arange(len(lines)), np.diff(np.append(begin, len(h))))
            bits = np.zeros((len(lines), BITS), bool)
            bits[owner, h & np.uint32(BITS - 1)] = True
            self.maps = np.packbits(bits, axis=1).view(np.uint64)

    def shingles(self, i: int) -> np.ndarray:
        """The different shingles of a line, sorted: the 16-bit numbers of their characters, 0 behind the end of a short line."""
        if i not in self.sets:
            if self.held > HELD:
                self.sets, self.held = {}, 0
            x, n = self.lines[i], int(self.room[i])
            if self.rank is None:
                at = np.frombuffer(x.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64) + np.uint64(1)
            elif len(self.rank) < 1 << 16:
                at = np.array([self.rank[ord(c)] for c in x], np.uint64)
            else:
                at = None
            if at is None:
                own = np.unique(np.array([x[k : k + SHINGLE].encode("utf-32-le", "surrogatepass") for k in range(n)], object))
            else:
                if len(at) < SHINGLE:
                    at = np.append(at, np.zeros(SHINGLE - len(at), np.uint64))
                own = at[:n].copy()
                for k in range(1, SHINGLE):
                    own <<= np.uint64(16)
                    own |= at[k : k + n]
                own.sort()
                own = own[_runs(own)]
            self.sets[i] = own
            self.held += len(own)
        return self.sets[i]

    def possible(self, i: int, others: np.ndarray) -> np.ndarray:
        if self.maps is None:
            return others
        num, den = SIMILARITY
        differ = np.bitwise_count(self.maps[others] ^ self.maps[i]).sum(axis=1, dtype=np.int64)
        return others[differ * (num + den) <= (den - num) * (self.room[others] + self.room[i])]

    def similar(self, i: int, j: int) -> bool:
        a, b = self.shingles(i), self.shingles(j)
        num, den = SIMILARITY
        if min(len(a), len(b)) * den < num * max(len(a), len(b)):
            return False
        met = np.concatenate([a, b])
        met.sort(kind="stable")  # merges the two
        both = np.count_nonzero(met[1:] == met[:-1])
        return both * den >= num * (len(a) + len(b) - both)


def _same_set(lines: list[bytes]) -> Iterator[tuple[int, int]]:
    """Pairs that unite all lines of a list whose exact Jaccard similarity reaches the threshold: from a line to those
    similar to it, from these on to the ones not met yet."""
    if len(lines) < 2:
        return
    group, left = _Lines(lines), np.arange(len(lines))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            found = [j for j in group.possible(i, left).tolist() if group.similar(i, j)]
            if found:
                yield from ((i, j) for j in found)
                queue += found
                left = np.setdiff1d(left, found, assume_unique=True) if len(left) > len(found) else left[:0]


def verified(same_set):
    """Rows (group, line, text) in the order of their group -> links (a, b) of lines, as ``same_set`` unites a group's texts."""
    return lambda batches: _verified(batches, same_set)


def _verified(batches: Iterator[pa.RecordBatch], same_set) -> Iterator[pa.RecordBatch]:
    held, keys, texts, links = None, [], [], []

    def close():
        links.extend((keys[i], keys[j]) for i, j in same_set(texts))

    def emit():
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in links], pa.binary()), pa.array([x[1] for x in links], pa.binary())], names=["a", "b"])

    for batch in batches:
        for group, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if group != held:
                close()
                held, keys, texts = group, [], []
            if not keys or keys[-1] != key:
                keys.append(key)
                texts.append(text)
        if links:
            yield emit()
            links.clear()
    close()
    if links:
        yield emit()


def _marked(own: np.ndarray, marks: np.ndarray) -> np.ndarray:
    at = own % np.uint64(PICK)
    return np.flatnonzero(marks[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)


def _mapped(batches: Iterator[pa.RecordBatch], shared=None) -> Iterator[pa.RecordBatch]:
    """Texts -> line, room (shingles, repeats included), map (sketch) of every different line of a block that is not blank,
    and marked in the bitmap if there is one.

    A sketch is the bitmap of ``_Lines`` folded by exclusive or to about as many bits as the line has shingles: every shingle
    that only one of two lines has changes one of its bits at most, so that sketches rule out what bitmaps do."""
    for lines, own in _distinct_lines(batches):
        if shared is not None:
            keep = _marked(own, shared.value)
            lines, own = [lines[i] for i in keep.tolist()], own[keep]
        for at in range(0, len(lines), MAPPED):
            some = lines[at : at + MAPPED]
            h, begin = line_shingles(some)
            room = np.diff(np.append(begin, len(h)))
            bits = np.zeros((len(some), BITS), bool)
            bits[np.repeat(np.arange(len(some)), room), h & np.uint32(BITS - 1)] = True
            bits = np.packbits(bits, axis=1)
            width, maps = _width(room), np.empty(len(some), object)
            for w in np.unique(width).tolist():
                of = np.flatnonzero(width == w)
                for i, m in zip(of.tolist(), np.bitwise_xor.reduce(bits[of].reshape(len(of), -1, w >> 3), axis=1)):
                    maps[i] = m.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[at : at + MAPPED].view(np.int64)), pa.array(room.astype(np.int32)), pa.array(list(maps), pa.binary())],
                names=["line", "room", "map"])


def _width(room: np.ndarray) -> np.ndarray:
    """Bits of the sketch of a line with so many shingles: the next power of two."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(room, 1))).astype(np.int64), SIFT, BITS)


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (of every row, the first row united with it) after the rows ``a`` and ``b`` are united."""
    while len(a):
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, line, room, map) in the order of group and line -> (a, b, name): for the lines that a sketch of another line of
    the group leaves possible, the first line that they are linked with by such sketches, and the line itself.  Groups (odd
    numbers) are named by that first line: it is in ``BANDS`` buckets at most, so that one name stays bounded; blocks of large
    buckets (even numbers) keep theirs.  A row is compared
    with the next one, the one after, and so on, for all groups of a batch at once, unless they are linked; the last group waits
    for the next batch.  Of two sketches, the longer is folded to the length of the shorter."""
    num, den = SIMILARITY
    held = None

    def sift(rows: pa.RecordBatch) -> pa.RecordBatch:
        group, line = (np.asarray(rows.column(i)) for i in (0, 1))
        room, at, label = np.asarray(rows.column(2)).astype(np.int64), np.arange(len(group)), np.arange(len(group))
        width, raw, folds, above = _width(room), rows.column(3).to_pylist(), {}, None
        for w in range(BITS.bit_length() - 1, SIFT.bit_length() - 2, -1):  # sketches of 1 << w bits, own ones and folded ones
            own = np.flatnonzero(width == 1 << w)
            maps = np.frombuffer(bytearray().join(raw[i] for i in own.tolist()), np.uint64).reshape(len(own), (1 << w) >> 6)
            if above is not None:
                of, longer = above
                folded = np.bitwise_xor.reduce(longer.reshape(len(of), 2, maps.shape[1]), axis=1)
                own, maps = np.concatenate([of, own]), np.concatenate([folded, maps])
            place = np.zeros(len(group), np.int64)
            place[own] = np.arange(len(own))
            folds[1 << w] = place, maps
            above = own, maps
        for step in range(1, len(group)):
            at = at[at + step < len(group)]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            told = at[label[at] != label[at + step]]
            if not len(told):
                continue
            both, ok = np.minimum(width[told], width[told + step]), []
            for w in np.unique(both).tolist():
                some, (place, maps) = told[both == w], folds[w]
                differ = np.bitwise_count(maps[place[some]] ^ maps[place[some + step]]).sum(axis=1, dtype=np.int64)
                ok.append(some[differ * (num + den) <= (den - num) * (room[some] + room[some + step])])
            found = np.concatenate(ok)
            label = _united(label, found, found + step)
        linked = np.bincount(label, minlength=len(label))[label] > 1
        head, group = line[label[linked]], group[linked]
        return pa.RecordBatch.from_arrays([pa.array(head), pa.array(line[linked]), pa.array(np.where(group & 1, head | 1, group))], names=["a", "b", "name"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        group = np.asarray(batch.column(0))
        first = int(np.flatnonzero(group != group[-1])[-1]) + 1 if (group != group[-1]).any() else 0
        held = batch.slice(first)
        if first:
            yield sift(batch.slice(0, first))
    if held is not None:
        yield sift(held)


def bucket_groups(banded: DataFrame, group: int) -> DataFrame:
    """(band_key, line) -> (group, line): lines to compare with each other, so that all pairs that share a band meet."""
    bucket = W.partitionBy("band_key")
    ranked = banded.withColumn("at", F.dense_rank().over(bucket.orderBy("line"))).withColumn("n", F.max("at").over(bucket))
    shared = stored(ranked.filter("n > 1").select("band_key", "line", "at", "n").distinct())
    small = shared.filter(F.col("n") <= group).groupBy("band_key").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    small = small.groupBy(F.md5(F.array_join(F.transform("lines", F.hex), "").cast("binary")).alias("group")).agg(
        F.first("lines").alias("lines")).select("group", F.explode("lines").alias("line"))
    last = F.floor((F.col("n") - 1) / group)
    large = (
        shared.filter(F.col("n") > group).withColumn("own", F.floor((F.col("at") - 1) / group))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .select(F.concat_ws(":", "band_key", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "line")
    )
    groups = stored(small.unionByName(large))
    discard(shared)
    return groups


def _picked(lines: DataFrame) -> np.ndarray:
    """A bitmap in which the hashes of ``lines`` (line) are marked: of a fixed size, whatever the corpus."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(PICK >> 3, np.uint8)
        for batch in batches:
            at = np.asarray(batch.column(0)).astype(np.uint64)
            np.bitwise_or.at(marks, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7), dtype=np.uint8, casting="unsafe"))
        yield from table_rows(marks)

    # every task gets the marks of whole cells, so that there is one row a cell
    spots = lines.select(F.col("line").bitwiseAND(F.lit(PICK - 1)).alias("spot"))
    spots = spots.repartition(F.shiftright("spot", (CELLS << 3).bit_length() - 1))
    return combined(spots.mapInArrow(mark, "part int, cells binary"), PICK >> 3, np.uint8, np.bitwise_or)


def _texts_of(shared):
    """Texts -> (line, text) of every different line of a block that is marked in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for lines, own in _distinct_lines(batches):
            keep = _marked(own, marks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[keep].view(np.int64)), pa.array([lines[i] for i in keep.tolist()], pa.binary())], names=["line", "text"])

    return run


def similar_lines(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """Documents -> links (a, b) of line keys that unite all pairs of different lines which share a band and whose
    similarity reaches the threshold."""
    sc, texts = docs.sparkSession.sparkContext, docs.select(utf8(F.col("text")).alias("text"))
    slots = texts.mapInArrow(_banded, "slot int, entries binary").repartition("slot").sortWithinPartitions("slot")
    groups = stored(slots.mapInArrow(_grouped(group), "group bigint, line bigint"))
    # sketches go to the groups first. Different lines may share a hash: each has its own
    met = sc.broadcast(_picked(groups.select("line")))
    maps = texts.mapInArrow(lambda x: _mapped(x, met), "line bigint, room int, map binary").repartition("line").distinct()
    sifted = groups.repartition("line").distinct().join(maps, "line").select("group", "line", "room", "map")
    sifted = sifted.repartition("group").sortWithinPartitions("group", "line")
    near = stored(sifted.mapInArrow(_possible, "a bigint, b bigint, name bigint").distinct())  # else a task would run two Python workers
    discard(groups)
    found = components(near.select("a", "b"))
    # texts follow to where all lines of a set are, once, or for a large set to where those of a group are
    linked = found.select(F.col("node").alias("line"), "root")
    linked = stored(linked.unionByName(linked.select(F.col("root").alias("line"), "root").distinct()))
    large = linked.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group).select(F.col("root").alias("large"))
    members = stored(linked.join(large, F.col("root") == F.col("large"), "left"))
    small = members.filter("large is null").select("line", F.col("root").alias("group"), F.lit(0).alias("kind"))
    rest = members.filter("large is not null").select("line")
    rest = near.join(rest, F.col("b") == F.col("line")).select("line", F.col("name").alias("group"), F.lit(1).alias("kind")).distinct()
    wanted = sc.broadcast(_picked(linked.select("line")))
    said = texts.mapInArrow(_texts_of(wanted), "line bigint, text binary").repartition("line").distinct()
    dealt = small.unionByName(rest).join(said, "line").select(F.xxhash64("group", "kind").alias("group"), "line", "text")
    dealt = dealt.repartition("group").sortWithinPartitions("group", "line").select("group", F.unhex(F.md5("text")).alias("line"), "text")
    links = stored(dealt.mapInArrow(verified(_same_set), "a binary, b binary").distinct())
    for table in (near, linked, members):
        discard(table)
    return links


def _told(docs: DataFrame, least: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``lines_of``, and of their lines that are not blank those which meet the condition ``least``, with ``at`` (1 for the
    first occurrence of a line) and ``keep``."""
    found = components(similar_lines(docs))
    linked = found.select(F.col("node").alias("linked"), "root").unionByName(found.select(F.col("root").alias("linked"), "root").distinct())
    rows = stored(lines_of(docs))
    ranked = rows.filter(F.col("state") == FIRST).join(linked, F.col("line") == F.col("linked"), "left").withColumn(
        "at", F.rank().over(W.partitionBy("line").orderBy(F.col("doc_id").isNull(), "doc_id", "line_no")))
    # occurrences that a task has met late are late; their lines' roots do not matter
    firsts = stored(ranked.filter(least).select("doc_id", "line_no", "line", "root", "at"))
    later = rows.filter(F.col("state") == LATER).select("doc_id", "line_no", "line", F.lit(2).alias("at"), F.lit(False).alias("keep"))
    alone = firsts.filter("root is null or at > 1").select("doc_id", "line_no", "line", "at", (F.col("at") == 1).alias("keep"))
    several = firsts.filter("root is not null and at = 1").withColumn("spot", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no"))
    heads = stored(several.groupBy("root").agg(F.min("spot").alias("head")).withColumnRenamed("root", "of"))  # a large class can be split when joined
    classed = several.join(heads, F.col("root") == F.col("of")).select("doc_id", "line_no", "line", "at", F.col("spot").eqNullSafe(F.col("head")).alias("keep"))
    return rows, later.unionByName(alone).unionByName(classed)


def line_classes(docs: DataFrame) -> DataFrame:
    """One row per line of ``docs`` (doc_id, text): doc_id, line_no, line, keep.

    Of every class of equal or similar lines the occurrence with the smallest (doc_id, line_no), nulls last, is kept.
    Blank lines are kept.  A null text has no lines; an empty text has one, blank.  Rows repeated with the same
    doc_id repeat their lines, which are kept or dropped together.  Other columns are left out."""
    rows, told = _told(docs, "true")
    blank = rows.filter(F.col("state") == BLANK).select("doc_id", "line_no", "line", F.lit(True).alias("keep"))
    return told.select("doc_id", "line_no", "line", "keep").unionByName(blank)


def line_report(docs: DataFrame) -> DataFrame:
    """One row per doc_id: doc_id, n_lines, n_kept, dropped (numbers of the dropped lines, ascending).  Repeated
    doc_ids are told together."""
    rows, told = _told(docs, "root is not null or at > 1")  # others are kept
    none = docs.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("n"))
    counts = none.unionByName(rows.select(F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("n"))).groupBy("id").agg(F.sum("n").alias("n_lines"))
    gone = told.filter(~F.col("keep")).groupBy("doc_id").agg(F.array_sort(F.collect_list("line_no")).alias("dropped"))
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return counts.join(gone, F.col("id").eqNullSafe(F.col("doc_id")), "left").select(
        F.col("id").alias("doc_id"), "n_lines", (F.col("n_lines") - F.size(dropped)).alias("n_kept"), dropped.alias("dropped"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; all rows and columns stay.  A document whose lines are
    all dropped keeps the empty text."""
    drop = line_report(docs).filter("size(dropped) > 0").select(F.col("doc_id").alias("__id"), F.col("dropped").alias("__gone"))
    rows = docs.join(drop, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    lines = F.split(F.col("text").cast("string"), "\n")
    left = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("__gone", i), x)), lambda x: x.isNotNull())
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return rows.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])
