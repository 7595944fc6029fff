"""Benchmark decontamination by Wu-Manber search over words.

Test strings are windows of item words.  For windows of m words, the shift table says for a block of two words how far
the search may jump when it meets that block at the end of a position: the least distance from an occurrence of the
block in a window to the window's end, or m - 1 if no window has it.  Only where the shift is zero, the bucket of the
last words' hash gives the windows to compare in full.  Most positions are never looked at."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from webplan.llm.common import blocks, row_key, utf8

WINDOW = 10
#: Item words searched for together; a larger benchmark is searched in several passes, each with a table of this size.
PASS_WORDS = 200_000
#: A-Z in lower case; every other ASCII character that is no letter or digit as a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Searcher:
    """Finds the windows of one length."""

    def __init__(self, length: int, windows: dict[tuple, set]):
        self.length, self.block, self.suffix = length, min(2, length), min(4, length)
        self.longest = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[int, list[tuple]] = defaultdict(list)
        self.items = windows
        for w in windows:
            for end in range(self.block, length + 1):
                part = w[end - self.block : end]
                self.shift[part] = min(self.shift.get(part, self.longest), length - end)
            self.buckets[hash(w[-self.suffix :])].append(w)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple]]:
        """(start, window) of every occurrence, in order."""
        n, size, block, suffix = len(words), self.length, self.block, self.suffix
        shift, buckets, longest = self.shift.get, self.buckets, self.longest
        at = size
        while at <= n:
            jump = shift(tuple(words[at - block : at]), longest)
            if jump:
                at += jump
                continue
            candidates = buckets.get(hash(tuple(words[at - suffix : at])))
            if candidates:
                here = tuple(words[at - size : at])
                for w in candidates:
                    if w == here:
                        yield at - size, w
            at += 1


def searchers(items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW) -> list[Searcher]:
    by_length: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    for name, words in items:
        size = min(window, len(words))
        for at in range(len(words) - size + 1) if size else ():
            by_length[size][tuple(words[at : at + size])].add(name)
    return [Searcher(size, dict(windows)) for size, windows in sorted(by_length.items())]


def find(words: list[bytes], tables: list[Searcher]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged spans (start, end) of words inside occurrences, and the items that have one."""
    found, items = [], set()
    for table in tables:
        for start, w in table.search(words):
            found.append((start, start + table.length))
            items |= table.items[w]
    spans: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans, items


def benchmark_passes(benchmark: DataFrame, limit: int = PASS_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items (item_id, text) in lists of at most ``limit`` words, or one item; the driver holds one list."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), utf8(F.col("text")))
    held, size = [], 0
    for name, text in rows.toLocalIterator():
        words = words_of(bytes(text or b""))
        if not words:
            continue
        if held and size + len(words) > limit:
            yield held
            held, size = [], 0
        held.append((name, words))
        size += len(words)
    if held:
        yield held


RESULT = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"


def _search_column(items: list[tuple[str, list[bytes]]], spark, window: int):
    shared = spark.sparkContext.broadcast(items)
    held: list = []

    @arrow_udf(RESULT)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not held:
            held.append(searchers(shared.value, window))
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for column in batches:
            n, spans, names = [], [], []
            for block in blocks(column):
                for text in block:
                    words = words_of(text)
                    where, who = find(words, held[0])
                    n.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in where])
                    names.append(sorted(who))
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(names, pa.list_(pa.string()))],
                names=["n_words", "spans", "items"],
            )

    return search


def _merged(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap made one."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done, s):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) == 0) | (s["start"] > last["end"]), F.concat(done, F.array(s))).otherwise(
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined)))

    return F.aggregate(F.array_sort(spans), none, add)


def search_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = PASS_WORDS, name: str = "found") -> DataFrame:
    """``docs`` with a column ``name``: struct of n_words, spans and items (sorted item ids as strings).

    A benchmark of more than ``limit`` words is searched in passes over the documents, whose finds are then brought
    together by row.  A null or empty text has no words and no finds; items without words are never found; items with
    a null id count as one item named ``null``.  Repeated rows and items change nothing.  A column of that
    name is replaced."""
    docs, text = docs.drop(name), utf8(F.col("text"))
    spark = docs.sparkSession
    passes = benchmark_passes(benchmark, limit)
    first = _search_column(next(passes, []), spark, window)
    out = docs.withColumn(name, first(text))
    more = None
    for items in passes:
        part = docs.select(F.col("doc_id").alias("__id"), row_key(docs).alias("__key"),
                           _search_column(items, spark, window)(text).alias("f")).filter("size(f.items) > 0")
        more = part if more is None else more.unionByName(part)
    if more is None:
        return out
    flat = lambda c: F.flatten(F.collect_set(c))  # noqa: E731  one element per pass
    more = more.groupBy("__id", "__key").agg(flat("f.spans").alias("__spans"), flat("f.items").alias("__items"))
    own = out.withColumn("__row", row_key(docs))
    both = own.join(more, (F.col("__row") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    extra = lambda c, t: F.concat(F.col(f"{name}.{c}"), F.coalesce(F.col(f"__{c}"), F.array().cast(t)))
    return both.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.struct(
            F.col(f"{name}.n_words").alias("n_words"),
            _merged(extra("spans", "array<struct<start:bigint,end:bigint>>")).alias("spans"),
            F.array_sort(F.array_distinct(extra("items", "array<string>"))).alias("items"),
        ).alias(name),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = PASS_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    See search_documents for nulls and repeats.  Without a find, items_sha256 is that of the empty text."""
    found = search_documents(docs.select("doc_id", "text"), benchmark, window, limit)
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "found.n_words", hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = PASS_WORDS) -> DataFrame:
    """``docs`` without the rows that hold a window of an item; the others keep all their columns."""
    return search_documents(docs, benchmark, window, limit, "__found").filter("size(__found.items) = 0").select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )


def items_digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
