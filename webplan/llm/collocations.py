"""Phrase collocations by streams of counts in prefix and in suffix order.

Phrases of one to four words are counted level by level: a longer phrase is counted only where both phrases one word
shorter, its beginning and its end, passed the least count.  Tasks test that on a bitmap of fixed size that holds at
least all phrases which passed; false hits cost rows, never results.  A task merges sorted runs of counts before it
passes them on, and Spark adds them up.

The counts form two streams.  In prefix order (sorted by first word, second word, ...) a phrase lies behind its
beginnings, in suffix order (last word first) behind its ends.  Sort-merge joins step through each stream and the
candidates together: the prefix stream gives the counts of beginnings, the suffix stream those of ends, and a phrase's
largest one-word extensions are the rows that follow it in either.  A candidate inside one of two words more is also
inside the one between, which is at least as frequent, so extensions by one word decide.

Words are 64-bit hashes of language and word; their texts are joined for the reported phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
import xxhash

from webplan.llm.common import BLOCK_BYTES, blocks, combined, discard, stored, table_rows, utf8
from webplan.llm.lm_scoring import span_hashes

LEAST, LONGEST, TOP = 30, 4, 2000
#: A phrase inside a longer one with at least this share of its count (a fraction) is dropped.
SHARE = (80, 100)
#: Bits of the table of frequent phrases that every task gets; counts that a task holds before it passes them on.
BITS, HELD = 1 << 25, 1 << 19
#: Groups into which a language's candidates are dealt before its first ones are chosen.
SALTS = 64
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: 0: part of a word; 1: between words; 2: between pieces.
_KIND = np.array([2 if chr(b) in ".,;:!?" or 10 <= b <= 13 else 1 if b in (32, 9) else 0 for b in range(256)], np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def phrase_hash(columns: list[np.ndarray]) -> np.ndarray:
    """A number for phrases given as columns of word hashes."""
    out = columns[0]
    for c in columns[1:]:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + c)
    return out


class Words:
    """The words of a block of texts: hashes (of language and word), spans, and the piece that each lies in."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.flat = np.frombuffer(b"\n".join([*texts, b""]).translate(_FOLD), np.uint8)
        kind = _KIND[self.flat]
        inside = np.concatenate([[False], kind == 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.piece = np.cumsum(kind == 2)[self.start] if len(self.start) else np.zeros(0, np.int64)
        count = np.diff(np.searchsorted(self.start, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
        self.text = np.repeat(np.arange(len(texts)), count)
        seeds = {x: xxhash.xxh64_intdigest(x.encode(), 12) for x in set(langs)}
        seed = np.array([seeds[x] for x in langs], np.uint64)
        self.hashes = _mix(span_hashes(self.flat, self.start, self.end) + seed[self.text]) if len(self.start) else np.zeros(0, np.uint64)

    def phrases(self, n: int, known: np.ndarray | None) -> list[np.ndarray]:
        """Columns of word hashes of all phrases of n words whose beginnings and ends may be among the ``known``."""
        room = len(self.hashes) - n + 1
        if room <= 0:
            return [np.zeros(0, np.uint64)] * n
        ok = self.piece[:room] == self.piece[n - 1 :]
        if known is not None:
            shorter = phrase_hash([self.hashes[i : i + room + 1] for i in range(n - 1)])
            bit = shorter & np.uint64(BITS - 1)
            seen = (known[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
            ok &= seen[:-1] & seen[1:]
        at = np.flatnonzero(ok)
        return [self.hashes[at + i] for i in range(n)]


def merged(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows of word hashes as one, with their counts added; in the order of their phrase hashes."""
    if not len(n):
        return columns, n
    order = np.argsort(phrase_hash(columns))
    columns, n = [c[order] for c in columns], n[order]
    new = np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(n, first)


def _rows(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[list[bytes], list[str]]]:
    langs, at = batch.column(1).to_pylist(), 0
    for block in blocks(batch.column(0), limit):
        yield block, langs[at : at + len(block)]
        at += len(block)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) -> lang, word, hash, n of every different word of a block."""
    for batch in batches:
        for texts, langs in _rows(batch, BLOCK_BYTES):
            w = Words(texts, langs)
            found, first, n = np.unique(w.hashes, return_index=True, return_counts=True)
            flat = w.flat.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs[i] for i in w.text[first]], pa.string()), pa.array([flat[a:b] for a, b in zip(w.start[first], w.end[first])], pa.binary()),
                 pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "word", "hash", "n"])


def _counts(n: int, known):
    """(text, lang) -> w1, ..., wn, n: sorted runs of counts, merged while a task holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        held: list[tuple[list[np.ndarray], np.ndarray]] = []

        def flush(limit: int) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if sum(len(x[1]) for x in held) <= 2 * limit:
                return
            columns, count = merged([np.concatenate([x[0][i] for x in held]) for i in range(n)], np.concatenate([x[1] for x in held]))
            held = [(columns, count)]
            if len(count) > limit:
                held = []
                for at in range(0, len(count), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array(c[part].view(np.int64)) for c in columns], pa.array(count[part])], names=[*[f"w{i + 1}" for i in range(n)], "n"])

        for batch in batches:
            for texts, langs in _rows(batch, BLOCK_BYTES):
                columns = Words(texts, langs).phrases(n, table)
                held.append(merged(columns, np.ones(len(columns[0]), np.int64)))
                yield from flush(HELD)
        yield from flush(0)

    return run


def _bitmap(counts: DataFrame, n: int) -> np.ndarray:
    """The bits of all phrases of a table of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BITS >> 3, np.uint8)
        for batch in batches:
            if batch.num_rows:
                bit = phrase_hash([np.asarray(batch.column(i)).astype(np.int64).view(np.uint64) for i in range(n)]) & np.uint64(BITS - 1)
                np.bitwise_or.at(table, (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
        yield from table_rows(table)

    rows = counts.select(*[f"w{i + 1}" for i in range(n)]).mapInArrow(run, "part int, cells binary")
    return combined(rows, BITS >> 3, np.uint8, np.bitwise_or)


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact counts of ``docs`` (lang, text): words (lang, word, hash, f), phrases of one to ``longest`` words
    (phrase: array of hashes, f) that occur ``least`` times or more in their language, and the words of each language
    (lang, n)."""
    texts = docs.select(utf8(F.col("text")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).filter("text is not null")
    every = stored(texts.mapInArrow(_words, "lang string, word binary, hash bigint, n bigint").groupBy("lang", "word", "hash").agg(F.sum("n").alias("f")))
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    words = every.filter(F.col("f") >= least)
    levels = [words.select(F.col("hash").alias("w1"), "f")]
    context = docs.sparkSession.sparkContext
    for n in range(2, longest + 1):
        columns = [f"w{i + 1}" for i in range(n)]
        known = context.broadcast(_bitmap(levels[-1], n - 1))
        counted = texts.mapInArrow(_counts(n, known), ", ".join(f"{c} bigint" for c in columns) + ", n bigint")
        levels.append(stored(counted.groupBy(*columns).agg(F.sum("n").alias("f")).filter(F.col("f") >= least)))
    phrases = None
    for n, level in enumerate(levels, 1):
        rows = level.select(F.array(*[f"w{i + 1}" for i in range(n)]).alias("phrase"), "f")
        phrases = rows if phrases is None else phrases.unionByName(rows)
    return words, phrases, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of every language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; ``[.,;:!?\\x0A-\\x0D]`` part pieces and ``[^\\x20\\x09]+`` are words; a null lang counts as
    ``und``.  Candidates are the phrases of 2 to ``longest`` words with at least ``least`` occurrences (a) inside
    pieces, overlaps included.  score is the lowest floor(2000000 a / (l + r)) over their cuts, l and r the counts of
    both sides there (ties: the first cut); n counts the language's words.  Candidates inside a longer one with at
    least 80 % of their count are dropped.  Order: score and a descending, phrase ascending by bytes.

    Null, empty and wordless texts add nothing; repeated rows count as often as they occur; other columns are left out.
    An empty table, or one without candidates, gives an empty result."""
    words, counted, totals = phrase_counts(docs, least, longest)
    counts = stored(counted)
    size = F.size("phrase")
    candidates = counts.filter(size >= 2)
    # the streams: beginnings in prefix order, ends in suffix order (words backwards)
    prefix = counts.select(F.col("phrase").alias("left"), F.col("f").alias("l"))
    suffix = counts.select(F.reverse("phrase").alias("right"), F.col("f").alias("r"))
    cuts = candidates.select("phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("phrase", F.lit(1), F.col("k"))).withColumn("right", F.reverse(F.slice("phrase", F.col("k") + 1, size - F.col("k"))))
    cuts = cuts.join(prefix.hint("merge"), "left").join(suffix.hint("merge"), "right")
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r)")
    scored = cuts.groupBy("phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("s"))
    longer = candidates.filter(size >= 3)
    follow = longer.select(F.slice("phrase", F.lit(1), size - 1).alias("phrase"), "f").unionByName(
        longer.select(F.slice("phrase", F.lit(2), size - 1).alias("phrase"), "f"))
    follow = follow.groupBy("phrase").agg(F.max("f").alias("most"))
    share, whole = (F.lit(x).cast("decimal(20,0)") for x in SHARE)
    kept = scored.join(follow.hint("merge"), "phrase", "left").filter(
        F.col("most").isNull() | (F.col("most") * whole < F.col("s.a") * share)).select("phrase", "s.*")
    # languages by the first word; the first ones of each group, then of each language
    named = kept.join(words.select(F.col("hash").alias("w"), "lang"), F.col("phrase")[0] == F.col("w"))
    best = [F.desc("score"), F.desc("a")]
    for group in (["lang", "salt"], ["lang"]):
        named = named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        named = named.withColumn("at", F.rank().over(W.partitionBy(*group).orderBy(*best))).filter(F.col("at") <= top)
    first = stored(named.select("lang", "phrase", "a", "l", "r", "score"))
    parts = first.select("phrase", F.posexplode("phrase").alias("i", "hash")).join(words.select("hash", "word"), "hash")
    told = parts.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("i", F.col("word").cast("string").alias("word")))).alias("parts"))
    told = told.select("phrase", F.array_join("parts.word", " ").alias("told"))
    ranked = first.join(told, "phrase").join(totals, "lang")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*best, "told"))
    out = ranked.select("lang", rank.cast("long").alias("rank"), F.col("told").alias("phrase"), "a", "l", "r", "n", "score").filter(F.col("rank") <= top)
    out = stored(out)
    discard(first)
    discard(counts)
    return out
