"""Token counts with a whole-token shortcut.

Most pre-tokens of a text are vocabulary strings.  Before any text is read, every vocabulary string is given to the
library once; those that come back as one token are counted as one from then on, and only the remaining pre-tokens
are merged by the library.

Cutting a text into pre-tokens is exact when no vocabulary piece reaches over the cut.  Both cuts used here are
proven on the vocabulary itself: before a run of spaces (no piece has a space after another character) and around a
line feed (no piece contains one).  A vocabulary that allows neither is counted on whole texts by the library."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from webplan.llm.common import blocks

#: The character by which the library writes a space.
SPACE = "▁"
PRE_TOKEN = re.compile(r" +[^ \n]*|[^ \n]+|\n")
#: Counts remembered by a task, and the longest pre-token remembered.
MEMORY, LONGEST = 400_000, 40


class PieceCounter:
    """Counts the tokens of texts as the library does, for one vocabulary file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        ordinary = [
            lib.id_to_piece(i) for i in range(lib.get_piece_size())
            if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))
        ]
        self.cuts = (
            not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in ordinary)
            and lib.encode("\n", out_type=str)[:1] == [SPACE]
            and lib.encode("a", out_type=str) == lib.encode(SPACE + "a", out_type=str)[1:]
        )
        self.base = len(lib.encode("\n"))
        texts = [p.replace(SPACE, " ") for p in ordinary]
        self.whole = {t: 1 for t, n in zip(texts, self.merge(texts)) if n == 1} if self.cuts else {}
        if self.cuts:
            self.whole["\n"] = self.base - 1
        self.known = dict(self.whole)

    def merge(self, pre: list[str]) -> list[int]:
        """Tokens of pre-tokens by the library.  Each is put after a line feed, which no piece reaches over, so that
        the space the library sets before a text is not part of the count."""
        return [len(x) - self.base for x in self.library.encode(["\n" + p for p in pre], num_threads=1)]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuts:
            return len(self.library.encode(text))
        if len(self.known) > MEMORY:
            self.known = dict(self.whole)
        pre = PRE_TOKEN.findall(" " + text.replace(SPACE, " "))
        rest = list(set(pre).difference(self.known))
        if not rest:
            return sum(map(self.known.__getitem__, pre))
        merged = dict(zip(rest, self.merge(rest)))
        total = sum(merged[p] if p in merged else self.known[p] for p in pre)
        self.known.update((p, n) for p, n in merged.items() if len(p) <= LONGEST)
        return total


@functools.cache
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_count(path: str):
    """Column function: tokens of a text column by the vocabulary file at ``path`` (the same path on every host)."""

    @arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(path)
        for column in batches:
            yield pa.array([own.count(t) for block in blocks(column) for t in block], pa.int64())

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated rows; other columns are left out, so
    their names cannot clash; an empty table gives an empty result.  No shuffle."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(path)(F.col("text")).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
