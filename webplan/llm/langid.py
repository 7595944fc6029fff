"""Language identification as mixture inference.

Every language has a distribution over character trigrams, counted on all labelled training documents.  A document is
taken as drawn from a mixture of languages; expectation-maximisation estimates its proportions.  The languages are then
sorted by proportion, the mixture is refitted for the first one, two, ... of them, and the set with the least penalised
likelihood (half the logarithm of the document's trigrams per language) is kept."""

from __future__ import annotations

from collections.abc import Iterator
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from webplan.llm.common import blocks, utf8

UNKNOWN = "und"
#: Hash classes of trigrams: the model holds at most this many numbers per language.
BINS = 1 << 16
SMOOTHING, ROUNDS, REFITS = 0.2, 12, 4
#: Letters keep their byte; what is neither a letter nor part of a longer character becomes a space.
FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], dtype=np.uint32)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram classes of lower-cased texts, and the text of each."""
    flat = np.frombuffer(b"".join(b" " + t + b" " for t in texts), np.uint8)
    size = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    c = FOLD[flat]
    code = ((c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), size)[:-2]
    end = np.cumsum(size)
    keep = np.ones(len(flat), bool)
    keep[end - 1] = keep[end - 2] = False
    keep = keep[:-2] & ~((c[:-2] == 32) & (c[1:-1] == 32))
    return code[keep], doc[keep]


def training_rows(documents: DataFrame) -> Column:
    """The documents to learn from: crc32 of the id as text leaves another remainder than 1 on division by 3."""
    return ~held_out()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, at = batch.column(0).to_pylist(), 0
        for block in blocks(batch.column(1)):
            own = langs[at : at + len(block)]
            at += len(block)
            code, doc = trigrams(block)
            names = sorted(set(own))
            number = np.array([names.index(x) for x in own], dtype=np.int64)
            counts = np.bincount(number[doc] * BINS + code, minlength=len(names) * BINS).reshape(-1, BINS)
            for i, x in enumerate(names):
                totals[x] = totals[x] + counts[i] if x in totals else counts[i]
    for x, counts in totals.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())],
            names=["lang", "bin", "n"],
        )


class Languages:
    """The learned languages and their trigram probabilities."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        smooth = counts + SMOOTHING
        self.probability = (smooth / smooth.sum(axis=0)).astype(np.float64) if names else smooth

    def mixtures(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Proportions (texts x languages) of the selected sets, zero outside them; number of trigrams, and their mean
        log-probability under the whole mixture.  A text's set grows as long as every step lowers its penalised cost."""
        n_docs, n_langs = len(texts), len(self.names)
        code, doc = trigrams(texts)
        key, times = np.unique(doc * BINS + code, return_counts=True)
        doc, p, times = key // BINS, self.probability[key % BINS], times.astype(np.float64)
        grams = np.bincount(doc, times, n_docs)
        theta = np.full((n_docs, n_langs), 1.0 / n_langs)
        used, first = np.unique(doc, return_index=True)
        if not len(used):
            return theta, grams, np.zeros(n_docs)

        def fit(theta: np.ndarray, rounds: int) -> np.ndarray:
            for _ in range(rounds):
                part = theta[doc] * p
                part *= (times / part.sum(axis=1))[:, None]
                theta = theta.copy()
                theta[used] = np.add.reduceat(part, first, axis=0) / grams[used, None]
            return theta

        theta = fit(theta, ROUNDS)
        rank = np.argsort(np.argsort(-theta, axis=1, kind="stable"), axis=1, kind="stable")
        best, chosen, likely, growing = np.full(n_docs, np.inf), theta, np.zeros(n_docs), np.ones(n_docs, bool)
        for size in range(1, n_langs + 1):
            tried = np.where(rank < size, theta + 1e-12, 0.0)
            tried = fit(tried / tried.sum(axis=1, keepdims=True), REFITS if size > 1 else 0)
            fitted = np.bincount(doc, times * np.log((tried[doc] * p).sum(axis=1)), n_docs)
            cost = -fitted + 0.5 * size * np.log(np.maximum(grams, 2))
            growing &= cost < best - 1e-9
            better = growing
            best = np.where(better, cost, best)
            chosen = np.where(better[:, None], tried, chosen)
            likely = np.where(better, fitted / np.maximum(grams, 1), likely)
            if not growing.any():
                break
        return chosen, grams, likely


def learn(docs: DataFrame) -> Languages:
    """Fit on every row of ``docs`` with text and lang.  The driver holds at most BINS numbers per language; the
    number of languages is that of the label set, a few hundred at most."""
    rows = docs.filter("text is not null and lang is not null").select(
        F.col("lang").cast("string").alias("lang"), utf8(F.lower("text")).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    found = np.array(table.column("lang").to_pylist(), dtype=object)
    names = sorted(set(found))
    matrix = np.zeros((BINS, len(names)))
    bins, n = table.column("bin").to_numpy(), table.column("n").to_numpy()
    for i, x in enumerate(names):
        matrix[bins[found == x], i] = n[found == x]
    return Languages(names, matrix)


PREDICTION = "struct<lang:string,score:double,languages:array<string>,shares:array<double>,likely:double>"


def predict(model: Languages, spark):
    """Column function: struct of lang, score (its proportion), languages and shares of a lower-cased text."""
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf(PREDICTION)
    def infer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for column in batches:
            rows: list = []
            for block in blocks(column, (1 << 20) * 4 // max(4, len(own.names))):
                if not own.names:
                    rows += [{"lang": UNKNOWN, "score": 0.0, "languages": [], "shares": [], "likely": None}] * len(block)
                    continue
                theta, grams, likely = own.mixtures(block)
                for t, g, fit in zip(theta, grams, likely):
                    order = [i for i in np.argsort(-t, kind="stable").tolist() if t[i] > 1e-9] if g else []
                    names = [own.names[i] for i in order]
                    rows.append({"lang": names[0] if names else UNKNOWN, "score": min(1.0, float(t[order[0]])) if names else 0.0,
                                 "languages": names, "shares": [float(t[i]) for i in order], "likely": float(fit) if names else None})
            yield pa.array(rows, pa.struct([("lang", pa.string()), ("score", pa.float64()),
                                            ("languages", pa.list_(pa.string())), ("shares", pa.list_(pa.float64())), ("likely", pa.float64())]))

    return infer


def identify(docs: DataFrame, model: Languages, name: str = "language") -> DataFrame:
    """``docs`` with a column ``name``: struct of lang, score, languages, shares and likely (mean log-probability of the
    text's trigrams under its mixture).

    Texts that are null or hold no letter get ``und``, score 0 and no languages, as does every text when nothing was
    learned.  A column of that name is replaced.  No shuffle."""
    docs, text = docs.drop(name), F.col("text")
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    found = predict(model, docs.sparkSession)(utf8(F.lower(text)))
    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("languages"),
                    F.array().cast("array<double>").alias("shares"), F.lit(None).cast("double").alias("likely"))
    return docs.withColumn(name, F.when(lettered, found).otherwise(none))


def language_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, languages, shares; learned on the documents
    that are not held out.  A null doc_id is not held out."""
    model = learn(docs.filter(training_rows(docs)))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, model).select(
        "doc_id", "held_out", F.col("language.lang").alias("lang_pred"), "language.score", "language.languages", "language.shares"
    )


def keep_identified(docs: DataFrame, least_likely: float = -math.log(BINS)) -> DataFrame:
    """``docs`` without the rows in which no language is found, or whose trigrams are on average less probable under the
    whole mixture than ``least_likely``: by default, than if every class of trigrams were as probable as any other.

    A document in several languages stays, however small the share of each; columns stay as they are."""
    model = learn(docs.filter(training_rows(docs)))
    told = identify(docs, model, "__language")
    return told.filter((F.col("__language.lang") != UNKNOWN) & (F.col("__language.likely") >= least_likely)).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
