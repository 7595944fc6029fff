"""Document scores by masked pseudo-likelihood.

A small bidirectional network predicts every word from the words around it, itself masked: the embeddings of two words
on either side, each with weights of its position, are added and squashed, and a two-level softmax gives first the
word's class, then the word in its class.  The sum of the conditional log-probabilities of all words scores a document.

The network's vocabulary is taken from exact counts of all words of the corpus; to the network a rarer word is one of
its hash class.  Its score is log P(class) plus log P(word | class), the latter from the exact counts, which stay a
distributed table: a word seen n times in a class of N such words has n / (N + 1), and all unseen words of a class
together are one word with 1 / (N + 1).  Training
runs over the whole corpus once, in rounds: each round every task descends on its documents of the round from the same
weights, and the new weights are the mean of the tasks', weighted by the words they trained on."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from webplan.llm.common import blocks, row_key, stored, utf8

#: A-Z in lower case; every other ASCII character that is no letter or digit separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
CLASSES, RARE = 32, 64
#: Words on either side that predict a word.
SIDE = 2
#: Counts of rare words with at least one in so many of the corpus's words are sent to every task: at most so many words
#: whatever the corpus, 16 bytes each.  All others are joined by shuffle.
TABLE = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@dataclass
class Shape:
    """Sizes of the model and of its training; all are independent of the corpus."""

    words: int = 1024 - RARE
    dims: int = 16
    rounds: int = 4
    batch: int = 4096
    rate: float = 1.0
    seed: int = 7


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        steps = np.full(1 << (n - 1).bit_length(), _BASE if which == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[which] = np.multiply.accumulate(steps)
    return _powers[which][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, and the number of words of each text."""
    flat = np.frombuffer(b" ".join([*texts, b""]).translate(FOLD), np.uint8)
    inside = np.concatenate([[False], flat != 32, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    stops = np.cumsum([len(t) + 1 for t in texts])
    return span_hashes(flat, start, end), np.diff(np.searchsorted(start, stops), prepend=0)


def span_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes."""
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(flat.astype(np.uint64) * _power("up", len(flat)), out=total[1:])
    h = (total[end] - total[start]) * _power("down", len(flat) + 1)[start]
    h ^= (end - start).astype(np.uint64) << np.uint64(56)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(0), 1 << 23):
            parts = [word_hashes(part)[0] for part in _split(block)]
            word, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


def _split(block: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in block:
        held.append(t)
        size += len(t)
        if size > 1 << 20:
            yield held
            held, size = [], 0
    if held:
        yield held


def word_counts(docs: DataFrame) -> DataFrame:
    """Exact counts of every word of every text: word (hash), n."""
    return docs.select(utf8(F.col("text")).alias("text")).mapInArrow(_count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Network:
    """The weights, and what is done with them on blocks of texts."""

    NAMES = ("embed", "place", "bias", "class_out", "class_bias", "word_out", "word_bias")

    def __init__(self, vocabulary: np.ndarray, shape: Shape, counts: np.ndarray | None = None):
        self.vocabulary, self.shape = np.sort(vocabulary), shape
        order = np.argsort(vocabulary)
        rng, d = np.random.default_rng(shape.seed), shape.dims
        self.n_ids = -(-(shape.words + RARE) // CLASSES) * CLASSES
        #: Frequent words come first in ``vocabulary`` and are spread over the classes.
        self.number = order.astype(np.int64)
        self.weights = {
            "embed": rng.normal(0, 0.3, (self.n_ids + 1, d)), "place": rng.normal(1, 0.3, (2 * SIDE, d)), "bias": np.zeros(d),
            "class_out": rng.normal(0, 0.1, (CLASSES, d)), "class_bias": np.zeros(CLASSES),
            "word_out": rng.normal(0, 0.1, (CLASSES, self.n_ids // CLASSES, d)), "word_bias": np.zeros((CLASSES, self.n_ids // CLASSES)),
        }
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights[k].ravel() for k in self.NAMES])

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            w = self.weights[k]
            self.weights[k] = values[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers: the vocabulary's, else a class of rare words."""
        rare = self.shape.words + (hashes % np.uint64(RARE)).astype(np.int64)
        if not len(self.vocabulary):
            return rare
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, self.number[at], rare)

    def windows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of texts, the numbers around each (an own number outside the text), and words per text."""
        return self.around(*word_hashes(texts))

    def around(self, hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, none = self.ids(hashes), self.n_ids
        at = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
        left = np.repeat(n, n) - at
        near = np.full((2 * SIDE, len(ids)), none, np.int64)
        for k in range(1, SIDE + 1):
            ok = at >= k
            near[SIDE - k, ok] = ids[np.flatnonzero(ok) - k]
            ok = left > k
            near[SIDE + k - 1, ok] = ids[np.flatnonzero(ok) + k]
        return ids, near, n

    def hidden(self, near: np.ndarray) -> np.ndarray:
        w = self.weights
        total = np.take(w["embed"], near[0], axis=0) * w["place"][0]
        for k in range(1, len(near)):
            total += np.take(w["embed"], near[k], axis=0) * w["place"][k]
        return np.tanh(total + w["bias"])

    @staticmethod
    def _log_softmax(x: np.ndarray) -> np.ndarray:
        x -= x.max(axis=1, keepdims=True)
        x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
        return x

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        x -= x.max(axis=1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(axis=1, keepdims=True)
        return x

    @staticmethod
    def _by_class(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the order of their word's class, and where each class begins in it."""
        group = ids % CLASSES
        order = np.argsort(group, kind="stable")
        return order, np.searchsorted(group[order], np.arange(CLASSES + 1))

    def log_probability(self, ids: np.ndarray, near: np.ndarray) -> np.ndarray:
        """log P(word | words around it) of every position."""
        out, size = np.empty(len(ids), np.float64), self.shape.batch
        for a in range(0, len(ids), size):
            out[a : a + size] = self._batch(ids[a : a + size], near[:, a : a + size])
        return out

    def _batch(self, ids: np.ndarray, near: np.ndarray) -> np.ndarray:
        order, edge = self._by_class(ids)
        ids = ids[order]
        w, h, at = self.weights, self.hidden(near[:, order]), np.arange(len(ids))
        group, member = ids % CLASSES, ids // CLASSES
        found = self._log_softmax(h @ w["class_out"].T + w["class_bias"])[at, group].astype(np.float64)
        for g in range(CLASSES):
            rows = slice(edge[g], edge[g + 1])
            if edge[g] < edge[g + 1]:
                inner = self._log_softmax(h[rows] @ w["word_out"][g].T + w["word_bias"][g])
                found[rows] += inner[at[: len(inner)], member[rows]]
        out = np.empty_like(found)
        out[order] = found
        return out

    def descend(self, ids: np.ndarray, near: np.ndarray, memory: dict[str, np.ndarray]) -> None:
        """One step of descent on the mean of a batch, with per-weight rates from past gradients."""
        order, edge = self._by_class(ids)
        ids, near = ids[order], near[:, order]
        w, h, n, at = self.weights, self.hidden(near), len(ids), np.arange(len(ids))
        group, member = ids % CLASSES, ids // CLASSES
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        p = self._softmax(h @ w["class_out"].T + w["class_bias"])
        p[at, group] -= 1
        grad["class_out"], grad["class_bias"] = p.T @ h, p.sum(axis=0)
        dh = p @ w["class_out"]
        for g in range(CLASSES):
            rows = slice(edge[g], edge[g + 1])
            if edge[g] < edge[g + 1]:
                q = self._softmax(h[rows] @ w["word_out"][g].T + w["word_bias"][g])
                q[at[: len(q)], member[rows]] -= 1
                grad["word_out"][g], grad["word_bias"][g] = q.T @ h[rows], q.sum(axis=0)
                dh[rows] += q @ w["word_out"][g]
        dh *= 1 - h * h
        grad["bias"] = dh.sum(axis=0)
        dims = np.arange(dh.shape[1])
        for k in range(len(near)):
            grad["place"][k] = (dh * np.take(w["embed"], near[k], axis=0)).sum(axis=0)
            # sums by word: one count per (word, dimension) cell
            cell = (near[k][:, None] * len(dims) + dims).ravel()
            grad["embed"] += np.bincount(cell, (dh * w["place"][k]).ravel(), grad["embed"].size).reshape(grad["embed"].shape)
        for k, g in grad.items():
            g /= n
            memory[k] += g * g
            w[k] -= self.shape.rate * 0.1 * g / np.sqrt(memory[k] + 1e-8)


def _train(model: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, trained = model.shape, 0
        memory = {k: np.zeros_like(v) for k, v in model.weights.items()}
        rng = np.random.default_rng(shape.seed)
        held: list = []

        def step(least: int) -> int:
            nonlocal held
            done = 0
            if held:
                ids, near = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held], axis=1)
                while len(ids) - done >= max(1, least):
                    part = slice(done, done + shape.batch)
                    model.descend(ids[part], near[:, part], memory)
                    done = min(len(ids), done + shape.batch)
                held = [(ids[done:], near[:, done:])] if done < len(ids) else []
            return done

        for batch in batches:
            for block in blocks(batch.column(0)):
                ids, near, n = model.windows(block)
                aim = rng.permutation(len(ids))
                held.append((ids[aim], near[:, aim]))
                trained += step(shape.batch)
        trained += step(1)
        if trained:
            flat = model.flat().astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * trained), pa.array(np.full(len(flat), trained, np.int64))],
                names=["at", "total", "words"])

    return run


def train(docs: DataFrame, shape: Shape | None = None, counts: DataFrame | None = None) -> Network:
    """Fit on all texts.  The driver holds the vocabulary and the weights, whose sizes are set by ``shape``.  counts:
    word_counts(docs), where these are at hand."""
    shape = shape or Shape()
    top = (word_counts(docs) if counts is None else counts).orderBy(F.desc("n"), "word").limit(shape.words).collect()
    model = Network(np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64), shape)
    texts = docs.filter("text is not null").select(
        utf8(F.col("text")).alias("text"), F.pmod(F.xxhash64(F.lit(shape.seed), row_key(docs)), F.lit(shape.rounds)).alias("round"))
    for turn in range(shape.rounds):
        own = texts.filter(F.col("round") == turn).select("text")
        moved = own.mapInArrow(_train(model), "at int, total double, words bigint")
        mean = moved.groupBy("at").agg((F.sum("total") / F.sum("words")).alias("w")).orderBy("at").toArrow()
        if mean.num_rows:
            model.set_flat(mean.column("w").to_numpy())
    return model


def _told_apart(hashes: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different wanted words of every text: how many, the words, and how often each occurs."""
    text, at = np.repeat(np.arange(len(n)), n), np.flatnonzero(wanted)
    text, word = text[at], hashes[at].view(np.int64)
    order = np.lexsort((word, text))
    text, word = text[order], word[order]
    new = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (text[1:] != text[:-1]))[: len(word)])
    return np.bincount(text[new], minlength=len(n)), word[new], np.diff(np.append(new, len(word)))


def score_words(docs: DataFrame, model: Network, counts: DataFrame) -> DataFrame:
    """As ``score``, with every rare word scored as itself by ``counts`` (word, n) of a corpus.

    Tasks subtract log(N + 1) of its class for every rare word; what is left is log n: of the commoner ones from a table
    of bounded size, of the others joined from the counts, and 0 for words that are unseen or were seen once."""
    common = model.vocabulary.view(np.int64).tolist()
    rare = stored(counts.filter(~F.col("word").isin(common)) if common else counts)
    room = np.zeros(RARE)
    for r in rare.groupBy(F.col("word").bitwiseAND(F.lit(RARE - 1).cast("long")).alias("c")).agg(F.sum("n").alias("n")).collect():
        room[r["c"]] = r["n"]
    least = max(2, int(room.sum()) // TABLE + 1)
    table = rare.filter(F.col("n") >= least).orderBy("word").toArrow()
    words, logs = np.asarray(table.column(0)).astype(np.int64), np.log(np.asarray(table.column(1)).astype(np.float64))
    shared = docs.sparkSession.sparkContext.broadcast((model, np.log(room + 1), words, logs))

    @arrow_udf("struct<n:bigint,total:double,rare:array<struct<word:bigint,times:int>>>")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, shares, listed, more = shared.value
        for column in batches:
            none = np.zeros(0, np.int64)
            counts, sums, sizes, words, times = [none], [np.zeros(0)], [none], [none], [none]
            for block in blocks(column):
                hashes, n = word_hashes(block)
                ids, near, n = own.around(hashes, n)
                single = own.log_probability(ids, near)
                at = np.flatnonzero(ids >= own.shape.words)
                single[at] -= shares[(hashes[at] % np.uint64(RARE)).astype(np.int64)]
                left = np.zeros(len(ids), bool)
                left[at] = True
                if len(listed):
                    key = hashes[at].view(np.int64)
                    spot = np.minimum(np.searchsorted(listed, key), len(listed) - 1)
                    met = listed[spot] == key
                    single[at[met]] += more[spot[met]]
                    left[at[met]] = False
                total, end = np.concatenate([[0.0], np.cumsum(single)]), np.cumsum(n)
                counts.append(n)
                sums.append(total[end] - total[end - n])
                for held, found in zip((sizes, words, times), _told_apart(hashes, n, left)):
                    held.append(found)
            at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            pairs = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(words)), pa.array(np.concatenate(times).astype(np.int32))], names=["word", "times"])
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate(counts), pa.int64()), pa.array(np.concatenate(sums)), pa.ListArray.from_arrays(pa.array(at), pairs)],
                names=["n", "total", "rare"])

    rows = docs.select("doc_id", told(utf8(F.col("text"))).alias("s"))
    rows = stored(rows.select("doc_id", "s.n", "s.total", "s.rare", F.monotonically_increasing_id().alias("row")))
    known = rare.filter((F.col("n") > 1) & (F.col("n") < least)).select("word", F.log("n").alias("more"))
    more = rows.select("row", F.inline("rare")).join(known, "word").groupBy("row").agg(F.sum(F.col("times") * F.col("more")).alias("more"))
    whole = rows.select("doc_id", "n", "total", "row").join(more, "row", "left")
    return _report(whole, F.col("n"), F.col("total") + F.coalesce("more", F.lit(0.0)))


def _report(rows: DataFrame, n, total) -> DataFrame:
    mean = F.when(n > 0, total / n)
    return rows.select("doc_id", n.alias("n_words"), total.alias("log_likelihood"), mean.alias("mean_log_probability"), F.exp(-mean).alias("perplexity"))


def score(docs: DataFrame, model: Network) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, log_likelihood (sum over all words, natural log),
    mean_log_probability (null without words), perplexity (null without words).

    Null, empty and wordless texts have 0 words and log-likelihood 0.  Repeated rows score alike; other columns are
    left out.  No shuffle.  A rare word has the probability of its class; ``score_words`` tells it from the others."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<n:bigint,total:double>")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for column in batches:
            counts, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
            for block in blocks(column):
                ids, near, n = own.windows(block)
                total = np.concatenate([[0.0], np.cumsum(own.log_probability(ids, near))])
                end = np.cumsum(n)
                counts.append(n)
                sums.append(total[end] - total[end - n])
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(counts), pa.int64()), pa.array(np.concatenate(sums))], names=["n", "total"])

    return _report(docs.select("doc_id", told(utf8(F.col("text"))).alias("s")), F.col("s.n"), F.col("s.total"))
