"""Mixing sources by temperature, to a target entropy or a repetition limit.

With token shares s of the sources, the mixture of exponent a has weights s^a / sum(s^a): a = 1 keeps the shares, a = 0
makes all sources equal.  The exponent is bisected until the mixture meets the target, and the weights are realised as
block permutations: a source whose budget is b blocks of its own size gives floor(b) whole permutations of its
documents and a part of one more, cut where its budget ends.

Sums over sources are taken by Spark; a pass evaluates all 63 midpoints that six steps of the bisection can ask for,
so the number of sources is not bounded by the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from webplan.llm.common import settled

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of a document's place in a permutation by which its source is cut into pieces of like size.
PIECE = 3
#: Steps taken in one pass, and passes: 42 steps leave an interval of 2e-13.
STEPS, PASSES = 6, 7
#: Sources up to which their plan is sent to every task; beyond, documents are joined to it by shuffle.
SMALL_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(seed: int, doc_id: Column) -> Column:
    """A document's place in the permutation of its source, equal on every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _moments(sources: DataFrame, exponents: list[float]) -> dict[float, dict]:
    grid = F.array(*[F.lit(float(a)) for a in exponents])
    part = sources.filter("tokens > 0").select(F.ln("share").alias("l"), F.explode(grid).alias("a"))
    rows = part.groupBy("a").agg(
        F.sum(F.exp(F.col("a") * F.col("l"))).alias("z"),
        F.sum(F.exp(F.col("a") * F.col("l")) * F.col("l")).alias("zl"),
        F.max(F.col("l")).alias("top"), F.min(F.col("l")).alias("low"),
    )
    return {r["a"]: r.asDict() for r in rows.collect()}


def _entropy(m: dict) -> float:
    return math.log(m["z"]) - m["a"] * m["zl"] / m["z"]


def _repeats(m: dict) -> float:
    """Passes over the most repeated source for one over the least repeated."""
    return math.exp(abs(1 - m["a"]) * (m["top"] - m["low"]))


def find_exponent(sources: DataFrame, entropy: float | None = None, repeats: float | None = None) -> float:
    """The exponent in [0, 1] at which the mixture has ``entropy`` nats, or the least at which no source is passed
    over more than ``repeats`` times as often as another.  Out of reach means the nearest end."""
    if (entropy is None) == (repeats is None):
        raise ValueError("give either entropy or repeats")
    high_enough = (lambda m: _entropy(m) <= entropy) if repeats is None else (lambda m: _repeats(m) <= repeats)
    low, high = 0.0, 1.0
    ends = _moments(sources, [low, high])
    if not ends or high_enough(ends[low]):
        return low
    if not high_enough(ends[high]):
        return high
    for _ in range(PASSES):
        step = (high - low) / (1 << STEPS)
        points = _moments(sources, [low + step * i for i in range(1, 1 << STEPS)])
        for _ in range(STEPS):
            middle = min(points, key=lambda a: abs(a - (low + high) / 2))
            low, high = (low, middle) if high_enough(points[middle]) else (middle, high)
    return high


def source_plan(
    docs: DataFrame, entropy: float | None = None, repeats: float | None = 2.0, budget: int | None = None, seed: int = 0
) -> DataFrame:
    """Documents (doc_id, text, source) -> one row per source: source, n_docs, tokens, share, weight, budget_tokens,
    blocks (whole permutations) and upto (the last place of the partial one; null if there is none).

    Without ``budget`` the total is the least at which every source runs through once, so that no document is lost;
    a smaller one leaves documents out, as asked.  A null source is the source named ''.  A source without a word
    runs through once.  Documents with equal places (repeated rows) are in a partial block together or not at all."""
    slim = settled(docs.select(
        F.coalesce("source", F.lit("")).alias("source"), words(F.col("text")).alias("tokens"),
        place(seed, F.col("doc_id")).alias("place"),
    ))
    pieces = settled(slim.groupBy("source", F.substring("place", 1, PIECE).alias("piece")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("tokens")))
    sizes = pieces.groupBy("source").agg(F.sum("n_docs").alias("n_docs"), F.sum("tokens").alias("tokens"))
    total = sizes.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    sources = settled(sizes.withColumn("share", F.col("tokens") / F.lit(float(max(1, total)))))
    a = find_exponent(sources, entropy, None if entropy is not None else repeats)
    tempered = F.when(F.col("tokens") > 0, F.pow("share", F.lit(a))).otherwise(0.0)
    sums = sources.agg(F.sum(tempered).alias("z"), F.max(F.when(F.col("tokens") > 0, F.col("share") / tempered)).alias("m"))
    z, most = sums.first()
    z, most = z or 1.0, most or 1.0
    wanted = float(budget) if budget is not None else total * z * most
    budgeted = F.floor(F.col("weight") * F.lit(wanted)).cast("long")
    plan = sources.withColumn("weight", tempered / F.lit(z)).withColumn(
        # the least budget gives the least repeated source its own size, which rounding must not lower
        "budget_tokens", F.greatest(budgeted, "tokens") if budget is None else budgeted
    ).withColumn(
        "blocks", F.when(F.col("tokens") > 0, F.floor(F.col("budget_tokens") / F.col("tokens"))).otherwise(1).cast("long")
    ).withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget_tokens") - F.col("blocks") * F.col("tokens")).otherwise(-1))
    upto = pieces.withColumn("upto", F.sum("tokens").over(W.partitionBy("source").orderBy("piece")))
    # the last piece that fits as a whole, and the piece in which the budget ends
    near = upto.join(plan.select("source", "rest"), "source")
    whole = near.filter("upto <= rest").groupBy("source").agg(F.max("piece").alias("whole"), F.max("upto").alias("done"))
    ends = near.filter("upto > rest and rest >= 0").groupBy("source").agg(F.min("piece").alias("piece"))
    edge = (
        slim.withColumn("piece", F.substring("place", 1, PIECE))
        .join(ends, ["source", "piece"])
        .join(whole.select("source", "done"), "source", "left")
        .join(plan.select("source", "rest"), "source")
        .withColumn("run", F.coalesce("done", F.lit(0)) + F.sum("tokens").over(W.partitionBy("source", "piece").orderBy("place")))
        .filter("run <= rest").groupBy("source").agg(F.max("place").alias("upto"))
    )
    last = whole.select("source", F.concat("whole", F.lit("g")).alias("after"))  # after every place of the piece
    return (
        plan.join(last, "source", "left").join(edge, "source", "left")
        .withColumn("upto", F.coalesce("upto", "after"))
        .select("source", "n_docs", "tokens", "share", "weight", "budget_tokens", "blocks", "upto")
    )


def mix_sources(docs: DataFrame, plan: DataFrame, seed: int = 0, names: tuple[str, str] = ("block", "place")) -> DataFrame:
    """Every document once per block that draws it: the columns of ``docs``, with its block (0 and up) and place (its order
    inside a block: blocks are permutations of their own) under ``names``.  Columns of these names are replaced."""
    rows = docs.drop(*names)
    per = settled(plan.select(F.col("source").alias("__source"), F.col("blocks").alias("__blocks"), F.col("upto").alias("__upto")))
    small = per.count() <= SMALL_SOURCES
    drawn = rows.withColumn("__place", place(seed, F.col("doc_id"))).join(
        F.broadcast(per) if small else per, F.coalesce(F.col("source"), F.lit("")) == F.col("__source")
    )
    times = F.col("__blocks") + F.when(F.col("__place") <= F.col("__upto"), 1).otherwise(0)
    return (
        drawn.withColumn("__times", times).filter("__times > 0")
        .withColumn(names[0], F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1)))
        .withColumn(names[1], F.md5(F.concat(F.col(names[0]).cast("string"), F.lit(":"), "__place")))
        .select(*[F.col(f"`{c}`") for c in rows.columns], *names)
    )
