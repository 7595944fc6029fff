"""The trie of conversation prefixes, with subtree totals by the Euler-tour technique.

A node is a distinct sequence of first turns.  A prefix is told by sums over its turns of hashes of (place, role, text),
four of 32 bits, so prefixes are running sums: no turn waits for the one before it, and no text travels.

Every node has an arc that enters it and one that leaves it.  After entering comes the first child, or leaving; after
leaving the next sibling, or leaving the parent.  The tour so linked is ranked by contraction: arcs are dealt by their
node's smallest conversation, so that neighbours mostly meet; each task joins what it holds of the tour into chains, the
chains are dealt anew to fewer tasks, and so on until one task of bounded size holds the rest.  Going back, every arc gets
the weights before it.  Leaves and savings weigh on entering arcs: a subtree's total is the difference between the sums
at its two arcs."""

from __future__ import annotations

from collections.abc import Iterator
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from webplan.llm.common import discard, stored

#: Conversations whose own numbers agree but for the last two digits share their first turns; at most SHARED - 1 of them.
FAMILY, SHARED = 100, 6
#: Turns, or children, that are ordered in one task; longer sequences are ordered slice by slice.
SLICE = 4096
#: Arcs dealt to a task.
ARCS = 20_000
_SUMS = ["s1", "s2", "s3", "s4"]


def _slice(column: str) -> Column:
    return F.floor(F.col(column) / SLICE)


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), n (turns of the conversation), role, text; null turns first, equal turns by role and text."""
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("conv_id", "turn", F.xxhash64("role").alias("role"), *[F.xxhash64(F.lit(i), "role", F.lit("\n"), "text").alias(f"h{i}") for i in (1, 2)],
                       F.length("text").cast("long").alias("size")).withColumn("part", _slice("turn"))
    # the order of role and text only needs to be the same for equal turns, so their hashes do
    own = F.row_number().over(W.partitionBy("conv_id", "part").orderBy("turn", "role", "h1", "h2"))
    parts = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("m"))
    before = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("part"))
    parts = parts.select("conv_id", "part", (F.sum("m").over(before) - F.col("m")).alias("skip"), F.sum("m").over(W.partitionBy("conv_id")).alias("n"))
    parts = parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "skip", "n")
    placed = rows.withColumn("own", own).join(parts, (F.col("conv_id") == F.col("c")) & F.col("part").eqNullSafe(F.col("p")))
    return placed.select("conv_id", (F.col("own") + F.col("skip")).alias("pos"), "n", "h1", "h2", "size")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of every rebuilt conversation (c, pos, h1, h2, size), and all conversations (c).

    The first crc32(c) % 6 turns come from the conversation that opens the hundred of c, the others are its own."""
    turns = stored(turns_in_order(conversations))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    own = turns.withColumn("h", shared)
    convs = turns.filter("pos = 1").select(F.col("conv_id").alias("c"), shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    head = turns.filter((F.col("pos") < SHARED) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), "pos", "n", "h1", "h2", "size")
    given = convs.join(head, "base").filter("pos <= h")
    taken = head.filter("pos = 1").select("base", F.col("n").alias("n_base"))
    own = own.filter("pos > h").withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(taken, "base", "left")
    place = F.col("pos") - F.col("h") + F.least("h", F.coalesce("n_base", F.lit(0)))
    fields = ["h1", "h2", "size"]
    return own.select(F.col("conv_id").alias("c"), place.alias("pos"), *fields).unionByName(given.select("c", "pos", *fields)), convs.select("c")


def _prefix_sums(turns: DataFrame) -> DataFrame:
    """c, pos, size, the sums of the prefix that ends here (s1..s4), and of the one before (p1..p4)."""
    halves = []
    for i in (1, 2):
        x = F.xxhash64("pos", f"h{i}")
        halves += [x.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(x, 32)]
    rows = turns.select("c", "pos", "size", *[h.alias(f"x{k + 1}") for k, h in enumerate(halves)], _slice("pos").alias("part"))
    run = W.partitionBy("c", "part").orderBy("pos")
    parts = rows.groupBy("c", "part").agg(*[F.sum(f"x{k}").alias(f"t{k}") for k in range(1, 5)])
    before = W.partitionBy("c").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("c").alias("c2"), F.col("part").alias("part2"), *[F.coalesce(F.sum(f"t{k}").over(before), F.lit(0)).alias(f"t{k}") for k in range(1, 5)])
    within = rows.select("*", *[F.sum(f"x{k}").over(run).alias(f"r{k}") for k in range(1, 5)])
    joined = within.join(parts, (F.col("c") == F.col("c2")) & (F.col("part") == F.col("part2")))
    total = [F.col(f"r{k}") + F.col(f"t{k}") for k in range(1, 5)]
    return joined.select("c", "pos", "size", *[t.alias(f"s{k + 1}") for k, t in enumerate(total)], *[(t - F.col(f"x{k + 1}")).alias(f"p{k + 1}") for k, t in enumerate(total)])


# ---------------------------------------------------------------- list ranking

LINK = "arc bigint, next bigint, place bigint, leaves bigint, saved bigint"


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arcs (arc, next, place, leaves, saved) -> the same with head, and the sums of their chain up to and with each:
    arc, head, leaves, saved, and on a chain's last arc also next, place of the head."""
    held: list[pa.RecordBatch] = []

    def done() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        arc, nxt, place, leaves, saved = (np.asarray(table.column(i).combine_chunks()).astype(np.int64) for i in range(5))
        order = np.argsort(arc)
        at = np.searchsorted(arc[order], nxt)
        at[at == len(arc)] = 0
        follow = order[at]
        local = arc[follow] == nxt
        first = np.ones(len(arc), bool)
        first[follow[local]] = False
        follow, local = follow.tolist(), local.tolist()
        rows, heads, a, b, last = [], [], [], [], []
        w, v = leaves.tolist(), saved.tolist()
        for head in np.flatnonzero(first).tolist():
            i, x, y = head, 0, 0
            while True:
                x, y = x + w[i], y + v[i]
                rows.append(i)
                heads.append(head)
                a.append(x)
                b.append(y)
                if not local[i]:
                    last.append(True)
                    break
                last.append(False)
                i = follow[i]
        rows, heads, last = np.array(rows), np.array(heads), np.array(last)
        yield pa.RecordBatch.from_arrays(
            [pa.array(arc[rows]), pa.array(arc[heads]), pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64)),
             pa.array(nxt[rows], mask=~last), pa.array(place[heads])], names=["arc", "head", "leaves", "saved", "next", "place"])

    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= 10 * ARCS:
            yield from done()
            held, size = [], 0
    if size:
        yield from done()


def _spliced(links: DataFrame, turn: int) -> DataFrame:
    """Links with about a quarter of all arcs joined to the one before them: an arc goes in at another's end where a coin
    falls heads for the first and tails for the second.  As _chains tells it."""
    coin = lambda c: F.xxhash64(F.lit(turn), c).bitwiseAND(F.lit(1).cast("long")) == 1
    goes = coin("arc") & ~coin("next") & (F.col("next") != -1)
    before = links.filter(goes).select(F.col("arc").alias("b_arc"), F.col("next").alias("b_next"), F.col("place").alias("b_place"),
                                                               F.col("leaves").alias("b_leaves"), F.col("saved").alias("b_saved"))
    joined = links.join(before, F.col("arc") == F.col("b_next"), "left")
    gone = links.filter(goes).select(F.col("next").alias("g"))
    ends = links.join(gone, F.col("next") == F.col("g"), "left")
    tails = joined.filter("b_arc is not null").select(
        "arc", F.col("b_arc").alias("head"), (F.col("leaves") + F.col("b_leaves")).alias("leaves"), (F.col("saved") + F.col("b_saved")).alias("saved"), "next",
        F.col("b_place").alias("place"))
    heads = ends.join(tails.select(F.col("arc").alias("t")), F.col("arc") == F.col("t"), "left_anti").select(
        "arc", F.col("arc").alias("head"), "leaves", "saved", F.when(F.col("g").isNull(), F.col("next")).alias("next"), "place")
    return heads.unionByName(tails)


def ranked(links: DataFrame, arcs: int = ARCS) -> DataFrame:
    """One list (arc, next, place, leaves, saved; -1 follows its last arc) -> arc, leaves, saved: the sums of the weights
    of all arcs up to and with it.  ``place`` is a number by which neighbours in the list mostly lie near each other."""
    levels, links = [], stored(links)
    size, turn = links.count(), 0
    while size:
        tasks = -(-size // arcs)
        dealt = links.repartitionByRange(tasks, "place", "arc") if tasks > 1 else links.repartition(1)
        told = stored(dealt.mapInArrow(_chains, "arc bigint, head bigint, leaves bigint, saved bigint, next bigint, place bigint"))
        levels.append(told)
        if tasks == 1:
            break
        links = stored(told.filter("next is not null").select(F.col("head").alias("arc"), "next", "place", "leaves", "saved"))
        left = links.count()
        if left > 0.75 * size:
            # neighbours were far apart: a step that shortens the list whatever the places are
            turn += 1
            told = stored(_spliced(links, turn))
            levels.append(told)
            links = stored(told.filter("next is not null").select(F.col("head").alias("arc"), "next", "place", "leaves", "saved"))
            left = links.count()
        size = left
    if not levels:
        return links.select("arc", "leaves", "saved")
    # back: the sums of a chain begin where the one before its head ended
    done = levels[-1].select("arc", "leaves", "saved")
    for told in reversed(levels[:-1]):
        whole = told.filter("next is not null").select(F.col("head").alias("c_head"), F.col("leaves").alias("c_leaves"), F.col("saved").alias("c_saved"))
        start = done.join(whole, F.col("arc") == F.col("c_head")).select(
            F.col("arc").alias("at"), (F.col("leaves") - F.col("c_leaves")).alias("l0"), (F.col("saved") - F.col("c_saved")).alias("s0"))
        done = told.join(start, F.col("head") == F.col("at")).select("arc", (F.col("leaves") + F.col("l0")).alias("leaves"), (F.col("saved") + F.col("s0")).alias("saved"))
    return done


# ---------------------------------------------------------------- the trie


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, c) in their order -> node, SHA-256 of the comma-joined numbers; holds the state of one digest."""
    held, digest, nodes, told = None, None, [], []
    for batch in batches:
        node, c = np.asarray(batch.column(0)), batch.column(1).to_pylist()
        edge = np.append(np.flatnonzero(np.append(True, node[1:] != node[:-1])), len(node)) if len(node) else np.zeros(1, np.int64)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            part = ",".join(map(str, c[a:b])).encode()
            if node[a] == held:
                digest.update(b"," + part)
            else:
                if held is not None:
                    nodes.append(held)
                    told.append(digest.hexdigest())
                held, digest = int(node[a]), hashlib.sha256(part)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(told, pa.string())], names=["node", "ends_sha256"])
        nodes, told = [], []
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])


def prefix_trie(conversations: DataFrame, arcs: int = ARCS) -> DataFrame:
    """One row per node of the trie of rebuilt ``conversations`` (conv_id, turn, role, text): conv_id (smallest member),
    depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, nulls first; equal turns in a fixed order of their own.  A null role or text is empty.
    Rows without conv_id belong to no conversation and are left out.  Rows that are repeated are turns of their own.
    Other columns are left out.  Without conversations there is no root, and the result is empty."""
    turns, convs = rebuilt(conversations)
    sums = stored(_prefix_sums(turns))
    zero = [F.lit(0).cast("long")] * 4
    rows = sums.groupBy("pos", *_SUMS).agg(
        F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("size").alias("size"), *[F.min(f"p{k}").alias(f"p{k}") for k in range(1, 5)])
    root = convs.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        F.lit(0).cast("long").alias("pos"), *[z.alias(s) for z, s in zip(zero, _SUMS)], "conv_id", "n_convs", F.lit(0).cast("long").alias("size"),
        *[F.lit(None).cast("long").alias(f"p{k}") for k in range(1, 5)])
    nodes = stored(rows.select(root.columns).unionByName(root).withColumn("node", F.monotonically_increasing_id()))
    # conversations that end at a node
    last = sums.groupBy("c").agg(F.max_by(F.struct("pos", *_SUMS), "pos").alias("e"))
    ends = convs.join(last, "c", "left").select("c", *[F.coalesce(f"e.{x}", F.lit(0).cast("long")).alias(x) for x in ("pos", *_SUMS)])
    ends = ends.join(nodes.select("pos", *_SUMS, "node"), ["pos", *_SUMS]).select("node", "c")
    digests = ends.repartition("node").sortWithinPartitions("node", "c").mapInArrow(_digests, "node bigint, ends_sha256 string")
    # parents, and the order of children
    up = nodes.select((F.col("pos") + 1).alias("pos"), *[F.col(s).alias(f"p{k + 1}") for k, s in enumerate(_SUMS)], F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    tree = stored(nodes.join(up, ["pos", "p1", "p2", "p3", "p4"], "left").select("node", "pos", "conv_id", "n_convs", "size", "parent", "parent_conv_id"))
    child = tree.filter("parent is not null").select("parent", "conv_id", "node", _slice("conv_id").alias("part"))
    heads = child.groupBy("parent", "part").agg(F.min_by("node", "conv_id").alias("first"), F.count(F.lit(1)).alias("m"))
    family = heads.groupBy("parent").agg(F.min_by("first", "part").alias("first_child"), F.sum("m").alias("n_children")).withColumnRenamed("parent", "node")
    heads = heads.select(F.col("parent").alias("q"), F.col("part").alias("p"), F.lead("first").over(W.partitionBy("parent").orderBy("part")).alias("beyond"))
    near = child.withColumn("sibling", F.lead("node").over(W.partitionBy("parent", "part").orderBy("conv_id")))
    near = near.join(heads, (F.col("parent") == F.col("q")) & (F.col("part") == F.col("p"))).select("node", F.coalesce("sibling", "beyond").alias("sibling"))
    full = stored(tree.join(family, "node", "left").join(near, "node", "left").join(digests, "node", "left"))
    leaf, weight = F.col("first_child").isNull().cast("long"), (F.col("n_convs") - 1) * F.col("size")
    enter, leave = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    none = F.lit(0).cast("long")
    links = full.select(F.explode(F.array(
        F.struct(enter("node").alias("arc"), F.coalesce(enter("first_child"), leave("node")).alias("next"), F.col("conv_id").alias("place"), leaf.alias("leaves"), weight.alias("saved")),
        F.struct(leave("node").alias("arc"), F.coalesce(enter("sibling"), leave("parent"), F.lit(-1).cast("long")).alias("next"), F.col("conv_id").alias("place"), none.alias("leaves"), none.alias("saved")),
    )).alias("l")).select("l.*")
    at = ranked(links, arcs).withColumn("node", F.floor(F.col("arc") / 2))
    span = at.groupBy("node").agg(*[F.max(F.when(F.col("arc") % 2 == side, F.col(x))).alias(f"{x}{side}") for side in (0, 1) for x in ("leaves", "saved")])
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return full.join(span, "node").select(
        "conv_id", F.col("pos").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", none).alias("n_children"),
        (F.col("leaves1") - F.col("leaves0") + leaf).alias("n_leaves"), (F.col("saved1") - F.col("saved0") + weight).alias("saved_tokens"),
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
