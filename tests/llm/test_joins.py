"""The Jaccard join, the collocations and the conversation trie against plain computations, and on awkward rows."""

from collections import Counter, defaultdict
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webplan.llm import collocations, conversation_trie, jaccard_join
from webplan.session import ship_package

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, n bigint, key string, id bigint, head string, phrase string, score bigint"
TURNS = "conv_id bigint, turn bigint, role string, text string, node bigint, pos bigint, parent string, size string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, -1, "k", -1, "h", "p", -1) for i, t, lang in rows], DOCS)


# ---------------------------------------------------------------- Jaccard join


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    sets, top = [brute_set(t) for _, t, _ in rows], list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * len(a | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, *_) in enumerate(rows))


def edited_texts(rng, families, copies, edits, words=60):
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, words))]
        for _ in range(rng.randrange(1, copies)):
            own = list(base)
            for _ in range(rng.randrange(edits)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("room", [1 << 19, 3000])
def test_jaccard_classes_equal_all_pairs(spark, room):
    """With little room large groups are dealt in blocks, and their rest meets the other blocks."""
    rng = random.Random(room)
    texts = edited_texts(rng, 12, 25, 6) + edited_texts(rng, 60, 3, 2, 9)
    shared = " ".join(f"s{k}" for k in range(30))
    texts += [shared + " " + " ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(rng.randrange(1, 20))) for _ in range(40)]
    texts += [None, "", " \t\n", "ONE two", "one  TWO", "one two three four five", "é 漢字 x", texts[0], texts[0]]
    rng.shuffle(texts)
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(None, "one two", None), (None, None, None), (3, texts[3], "en"), (None, "all alone here", "x")]
    got = Counter(tuple(r) for r in jaccard_join.jaccard_classes(documents(spark, rows), room).collect())
    assert got == brute_classes(rows)


def test_jaccard_classes_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], None) for r in docs.collect()]
    assert Counter(tuple(r) for r in jaccard_join.jaccard_classes(docs).collect()) == brute_classes(rows)


def test_trees_rule_out_no_link():
    rng = np.random.default_rng(1)
    for trial in range(30):
        base = rng.integers(1 << 63, size=int(rng.integers(1, 300)), dtype=np.uint64)
        sets = []
        for _ in range(int(rng.integers(2, 60))):
            own = base[rng.random(len(base)) < rng.choice([0.95, 0.9, 0.6])]
            sets.append(np.unique(np.concatenate([own, rng.integers(1 << 63, size=int(rng.integers(1, 9)), dtype=np.uint64)])))
        left = {(min(i, j), max(i, j)) for x, y in jaccard_join.Tree.of(sets).pairs() for i, j in zip(x.tolist(), y.tolist())}
        for j in range(len(sets)):
            for i in range(j):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    assert (i, j) in left


def test_runs_cross_batches():
    rows = [(1, 5, 10), (1, 5, 11), (1, 9, 12), (2, 4, 13), (3, 4, 10), (3, 4, 13), (3, 5, 14), (3, 6, 15), (4, 1, 16)]
    want = {(10, 10, 5), (10, 11, 5), (10, 13, 4), (10, 14, 5), (10, 15, 6), (10, 10, 4)}
    for cut in range(1, 9):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in part]) for k in range(3)], names=["probe", "n", "id"])
                   for part in [rows[a : a + cut] for a in range(0, len(rows), cut)]]
        got = [r for b in jaccard_join._runs(iter(batches)) for r in zip(*(b.column(k).to_pylist() for k in range(3)))]
        assert set(got) == want and len(got) == len(want)


def test_joins_of_nothing_and_of_long_texts(spark):
    none = documents(spark, [])
    assert jaccard_join.jaccard_classes(none).count() == 0 and collocations.collocations(none).count() == 0
    assert jaccard_join.jaccard_classes(documents(spark, [(1, None, None), (2, "", "en")])).count() == 2
    long = " ".join(str(k * 7919 % 1000003) for k in range(700_000))
    got = jaccard_join.jaccard_classes(documents(spark, [(1, long, "x"), (2, "0 " + long, "x"), (3, long[: len(long) // 2], "x")])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 3)}


# ---------------------------------------------------------------- collocations


def brute_collocations(rows, least, top):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * f[p[i : i + m]]}
        told = []
        for p, a in found.items():
            if p not in gone:
                score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                told.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(told)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return out


def test_collocations_equal_plain_counts(spark):
    rng = random.Random(3)
    words = ["the", "The", "of", "a\x0b", "été", "漢字", "x\x00y", "new", "york", "times", "-"]
    joins = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "!? ", ":"]
    texts = ["".join(rng.choice(words[: rng.randrange(2, 12)]) + rng.choice(joins) for _ in range(rng.randrange(200))) for _ in range(60)]
    texts += ["new york times a " * 40, "new york times b; " * 30, "", None, " ,. ", texts[0], texts[0]]
    rows = [(k, t, rng.choice(["en", "de", None, "und", ""])) for k, t in enumerate(texts)]
    for least, top in ((3, 2000), (10, 7)):
        got = {tuple(r) for r in collocations.collocations(documents(spark, rows), least, 4, top).collect()}
        assert got == brute_collocations(rows, least, top)


def test_runs_of_counts_are_merged(monkeypatch):
    """However little a task holds, its counts add up to the same."""
    class Known:
        value = np.full(collocations.BITS >> 3, 255, np.uint8)

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(200)).encode() for _ in range(20)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * 20)], names=["text", "lang"])] * 3
    told = []
    for held in (1 << 20, 4):
        monkeypatch.setattr(collocations, "HELD", held)
        total = Counter()
        for b in collocations._counts(3, Known)(iter(batches)):
            for *w, n in zip(*(c.to_pylist() for c in b.columns)):
                total[tuple(w)] += n
        told.append(total)
    assert told[0] == told[1] and sum(told[0].values()) == 3 * 20 * 198


# ---------------------------------------------------------------- conversation trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, p in sorted(paths.items()):
        ends[p].append(c)
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
            if d:
                kids[p[: d - 1]].add(p[:d])
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return Counter((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def conversations(spark, rows):
    return spark.createDataFrame([(*r, -1, -1, "p", "s") for r in rows], TURNS)


def talk(rng, n):
    rows = []
    for c in sorted(rng.sample(range(-300, 900), n)) + [100, 5_000_000_000]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([turn, turn, turn - 3]) * 1000 + turn, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "no 漢字", None, ""])))
    return rows


@pytest.mark.parametrize("arcs", [20_000, 60, 7])
def test_trie_equals_plain_trie(spark, arcs, monkeypatch):
    monkeypatch.setattr(conversation_trie, "SLICE", 3 if arcs == 60 else 4096)
    rng = random.Random(arcs)
    rows = talk(rng, 90 if arcs > 7 else 15) + [(None, 1, "user", "lost"), (200, None, "user", "first"), (777, 1, "a", "same"), (777, 1, "a", "same"), (778, 1, "a", "same")]
    rows += [(c, 0, "user", "hello") for c in range(1000, 1090)]
    rng.shuffle(rows)
    got = Counter(tuple(r) for r in conversation_trie.prefix_trie(conversations(spark, rows), arcs).collect())
    assert got == brute_trie(rows)


def test_trie_of_nothing_and_of_long_conversations(spark):
    assert conversation_trie.prefix_trie(conversations(spark, [])).count() == 0
    assert conversation_trie.prefix_trie(conversations(spark, [(None, 1, "user", "lost")])).count() == 0
    rows = [(1, k, "user", str(k)) for k in range(6000)] + [(2, k, "user", str(k)) for k in range(6000)]
    assert Counter(tuple(r) for r in conversation_trie.prefix_trie(conversations(spark, rows), 3000).collect()) == brute_trie_chain(rows)


def brute_trie_chain(rows):
    """As brute_trie, for two long conversations: a path that forks where they part."""
    own = {c: [("user", t) for d, _, _, t in rows if d == c] for c in (1, 2)}
    cut = {c: own[c][zlib.crc32(str(c).encode()) % 6 :] for c in own}
    size, same = {c: len(p) for c, p in cut.items()}, 0
    while same < min(size.values()) and cut[1][same] == cut[2][same]:
        same += 1
    none, sha = hashlib.sha256(b"").hexdigest(), lambda x: hashlib.sha256(x.encode()).hexdigest()
    fork = same < min(size.values())
    out = Counter()
    saved = 0
    below = [0] * (same + 1)
    for d in range(same, -1, -1):
        if d:
            saved += len(cut[1][d - 1][1])
        below[d] = saved
    for d in range(same + 1):
        here = [c for c in (1, 2) if size[c] == d]
        kids = 2 if fork and d == same else 1 if d < max(size.values()) else 0
        out[(1, d, 1 if d else None, 2, kids, 2 if fork else 1, below[d], sha(",".join(map(str, here))) if here else none)] += 1
    for c in (1, 2):
        for d in range(same + 1, size[c] + 1):
            out[(c, d, 1 if d == same + 1 else c, 1, int(d < size[c]), 1, 0, sha(str(c)) if d == size[c] else none)] += 1
    return out


def test_a_list_far_from_any_order_is_ranked(spark):
    """Places that say nothing about neighbours: the list is still shortened, and every sum is right."""
    rng = random.Random(9)
    order = rng.sample(range(10_000), 1000)
    rows = [(a, b, rng.randrange(10**6), 1, a) for a, b in zip(order, order[1:] + [-1])]
    links = spark.createDataFrame(rows, conversation_trie.LINK)
    got = {r["arc"]: (r["leaves"], r["saved"]) for r in conversation_trie.ranked(links, 120).collect()}
    total, want = 0, {}
    for k, a in enumerate(order, 1):
        total += a
        want[a] = (k, total)
    assert got == want
