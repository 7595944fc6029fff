"""Every operator against a plain computation on small tables, and on awkward rows."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from webplan.llm import (
    components, decontaminate, langid, line_dedup, lm_scoring, mixing, queries, sharding, simhash, tokens, topk, url_filter,
)
from webplan.session import ship_package

SF, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "lorem ipsum dolor sit amet " * 40_000
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "The cat sat.", "en", None, 1),
    (None, None, None, None, None), (3, " \n\t ", None, "a", 3), (4, "12 345 !!", "en", "b", 9), (5, LONG, "la", "b", 1),
    (6, "The cat sat.", "en", "b", 1), (7, "ÀÉ ñandú\x00x ▁ y\r\nz 漢字", "es", "", 1), (8, "one", "en", "c", 1), (8, "one", "en", "c", 1),
]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows, with columns named as what the operators make."""
    names = ("found", "language", "shard", "slot", "block", "place", "n_words", "fp", "keep", "line", "rank", "score")
    df = spark.createDataFrame(ODD, DOCS)
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in names])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r["doc_id"]: r for r in docs.collect()}


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def piece_path():
    import public_tokenizers

    return public_tokenizers.path(queries.PIECES)


# ---------------------------------------------------------------- token counts


def test_token_counts_equal_the_library(docs, odd, rows):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=piece_path())
    for r in tokens.token_counts(docs, piece_path()).collect():
        text = rows[r["doc_id"]]["text"]
        assert r["n_tokens"] == len(lib.encode(text)) and r["n_bytes"] == len(text.encode())
        assert r["over_limit"] == (r["n_tokens"] > 4096)
    got = Counter((r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(odd, piece_path()).collect())
    assert got == Counter((i, len(lib.encode(t or ""))) for i, t, *_ in ODD)


def test_token_counts_of_any_text():
    own = tokens.PieceCounter(piece_path())
    assert own.cuts and own.whole[" the"] == 1
    rng = random.Random(1)
    parts = [" ", "  ", "▁", "\n", "\t", "\r\n", "the", "<s>", "</s>", "<0x0A>", "é", "漢", "😀", "1", "23", "abc", "\x00", "ab\u0301", "    ", ",", "ing"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert own.count(text) == len(own.library.encode(text)), repr(text)


def test_token_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 10)
    own = tokens.PieceCounter(piece_path())
    for i in range(50):
        text = f"wörd{i} thing{i * 7}"
        assert own.count(text) == len(own.library.encode(text))
    assert len(own.known) <= len(own.whole) + 10


# ---------------------------------------------------------------- language-model scores


def test_scores_are_sums_of_conditional_log_probabilities():
    shape = lm_scoring.Shape(words=20, dims=5, batch=7)
    texts = [b"The cat, the dog", b"", b"  ", "été cat the cat sat on a mat by the dog".encode(), b"one"]
    hashes, n = lm_scoring.word_hashes(texts)
    assert n.tolist() == [4, 0, 0, 11, 1]
    assert hashes[0] == hashes[2] and hashes[1] == hashes[5] and len(set(hashes.tolist())) == len({*b"the cat dog".split(), *"été sat on a mat by one".encode().split()})
    model = lm_scoring.Network(np.unique(hashes)[:8], shape)
    ids, near, _ = model.windows(texts)
    got, at, w = model.log_probability(ids, near), 0, model.weights
    for count in n:
        own = ids[at : at + count].tolist()
        for i, word in enumerate(own):
            around = [own[j] if 0 <= j < count else model.n_ids for j in (i - 2, i - 1, i + 1, i + 2)]
            h = np.tanh(sum(w["embed"][a] * w["place"][k] for k, a in enumerate(around)) + w["bias"])
            soft = lambda z: z - math.log(np.exp(z).sum())
            g, m = word % lm_scoring.CLASSES, word // lm_scoring.CLASSES
            want = soft(w["class_out"] @ h + w["class_bias"])[g] + soft(w["word_out"][g] @ h + w["word_bias"][g])[m]
            assert abs(got[at + i] - want) < 1e-4
        at += count


def test_every_word_is_a_training_target_once():
    texts = [b"The cat, the dog", b"", "été cat the cat sat on a mat by the dog".encode(), b"one"]
    model = lm_scoring.Network(np.unique(lm_scoring.word_hashes(texts)[0])[:8], lm_scoring.Shape(words=20, dims=5, batch=7))
    told = list(lm_scoring._train(model)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    assert {n for b in told for n in b.column(2).to_pylist()} == {4 + 11 + 1}


def test_gradient_is_that_of_the_loss():
    shape = lm_scoring.Shape(words=30, dims=4, batch=64, rate=0.0)
    text = [b"a b c d e f a b c a b d e a f c b a d c e b a"]
    hashes, _ = lm_scoring.word_hashes(text)
    model = lm_scoring.Network(np.unique(hashes), shape)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    ids, near, _ = model.windows(text)
    memory = {k: np.zeros_like(v) for k, v in model.weights.items()}
    model.descend(ids, near, memory)  # memory: squared gradients
    for k, at in (("embed", (ids[3], 1)), ("place", (2, 0)), ("bias", (1,)), ("class_out", (ids[0] % 32, 2)), ("word_bias", (ids[0] % 32, ids[0] // 32))):
        loss = []
        for step in (1e-5, -1e-5):
            model.weights[k][at] += step
            loss.append(-model.log_probability(ids, near).mean())
            model.weights[k][at] -= step
        assert abs(((loss[0] - loss[1]) / 2e-5) ** 2 - memory[k][at]) < 1e-6, k


def test_training_beats_word_frequencies(docs, odd, none):
    model = lm_scoring.train(docs)
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, model).collect()}
    counts = Counter()
    for r in docs.select("text").collect():
        hashes, _ = lm_scoring.word_hashes([r["text"].encode()])
        counts.update(model.ids(hashes).tolist())
    total = sum(counts.values())
    plain = sum(n * math.log(n / total) for n in counts.values()) / total
    own = sum(r["log_likelihood"] for r in got.values()) / sum(r["n_words"] for r in got.values())
    assert sum(r["n_words"] for r in got.values()) == total and own > plain
    strange = lm_scoring.score(odd, model).collect()
    assert len(strange) == len(ODD) and {r["log_likelihood"] for r in strange if r["n_words"] == 0} == {0.0}
    assert all(r["mean_log_probability"] is None for r in strange if r["n_words"] == 0)
    empty = lm_scoring.train(none)
    assert lm_scoring.score(none, empty).collect() == [] and lm_scoring.score(odd, empty).count() == len(ODD)


@pytest.mark.parametrize("table", [1 << 21, 80, 1])
def test_rare_words_are_scored_as_themselves(spark, odd, table, monkeypatch):
    monkeypatch.setattr(lm_scoring, "TABLE", table)
    text = " ".join(f"the of w{i % 300 if i % 3 else i % 30}" for i in range(1500))
    corpus = spark.createDataFrame([(1, text), (2, "the of"), (3, None)], "doc_id long, text string")
    counts = lm_scoring.word_counts(corpus)
    model = lm_scoring.train(corpus, lm_scoring.Shape(words=2, dims=4), counts)
    seen = {r["word"] % 2**64: r["n"] for r in counts.collect()}
    size = Counter()
    for word, n in seen.items():
        if np.uint64(word) not in model.vocabulary:
            size[word % lm_scoring.RARE] += n
    rows = [(1, "the w3 of w3 w7 w299 zzz"), (1, "the w3 of w3 w7 w299 zzz"), (2, "the of"), (3, ""), (None, None), (4, "zzz qqq"), (5, text)]
    got = lm_scoring.score_words(spark.createDataFrame(rows, "doc_id long, text string"), model, counts).collect()
    want = []
    for d, t in rows:
        hashes, _ = lm_scoring.word_hashes([(t or "").encode()])
        ids, near, _ = model.windows([(t or "").encode()])
        rare = [x for x, i in zip(hashes.tolist(), ids.tolist()) if i >= 2]
        total = model.log_probability(ids, near).sum() + sum(math.log(seen.get(x, 1) / (size[x % lm_scoring.RARE] + 1)) for x in rare)
        want.append((d, len(ids), total))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and abs(g["log_likelihood"] - w[2]) < 1e-6 * max(1, abs(w[2]))
    assert lm_scoring.score_words(odd, model, counts).count() == len(ODD)


def test_word_counts_are_exact(docs):
    got = {r["word"]: r["n"] for r in lm_scoring.word_counts(docs).collect()}
    words = Counter(w for r in docs.collect() for w in r["text"].encode().translate(lm_scoring.FOLD).split())
    assert sorted(got.values()) == sorted(words.values())


# ---------------------------------------------------------------- mixing


def brute_mix(rows, repeats, seed=0):
    n_words = lambda t: len((t or "").encode().translate(simhash.FOLD).split())
    source, size = defaultdict(list), Counter()
    for r in rows:
        s, t = r["source"] or "", n_words(r["text"])
        source[s].append((hashlib.md5(f"{seed}:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest(), t, r["doc_id"]))
        size[s] += t
    total = sum(size.values())
    live = {s: n / total for s, n in size.items() if n}
    a = max(0.0, 1 - math.log(repeats) / math.log(max(live.values()) / min(live.values()))) if len(set(live.values())) > 1 else 0.0
    most = max(x / x**a for x in live.values())
    out = Counter()
    for s, docs in source.items():
        if not size[s]:
            out.update((s, d) for _, _, d in docs)
            continue
        budget = max(size[s], math.floor(live[s] ** a * most * total + 1e-9))
        blocks, rest = divmod(budget, size[s])
        out.update({(s, d): 0 for _, _, d in docs})
        run = 0
        for _ in range(blocks):
            out.update((s, d) for _, _, d in docs)
        if rest:
            for _, same in itertools.groupby(sorted(docs, key=lambda x: x[0]), key=lambda x: x[0]):
                same = list(same)
                run += sum(t for _, t, _ in same)
                if run > rest:
                    break
                out.update((s, d) for _, _, d in same)
    return out


@pytest.mark.parametrize("repeats", [1.5, 2.0, 3.0])
def test_mixing_equals_a_plain_computation(docs, repeats):
    plan = mixing.source_plan(docs, repeats=repeats)
    got = Counter((r["source"], r["doc_id"]) for r in mixing.mix_sources(docs, plan).collect())
    want = brute_mix(docs.collect(), repeats)
    assert sum(abs(got[k] - want[k]) for k in want) <= len(plan.collect())  # a budget may round to one word less
    assert set(got) == set(want)


def test_mixing_meets_entropy_budget_and_limits(docs):
    shares = [r["share"] for r in mixing.source_plan(docs).collect()]
    target = (math.log(len(shares)) - sum(x * math.log(x) for x in shares)) / 2
    plan = mixing.source_plan(docs, entropy=target, repeats=None).collect()
    assert abs(-sum(r["weight"] * math.log(r["weight"]) for r in plan) - target) < 1e-9
    assert abs(sum(r["weight"] for r in plan) - 1) < 1e-12
    total = sum(r["tokens"] for r in plan)
    half = mixing.source_plan(docs, repeats=2.0, budget=total // 2)
    drawn = mixing.mix_sources(docs, half).withColumn("n", mixing.words(F.col("text"))).groupBy("source").agg(F.sum("n").alias("n"))
    longest = docs.agg(F.max(mixing.words(F.col("text")))).first()[0]
    budget = {r["source"]: r["budget_tokens"] for r in half.collect()}
    for r in drawn.collect():
        assert budget[r["source"]] - longest <= r["n"] <= budget[r["source"]]
    ratio = [r["budget_tokens"] / r["tokens"] for r in mixing.source_plan(docs, repeats=2.0).collect()]
    assert min(ratio) >= 1 and max(ratio) <= 2.001


def test_mixing_of_awkward_tables(odd, none):
    got = mixing.mix_sources(odd, mixing.source_plan(odd)).collect()
    assert Counter((r["source"], r["doc_id"]) for r in got) >= Counter((s, d) for d, _, _, s, _ in ODD)
    assert got[0]["n_words"] == "own n_words" and {r["block"] for r in got} <= {0, 1}
    assert mixing.mix_sources(none, mixing.source_plan(none)).collect() == []


# ---------------------------------------------------------------- components and near copies


@pytest.mark.parametrize("links_per_task", [200_000, 50])
def test_components_of_random_links(spark, links_per_task, monkeypatch):
    monkeypatch.setattr(components, "LINKS", links_per_task)
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1300)] + [(5, 5), (None, 3), (2000, None)]
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    forest = components.Forest()
    for a, b in links:
        if a is not None and b is not None and a != b:
            forest.unite(a, b)
    want = {n: r for n, r in zip(*forest.stars()) if n != r}
    assert {r["node"]: r["root"] for r in components.components(df).collect()} == want
    assert components.components(df.filter("a < 0")).collect() == []


def brute_print(text):
    words = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints):
    """Smallest doc_id reachable, by all pairs of different fingerprints."""
    values, forest = sorted(set(prints.values())), components.Forest()
    arr = np.array(values, dtype=np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 4).tolist():
            forest.unite(v, values[i + 1 + j])
    least = {}
    for d, v in prints.items():
        r = forest.root(v)
        least[r] = min(d, least.get(r, d))
    return {d: least[forest.root(v)] for d, v in prints.items()}


def test_near_duplicates_equal_all_pairs(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    prints = {d: brute_print(r["text"]) for d, r in rows.items()}
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(prints)
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()}
    assert kept == set(brute_components(prints).values())


def test_covering_masks_meet_every_close_pair():
    masks = [m % (1 << 64) for m in simhash.covering_masks()]
    assert len(masks) == 31
    for bits in itertools.chain(itertools.combinations(range(0, 64, 3), 4), itertools.combinations(range(1, 64, 5), 3)):
        diff = sum(1 << b for b in bits)
        assert any(diff & m == 0 for m in masks)


def test_large_buckets_are_compared_block_by_block(spark):
    rng = np.random.default_rng(5)
    near = [int(np.uint64(12345)) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 6, 300)]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in near})
    df = spark.createDataFrame([(v,) for v in values], "fp bigint")
    want = brute_components({i: v % (1 << 64) for i, v in enumerate(values)})
    for block in (16, 2048):
        forest = components.Forest()
        for r in simhash.print_links(df, block=block).collect():
            assert ((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 4
            forest.unite(r["a"], r["b"])
        assert {i: values.index(forest.root(v)) for i, v in enumerate(values)} == want


def test_near_duplicates_of_awkward_tables(odd, none):
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect())
    assert got == Counter({(1, 1): 1, (2, 1): 2, (None, 1): 1, (3, 1): 1, (None, 6): 1, (6, 6): 1, (4, 4): 1, (5, 5): 1, (7, 7): 1, (8, 8): 2})
    kept = simhash.drop_near_duplicates(odd)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6, 7, 8] and kept.columns == odd.columns
    assert simhash.near_duplicates(none).collect() == [] and simhash.drop_near_duplicates(none).collect() == []


# ---------------------------------------------------------------- sharding


def check_shards(got, shards):
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(shards)]
    assert sum(sizes) == len(got) and max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_have_exact_sizes(docs, rows, odd, none, monkeypatch):
    got = sharding.shard_digest(docs).collect()
    check_shards(got, 16)
    assert {r["doc_id"] for r in got} == set(rows)
    for r in got:
        data = rows[r["doc_id"]]["text"].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    again = sharding.shard_digest(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    monkeypatch.setattr(sharding, "CELL_ROWS", 7)
    monkeypatch.setattr(sharding, "LEAST_PARTITIONS", 3)
    check_shards(sharding.shard_digest(docs).collect(), 16)
    strange = sharding.shuffle_into_shards(odd, 5)
    check_shards(strange.collect(), 5)
    assert sorted(str(r["doc_id"]) for r in strange.collect()) == sorted(str(r[0]) for r in ODD)
    assert set(strange.columns) == set(odd.columns)
    assert sharding.shard_digest(none).collect() == []


def test_matrix_has_its_margins_and_the_right_law():
    parts, cells = [5, 0, 17, 3], [8, 8, 9]
    draws = [sharding.communication_matrix(parts, cells, seed) for seed in range(4000)]
    for m in draws:
        assert [sum(r) for r in m] == parts and [sum(c) for c in zip(*m)] == cells
    mean = np.mean([m[2][0] for m in draws])
    assert abs(mean - 17 * 8 / 25) < 0.06
    var = np.var([m[2][0] for m in draws])
    assert abs(var - 17 * (8 / 25) * (17 / 25) * (8 / 24)) < 0.1
    big = [sharding.draw_hypergeometric(np.random.default_rng(s), 10**10, 10**11, 10**9) for s in range(300)]
    assert abs(np.mean(big) - 10**9 / 11) < 3 * math.sqrt(10**9 * 10 / 121 / 300)


# ---------------------------------------------------------------- addresses


def test_url_terms_and_rules(spark):
    urls = [
        None, "", "no scheme", "http://A.Example.NET/en/x", "https://example.com/de/y?q", "http://b.org/fr/", "http://example.net",
        "http://x.com/porn", "http://x.com/pornography", "http://x.com/dating", "http://x.com/dating-casino", "http://x.com/dating/dating",
        "http://x.com/PORN1", "http://sex.poker.com", "http://notexample.com/de/z", "http://x.net/porn", "a://b://c/d#e", "http://x.com/émsexé-loan",
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit("own"))
    got = {r["page_id"]: r for r in url_filter.judge_urls(df).collect()}
    verdicts = [got[i]["verdict"] for i in range(len(urls))]
    assert verdicts == ["allow", "allow", "allow", "allow", "block", "allow", "allow", "block", "allow", "allow", "block", "allow",
                        "allow", "block", "allow", "block", "allow", "allow"]
    assert [got[i]["rule"] for i in (3, 4, 5, 6, 14, 15)] == ["example.net/en/", "example.com/de/", "org/fr/", None, None, "net/"]
    assert (got[3]["host"], got[3]["path"], got[16]["host"], got[16]["path"]) == ("a.example.net", "/en/x", "b:", "//c/d")
    assert url_filter.judge_urls(df.limit(0)).collect() == []


# ---------------------------------------------------------------- benchmark passages


def brute_contamination(text, items):
    fold = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    words = lambda t: __import__("re").findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(fold))
    own, hit, who = words(text), set(), set()
    for name, item in items:
        w = words(item)
        n = min(10, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(own) - n + 1) if n else ():
            if tuple(own[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                who.add(str(name))
    return len(own), len(hit), len(who), decontaminate.items_digest(who), bool(hit)


def test_contamination_equals_a_plain_search(spark, odd, none):
    items = [(1, "The cat"), (2, None), (3, "a b c d e f g h i j k l"), (4, "a b c d e f g h i j k l"), (12, "b c d e f g h i j k"), (5, "x"), (6, "..."),
             (None, "c d e f g h i j k l m"), (7, "a b a b a b a b a b a b"), (1, "The cat")]
    texts = [r[1] for r in ODD] + ["A b C d, e f g h i j!k l m", "a " * 50, "a b " * 30, "z a b c d e f g h i j", "x x y", "b c d e f g h i j", "the the cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    named = [("null" if i is None else i, t) for i, t in items]
    want = {i: brute_contamination(t, named) for i, t in enumerate(texts)}
    for limit in (200_000, 15):
        got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.contamination(df, bench, limit=limit).collect()}
        assert got == want
        assert {r["doc_id"] for r in decontaminate.drop_contaminated(df, bench, limit=limit).collect()} == {i for i, w in want.items() if not w[4]}
    assert decontaminate.contamination(none, bench).collect() == []
    clean = decontaminate.drop_contaminated(odd, bench.limit(0))
    assert clean.count() == len(ODD) and clean.columns == odd.columns
    assert decontaminate.drop_contaminated(odd, bench.filter("item_id = 5"), limit=1).count() == len(ODD) - 0 - sum(
        brute_contamination(r[1], [(5, "x")])[4] for r in ODD)


# ---------------------------------------------------------------- nearest vectors


def brute_top(vectors, k):
    out = {}
    for q, v in vectors:
        if q % 50:
            continue
        score = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q and len(w) == len(v)))
        out[q] = [(rank + 1, i, -s) for rank, (s, i) in enumerate(score[:k])]
    return out


@pytest.mark.parametrize("block_rows", [16384, 90])
def test_top_k_equals_all_pairs(spark, block_rows):
    rng = np.random.default_rng(2)
    vectors = [(int(i), rng.normal(0, 0.3, 12).astype(np.float32).tolist()) for i in range(400)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(60)] + [(5000 + i, [0.0, float(i)]) for i in range(3)] + [(6000, []), (6001, [])]
    strange = [(None, vectors[0][1]), (50_000, None), (50_050, [1.0, None]), (50_100, [float("nan")] * 12), (50_150, [float("inf")] * 12)]
    df = spark.createDataFrame(vectors + strange, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit("own"))
    got = defaultdict(list)
    for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), block_rows=block_rows, query_rows=3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors]
    assert dict(got) == brute_top(whole, 5)
    assert topk.top_k(df.limit(0), df.limit(0)).collect() == []


# ---------------------------------------------------------------- languages


def test_languages_of_held_out_documents(docs, rows, odd, none, spark):
    got = langid.language_report(docs).collect()
    right = [r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in got if r["held_out"]]
    assert len(right) > 250 and sum(right) / len(right) > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    model = langid.learn(docs)
    pick = {x: next(r["text"] for r in rows.values() if r["lang"] == x and 3000 < len(r["text"]) < 6000) for x in ("de", "fr")}
    mixed = spark.createDataFrame([(1, pick["de"] + "\n" + pick["fr"], "x")], "doc_id bigint, text string, language string")
    told = langid.identify(mixed, model).first()["language"]
    assert set(told["languages"]) == {"de", "fr"} and 0.3 < told["score"] < 0.7
    strange = langid.identify(odd, model).collect()
    assert len(strange) == len(ODD)
    for r in strange:
        assert (r["language"]["lang"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and all(r["text"] for r in kept.collect())
    assert langid.language_report(none).collect() == []
    assert {r["lang_pred"] for r in langid.identify(odd, langid.learn(none)).select("language.lang").withColumnRenamed("lang", "lang_pred").collect()} == {"und"}


# ---------------------------------------------------------------- lines


def brute_lines(docs):
    """Components of all pairs of lines at 0.8 or more, and the kept first occurrences."""
    lines, seen = {}, []
    for d, text, *_ in docs:
        for i, x in enumerate(text.split("\n")) if text is not None else ():
            seen.append((d, i, x.encode()))
    spot = lambda d, i: (d is None, d or 0, i)
    for d, i, x in seen:
        if x.strip():
            lines[x] = min(lines.get(x, spot(d, i)), spot(d, i))
    k, forest, sets = line_dedup.SHINGLE, components.Forest(), {x: {x[i : i + line_dedup.SHINGLE] for i in range(max(1, len(x) - line_dedup.SHINGLE + 1))} for x in lines}
    for a, b in itertools.combinations(lines, 2):
        if abs(len(a) - len(b)) <= max(len(a), len(b)) // 2 and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
            forest.unite(a, b)
    first = {}
    for x, at in lines.items():
        first[forest.root(x)] = min(first.get(forest.root(x), at), at)
    assert k
    return {(d, i): not x.strip() or first[forest.root(x)] == spot(d, i) for d, i, x in seen}


@pytest.mark.parametrize("group", [256, 4])
def test_lines_equal_all_pairs(spark, odd, none, group, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    base = [" ".join(word() for _ in range(30)) for _ in range(12)]
    texts = []
    for d in range(120):
        own = [rng.choice(base) for _ in range(3)] + [" ".join(word() for _ in range(6)), "", "short", "  "]
        for j in (0, 1):
            if rng.random() < 0.6:
                cut = rng.randrange(len(own[j]))
                own[j] = own[j][:cut] + rng.choice(["", "Z", "qq"]) + own[j][cut + 1 :]
        texts.append((d, "\n".join(own)))
    texts += [(3, texts[3][1]), (None, texts[4][1]), (500, None), (501, "")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4).withColumn("dropped", F.lit("own"))
    if group != 256:
        full = line_dedup.similar_lines
        monkeypatch.setattr(line_dedup, "similar_lines", lambda d: full(d, group))
        monkeypatch.setattr(line_dedup, "SMALL_KEYS", 0)
    got = {(r["doc_id"], r["line_no"]): r["keep"] for r in line_dedup.line_classes(df).collect()}
    want = brute_lines(texts)
    assert set(got) == set(want) and sum(got[k] != want[k] for k in want) <= 2  # bands meet all but a few in a thousand pairs at the threshold
    report = {r["doc_id"]: r for r in line_dedup.line_report(df).collect()}
    assert len(report) == len({d for d, _ in texts}) and report[500]["n_lines"] == 0 and report[501]["n_kept"] == 1
    clean = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).filter("doc_id <> 3").collect()}
    d, text = texts[10]
    assert clean[d]["text"] == "\n".join(x for i, x in enumerate(text.split("\n")) if got[d, i]) and clean[d]["dropped"] == "own"
    assert clean[500]["text"] is None


def test_short_lines_with_one_changed_character_are_united(spark):
    pairs = [("Copyright 2019 by the Example Company, Inc.", "Copyright 2018 by the Example Company, Inc."),
             ("版权所有二零一九年示例公司保留所有权利请勿转载本站全部内容违者必究联系我们获取授权谢谢合作", "版权所有二零一八年示例公司保留所有权利请勿转载本站全部内容违者必究联系我们获取授权谢谢合作")]
    df = spark.createDataFrame([(i, p[i]) for p in pairs for i in (0, 1)], "doc_id long, text string")
    got = [r["keep"] for r in line_dedup.line_classes(df).orderBy("doc_id").collect()]
    assert got == [True, True, False, False]


def test_lines_of_awkward_tables(odd, none):
    got = {(r["doc_id"], r["line_no"]): r["keep"] for r in line_dedup.line_classes(odd).collect()}
    assert got == brute_lines([r[:2] for r in ODD])
    assert line_dedup.dedup_lines(odd).count() == len(ODD)
    assert line_dedup.line_report(none).collect() == []


def test_signatures_estimate_similarity():
    rng = random.Random(4)
    met = total = 0
    for _ in range(300):
        a = "".join(rng.choice("abcdefgh ") for _ in range(200)).encode()
        at = rng.randrange(20, 180)
        b = a[:at] + b"#" + a[at + 1 :]
        sa, sb = ({x[i : i + line_dedup.SHINGLE] for i in range(len(x) - line_dedup.SHINGLE + 1)} for x in (a, b))
        if len(sa & sb) >= 0.8 * len(sa | sb):
            total += 1
            keys = line_dedup.band_keys([a, b])
            met += bool((keys[0] == keys[1]).any())
    assert total > 200 and met / total > 0.99


def test_sketches_never_rule_out_similar_lines():
    """Of each group, every line with a partner at 0.8 or more stays; lines of groups without any similar pair mostly go."""
    rng = random.Random(12)
    k, lines, group = line_dedup.SHINGLE, [], []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    for g in range(400):
        a = " ".join(word() for _ in range(rng.choice([6, 30, 300]))) + " la la la" * rng.randrange(9)
        b = list(a)
        for _ in range(rng.randrange(1, 2 + len(a) // 40)):
            b[rng.randrange(len(b))] = rng.choice("XYZ")
        lines += [a, "".join(b), " ".join(word() for _ in range(30))] if g % 2 else [a, a[::-1]]
        group += [2 * g + 1] * (3 if g % 2 else 2)
    text = pa.RecordBatch.from_arrays([pa.array([x.encode() for x in lines])], names=["text"])
    told = {r["line"]: r for batch in line_dedup._mapped([text]) for r in batch.to_pylist()}
    own = [line_dedup.line_hash(x.encode()) for x in lines]
    own = [x - (1 << 64) if x >> 63 else x for x in own]
    rows = sorted((g, h) for g, h in zip(group, own))
    batches = [pa.RecordBatch.from_arrays(
        [pa.array([g for g, _ in part], pa.int64()), pa.array([h for _, h in part], pa.int64()), pa.array([told[h]["room"] for _, h in part], pa.int32()),
         pa.array([told[h]["map"] for _, h in part], pa.binary())], names=["group", "line", "room", "map"]) for part in (rows[:333], [], rows[333:])]
    kept = {h for batch in line_dedup._possible(batches) for h in batch.column(1).to_pylist()}
    sets = [{x[i : i + k] for i in range(len(x) - k + 1)} for x in lines]
    near = {own[i] for i in range(len(lines)) for j in range(max(0, i - 2), min(len(lines), i + 3))
            if i != j and group[i] == group[j] and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])}
    assert len(near) > 200 and near <= kept
    assert len(kept - near) < 0.5 * (len(own) - len(near))


def test_unrelated_lines_seldom_share_a_band(rows):
    """Few (line, band) rows of the corpus meet other lines, so that what travels to their groups stays small."""
    lines = sorted({x.encode() for r in rows.values() for x in r["text"].split("\n") if x.strip()})
    keys = np.concatenate([line_dedup.band_keys(lines[i : i + 1000]) for i in range(0, len(lines), 1000)])
    shared = 0
    for band in keys.T:
        _, count = np.unique(band, return_counts=True)
        shared += count[count > 1].sum()
    assert len(lines) > 3000 and shared < 0.06 * keys.size
    missed = lambda s: (1 - s**line_dedup.ROWS) ** line_dedup.BANDS
    assert all(missed(s) <= (1 - s**4) ** 10 for s in (0.8, 0.82, 0.85, 0.9, 0.95))  # than 10 bands of 4 rows


def test_sketches_rule_out_long_unrelated_lines():
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.choice([120, 200, 300]))) for _ in range(60)]
    lines.append(lines[7][:900] + "#" + lines[7][901:])
    batch = next(line_dedup._mapped([pa.RecordBatch.from_arrays([pa.array(["\n".join(lines).encode()])], names=["text"])]))
    told = sorted(batch.to_pylist(), key=lambda r: r["line"])
    rows = pa.RecordBatch.from_arrays(
        [pa.array([5] * len(told), pa.int64()), *(pa.array([r[k] for r in told], t) for k, t in (("line", pa.int64()), ("room", pa.int32()), ("map", pa.binary())))],
        names=["group", "line", "room", "map"])
    kept = {h for b in line_dedup._possible([rows]) for h in b.column(1).to_pylist()}
    own = np.array([line_dedup.line_hash(lines[i].encode()) for i in (7, 60)], np.uint64).view(np.int64).tolist()
    assert kept == set(own)


def test_lines_are_compared_exactly():
    """Numbers of shingles tell the same as sets of strings, for any characters."""
    rng = random.Random(14)
    for alphabet in ("ab ", "aé漢\uffff", "a\U0001f600\U0001f601b", "\0a\ufffe"):
        lines = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 4, 5, 9, 40]))) for _ in range(24)]
        lines += [x + "\0" for x in lines[:4]]
        group = line_dedup._Lines([x.encode() for x in lines])
        sets = [{x[i : i + line_dedup.SHINGLE] for i in range(max(1, len(x) - line_dedup.SHINGLE + 1))} for x in lines]
        for i, j in itertools.combinations(range(len(lines)), 2):
            assert group.similar(i, j) == (len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])), (lines[i], lines[j])


def test_tasks_pass_on_one_first_occurrence_of_a_line(docs, spark):
    """A common line reaches the shuffle once a task, and the rest are told at once."""
    many = spark.createDataFrame([(i if i % 7 else None, "same\n\nsame") for i in range(400, 0, -1)], "doc_id long, text string").repartition(3)
    got = Counter(r["state"] for r in line_dedup.lines_of(many).collect())
    assert got[line_dedup.FIRST] <= 3 and got[line_dedup.BLANK] == 400 and got.total() == 1200


# ---------------------------------------------------------------- queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, want.fetchall()))
