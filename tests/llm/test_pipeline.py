"""The pipeline against a plain computation of every stage, and on awkward tables."""

import itertools
import math
import random
import shutil
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import DOCS, ODD, brute_contamination, brute_mix, check_shards
from webplan.llm import decontaminate, langid, near_copies
from webplan.llm.components import Forest
from webplan.llm.simhash import FOLD, fingerprint

TINY = "/root/testdata/sf0.001"


def plain_trigrams(text):
    """Trigram classes of a text by the definition in langid, one position at a time."""
    data = [langid.FOLD[b].item() for b in b" " + text.lower().encode() + b" "]
    out = Counter()
    for a, b, c in zip(data, data[1:], data[2:]):
        if not a == b == 32:
            out[((a * 0x9E3779B1 % 2**32) ^ (b * 0x85EBCA77 % 2**32) ^ (c * 0xC2B2AE3D % 2**32)) >> 16] += 1
    return out


def plain_mixture(grams, p, langs):
    """Proportions of the selected languages by expectation-maximisation."""
    total, theta = sum(grams.values()), {x: 1 / len(langs) for x in langs}

    def fit(theta, rounds):
        for _ in range(rounds):
            new = dict.fromkeys(langs, 0.0)
            for g, n in grams.items():
                z = sum(theta[x] * p(x, g) for x in langs)
                for x in langs:
                    new[x] += n * theta[x] * p(x, g) / z
            theta = {x: v / total for x, v in new.items()}
        return theta

    theta = fit(theta, langid.ROUNDS)
    order = sorted(langs, key=lambda x: -theta[x])
    best = None
    for size in range(1, len(langs) + 1):
        part = {x: (theta[x] + 1e-12) * (x in order[:size]) for x in langs}
        part = {x: v / sum(part.values()) for x, v in part.items()}
        part = fit(part, langid.REFITS if size > 1 else 0)
        cost = -sum(n * math.log(sum(part[x] * p(x, g) for x in langs)) for g, n in grams.items()) + 0.5 * size * math.log(max(total, 2))
        if best is not None and cost >= best[0] - 1e-9:
            break
        best = (cost, part)
    likely = sum(n * math.log(sum(best[1][x] * p(x, g) for x in langs)) for g, n in grams.items()) / max(total, 1)
    return best[1], likely


def plain_languages(rows):
    counts = defaultdict(Counter)
    for r in rows:
        if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            counts[r["lang"]].update(plain_trigrams(r["text"]))
    langs, size = sorted(counts), {x: sum(c.values()) for x, c in counts.items()}
    p = lambda x, g: (counts[x][g] + langid.SMOOTHING) / (size[x] + langid.SMOOTHING * langid.BINS)
    out = {}
    for r in rows:
        text = r["text"] or ""
        theta, likely = plain_mixture(plain_trigrams(text), p, langs) if any(c.isalpha() for c in text) and langs else ({}, 0.0)
        out[r["doc_id"]] = (*max(theta.items(), key=lambda kv: kv[1]), likely) if theta else ("und", 0.0, 0.0)
    return out


def near_copies_by_pairs(rows):
    """The smallest doc_id of every group of documents linked by a five-word Jaccard similarity of 0.8 or more."""
    words = {r["doc_id"]: (r["text"] or "").encode().translate(FOLD).split() for r in rows}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    forest = Forest()
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
            forest.unite(a, b)
    return {forest.root(d) for d in sets}


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    told = plain_languages(rows)
    got = {r["doc_id"]: r for r in langid.language_report(docs).collect()}
    assert all(got[d]["lang_pred"] == lang and abs(got[d]["score"] - score) < 1e-6 for d, (lang, score, _) in told.items())

    kept = [r for r in rows if told[r["doc_id"]][0] != "und" and told[r["doc_id"]][2] >= -math.log(langid.BINS)]
    stay = near_copies_by_pairs(kept)
    kept = [r for r in kept if r["doc_id"] in stay]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    clean = [r for r in kept if not brute_contamination(r["text"], items)[4]]
    assert 0 < len(clean) < len(kept) < len(rows)
    want = Counter()
    for (_, d), n in brute_mix(clean, 2.0).items():
        want[d] += n

    out = corpus_pipeline.run(spark, TINY)
    assert set(out.columns) == {*docs.columns, "shard", "slot"}
    final = out.collect()
    mixed = Counter(r["doc_id"] for r in final)
    assert set(mixed) == set(want) and sum(abs(mixed[d] - want[d]) for d in want) <= len({r["source"] for r in clean})
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert all(r["text"] == texts[r["doc_id"]] for r in final)
    check_shards(final, corpus_pipeline.SHARDS)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_of_awkward_tables(spark, tmp_path, empty):
    shutil.copytree(TINY, tmp_path / "sf", dirs_exist_ok=True)
    docs = spark.createDataFrame([] if empty else ODD, DOCS)
    columns = docs.columns
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path / "sf")).write.parquet(str(tmp_path / f"out{at}"))
        docs = spark.read.parquet(str(tmp_path / f"out{at}"))
        assert at + 1 == len(corpus_pipeline.STAGES) or docs.columns == columns, name
    assert empty == (docs.count() == 0)
    check_shards(docs.collect(), corpus_pipeline.SHARDS)


def test_near_dedup_meets_edited_copies_at_a_similarity_of_four_fifths(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 80, 200, 600]))]
        for edits in (0, 1, 1, 2, 3, 5):
            own = list(words)
            for at in rng.sample(range(len(own)), edits):
                own[at] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    texts += ["a b c", "A  b\tc", "a b d"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    forest, pairs = Forest(), 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
            forest.unite(i, j)
            pairs += 1
    order = rng.sample(range(len(texts)), len(texts))
    docs = spark.createDataFrame([(i, texts[i], "en", "a", 0) for i in order], DOCS).repartition(5)
    for group in (512, 2):
        got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs, group).collect()}
        assert pairs > 300 and got == {i: forest.root(i) for i in range(len(texts))}
    kept = corpus_pipeline.near_dedup(spark, docs, TINY)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(len(texts)) if forest.root(i) == i}


def test_near_dedup_compares_what_simhash_tables_name(spark):
    """Two texts within SimHash's four bits and at 0.8 that share no MinHash band are one component."""
    text = "w98541 w39543 w19387 w66846 w14214 w38196 w13936 w32604"
    both = [text, f"{text} w18861"]
    plain = [t.encode() for t in both]
    assert not (near_copies.band_keys(plain[:1]) == near_copies.band_keys(plain[1:])).any()
    assert (fingerprint(plain[0]) ^ fingerprint(plain[1])).bit_count() == 2
    docs = spark.createDataFrame([(1, both[0], "en", "a", 0), (2, both[1], "en", "a", 0), (3, "another text", "en", "a", 0)], DOCS)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, TINY).collect()} == {1, 3}


CLASHES = ("language", "found", "items", "spans", "block", "place", "likely", "first")


def test_stages_keep_columns_named_as_what_they_make(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, TINY)
        assert out.columns == docs.columns and out.count() > 0
        assert [tuple(r) for r in out.select(*CLASHES).distinct().collect()] == [tuple(f"own {c}" for c in CLASHES)], name
    few = decontaminate.drop_contaminated(docs, spark.read.parquet(f"{TINY}/benchmark.parquet"), limit=30)
    assert few.columns == docs.columns and few.count() == decontaminate.drop_contaminated(docs, spark.read.parquet(f"{TINY}/benchmark.parquet")).count()


def test_documents_in_many_languages_stay(spark):
    """Six languages in one text are all found, and the document stays, though none has half of it; letters at random go."""
    rng = random.Random(4)
    sounds = {f"l{k}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8))) for _ in range(60)] for k in range(6)}
    prose = lambda lang, n: " ".join(rng.choice(sounds[lang]) for _ in range(n))
    rows = [(k, prose(f"l{k % 6}", 200), f"l{k % 6}", "a", 0) for k in range(120)]
    rows += [(1000, " ".join(prose(x, 120) for x in sounds), None, "a", 0)]
    rows += [(2000, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(900)), None, "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    told = {r["doc_id"]: r for r in langid.language_report(docs).collect()}
    assert set(told[1000]["languages"]) == set(sounds) and told[1000]["score"] < 0.3
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, TINY).collect()} == {r[0] for r in rows} - {2000}
