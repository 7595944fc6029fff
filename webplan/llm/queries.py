"""The registered queries of the training-data operators, with the parameters of production, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webplan.llm import collocations, conversation_trie, decontaminate, jaccard_join, langid, line_dedup, lm_scoring, mixing, sharding, simhash, tokens, topk, url_filter
from webplan.llm.common import stored
from webplan.session import ship_package

PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_counts(spark, sf_dir):
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), limit=4096)


def lm_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = stored(lm_scoring.word_counts(docs))
    return lm_scoring.score_words(docs, lm_scoring.train(docs, counts=counts), counts)


def source_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    plan = mixing.source_plan(docs, repeats=2.0)
    return mixing.mix_sources(docs.select("doc_id", "source"), plan).select("doc_id", "source", "block", "place")


def near_duplicates(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def sharded(spark, sf_dir):
    return sharding.shard_digest(table(spark, sf_dir, "documents"), shards=16, seed=0)


def judged_urls(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def contamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def nearest_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5, scale=256.0)


def languages(spark, sf_dir):
    return langid.language_report(table(spark, sf_dir, "documents"))


def duplicate_lines(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def similar_documents(spark, sf_dir):
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def phrase_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def conversation_prefixes(spark, sf_dir):
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_token_counts": token_counts,
    "op2_masked_lm_scores": lm_scores,
    "op3_temperature_mixing": source_mixture,
    "op4_simhash_near_duplicates": near_duplicates,
    "op5_hypergeometric_shards": sharded,
    "op6_url_filter": judged_urls,
    "op7_benchmark_contamination": contamination,
    "op8_bit_sliced_top_k": nearest_vectors,
    "op9_language_id": languages,
    "op10_fuzzy_line_dedup": duplicate_lines,
    "op11_ngram_jaccard_join": similar_documents,
    "op12_phrase_collocations": phrase_collocations,
    "op13_conversation_prefix_trie": conversation_prefixes,
}

# ---------------------------------------------------------------- SQL twins

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LIST = lambda terms: "[" + ", ".join(f"'{t}'" for t in terms) + "]"


def _rule_cases(what: int) -> str:
    """CASE branches, the longest rule first."""
    ordered = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    return " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, action)[what]}'" for action, h, p in ordered
    )


ORACLE = {
    "op6_url_filter": f"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS mark FROM pages),
rests AS (SELECT page_id, {_LOWER.format('u')} AS lu, CASE WHEN mark > 0 THEN substr(u, mark + 3) ELSE '' END AS rest FROM parts),
split AS (SELECT page_id, lu, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
terms AS (SELECT *,
  len(list_filter({_LIST(url_filter.SOFT)}, lambda t: regexp_matches(lu, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')))::INT AS soft_hits,
  list_sum(list_transform({_LIST(url_filter.STRICT)}, lambda t: len(list_filter(range(1, len(lu) + 1), lambda i:
    substr(lu, i, len(t)) = t AND NOT regexp_matches(CASE WHEN i > 1 THEN substr(lu, i - 1, 1) ELSE '' END, '[a-z0-9]')
    AND NOT regexp_matches(substr(lu, i + len(t), 1), '[a-z0-9]')))))::INT AS strict_hits FROM split)
SELECT page_id, host, path, CASE {_rule_cases(0)} END AS rule,
  coalesce(CASE {_rule_cases(1)} END, CASE WHEN strict_hits > 0 OR soft_hits >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  strict_hits, soft_hits FROM terms""",
    # the exponent at which no source is passed over more than twice as often as another has a closed form
    "op3_temperature_mixing": """
WITH w AS (SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n,
  md5('0:' || coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
t AS (SELECT source, sum(n)::BIGINT AS size FROM w GROUP BY 1),
u AS (SELECT *, sum(size) OVER ()::BIGINT AS total, size::DOUBLE / sum(size) OVER () AS share FROM t),
a AS (SELECT CASE WHEN max(share) > min(share) THEN greatest(0, 1 - ln(2) / (ln(max(share)) - ln(min(share)))) ELSE 0 END AS a FROM u WHERE size > 0),
v AS (SELECT *, CASE WHEN size > 0 THEN pow(share, a) ELSE 0 END AS tempered FROM u, a),
b AS (SELECT *, greatest(size, floor(tempered / sum(tempered) OVER () * (total * sum(tempered) OVER () * max(share / nullif(tempered, 0)) OVER ())))::BIGINT AS budget FROM v),
c AS (SELECT source, CASE WHEN size > 0 THEN budget // size ELSE 1 END AS blocks, CASE WHEN size > 0 THEN budget % size ELSE -1 END AS rest FROM b),
r AS (SELECT w.*, blocks, rest, sum(n) OVER (PARTITION BY source ORDER BY place) AS run FROM w JOIN c USING (source)),
d AS (SELECT w.doc_id, w.source, place, unnest(range(blocks + (run <= rest)::INT)) AS block FROM r AS w)
SELECT d.doc_id, x.source, block, md5(block::VARCHAR || ':' || place) AS place FROM d JOIN documents x ON x.doc_id = d.doc_id""",
    "op7_benchmark_contamination": f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, n FROM pos JOIN win USING (n, s)),
hit_words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
    "op8_bit_sliced_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (SELECT a AS d, b AS r FROM links UNION SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, min(r)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.d = w.doc_id GROUP BY w.doc_id, n""",
    "op12_phrase_collocations": f"""
WITH p AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
tot AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, s, count(*) AS f, string_split(s, ' ') AS ws FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30),
cuts AS (SELECT lang, s, f AS a, ws, k, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
sc AS (SELECT cuts.lang, cuts.s, cuts.k, cuts.ws, a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.s = array_to_string(cuts.ws[1 : cut], ' ') JOIN f y ON y.lang = cuts.lang AND y.s = array_to_string(cuts.ws[cut + 1 : cuts.k], ' ')),
low AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS s, max(f) AS most FROM (SELECT lang, ws, f, k, m, unnest(range(1, k - m + 2)) AS i
  FROM f, (SELECT unnest([2, 3]) AS m) WHERE k > m) GROUP BY 1, 2),
kept AS (SELECT low.* FROM low LEFT JOIN inner_ USING (lang, s) WHERE most IS NULL OR 100 * most < 80 * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, s) AS rank FROM kept)
SELECT lang, rank, s AS phrase, a, l, r.r, n, score::BIGINT AS score FROM r JOIN tot USING (lang) WHERE rank <= 2000""",
    "op13_conversation_prefix_trie": """
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
src AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
cv AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS own FROM src GROUP BY 1),
h AS (SELECT conv_id, own, conv_id - conv_id % 100 AS base, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
  lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)), 4294967295) % 6 AS h FROM cv, crc),
re AS (SELECT h.conv_id AS c, coalesce(b.own[1 : h], []) || h.own[h + 1 :] AS turns FROM h LEFT JOIN cv b ON b.conv_id = h.base),
pre AS (SELECT c, d, len(turns) AS m, turns[1 : d] AS path, CASE WHEN d = 0 THEN 0 ELSE length(turns[d].t) END AS size FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM re)),
node AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, max(size) AS size, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (m = d), '') AS ends FROM pre GROUP BY 1, 2),
kids AS (SELECT path[1 : d - 1] AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.path = node.path),
up AS (SELECT path[1 : e] AS path, sum((n_children = 0)::INT) AS leaves, sum((n_convs - 1) * size) AS saved FROM (SELECT *, unnest(range(d + 1)) AS e FROM full_) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, up.leaves::BIGINT AS n_leaves, up.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN up ON up.path = f.path LEFT JOIN node p ON f.d > 0 AND p.path = f.path[1 : f.d - 1]""",
}
