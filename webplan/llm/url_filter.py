"""URL filter: host rules, then a weighted vocabulary searched by Aho-Corasick.

A term counts where no letter or digit stands next to it.  One strict term rejects an address; soft terms reject it
when several different ones occur."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from webplan.llm.common import blocks

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRICT = ("porn", "porno", "xxx", "adult-x", "hentai", "camgirls", "sexcam", "warez", "crackz", "keygen", "phishing", "malware", "link-farm", "spam-farm")
SOFT = ("adult", "sex", "sexy", "nude", "escort", "dating", "casino", "poker", "bet", "bets", "betting", "gambling", "win", "free", "cheap",
        "viagra", "pills", "loan", "payday", "torrent", "crack", "serial", "proxy", "spam", "clickbait", "ads", "track", "tracking", "popup")
SOFT_LIMIT = 2
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@functools.lru_cache(maxsize=8)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in {*strict, *soft}:
        found.add_word(term, (term, term in strict))
    found.make_automaton()
    return found


def term_hits(url: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """Strict occurrences and different soft terms of an address in lower case."""
    machine, hard, mild = _automaton(strict, soft), 0, set()
    for end, (term, is_strict) in machine.iter(url):
        before, after = url[end - len(term) : end - len(term) + 1] if end >= len(term) else "", url[end + 1 : end + 2]
        if any("a" <= c <= "z" or "0" <= c <= "9" for c in (before, after)):
            continue
        if is_strict:
            hard += 1
        else:
            mild.add(term)
    return hard, len(mild)


def url_terms(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT):
    """Column function: struct of strict_hits and soft_hits of an address."""
    hard, mild = tuple(sorted(set(strict))), tuple(sorted(set(soft)))

    @arrow_udf("struct<strict_hits:int,soft_hits:int>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            found = [term_hits(u, hard, mild) for block in blocks(column) for u in block] if hard or mild else [(0, 0)] * len(column)
            yield pa.StructArray.from_arrays(
                [pa.array([x[i] for x in found], pa.int32()) for i in (0, 1)], names=["strict_hits", "soft_hits"]
            )

    return count


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct of rule and action; null if none does."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    cases = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action")),
        )
        for action, h, p in longest
    ]
    return F.coalesce(*cases) if cases else F.lit(None).cast("struct<rule:string,action:string>")


def judge_urls(pages: DataFrame, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT, rules=RULES) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, strict_hits, soft_hits.

    A rule decides where one fits; else the terms do.  A null address, or one without ``://``, has empty host and
    path, so no rule fits it; its terms count all the same (null: none, allow).  Repeated rows give repeated rows;
    other columns are left out.  No shuffle."""
    url = F.col("url").cast("string")
    told = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"),
                        url_terms(strict, soft)(lower_ascii(F.coalesce(url, F.lit("")))).alias("terms"))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("terms.strict_hits") > 0) | (F.col("terms.soft_hits") >= soft_limit), "block").otherwise("allow")
    return told.withColumn("fit", rule).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.action", own).alias("verdict"),
        "terms.strict_hits", "terms.soft_hits",
    )
