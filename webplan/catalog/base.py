"""Registry of named queries and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webplan.functions import urls as U

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- SQL fragments


def s(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sq_encode(x: str, unsafe: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, {s(unsafe)}) THEN array_to_string(list_transform(string_split({x}, ''), "
        f"lambda ch: CASE WHEN ch = ' ' THEN '%20' WHEN regexp_matches(ch, {s(unsafe)}) THEN url_encode(ch) "
        f"ELSE ch END), '') ELSE {x} END"
    )


def sq_parse(cte: str, source: str, url: str, keep: str) -> str:
    """CTE text: ``source`` with the components of address expression ``url``."""
    part = lambda i: f"regexp_extract(t, {s(U.HTTP_PATTERN)}, {i})"
    return f"""
{cte}_0 AS (SELECT {keep}, trim({url}) AS t FROM {source}),
{cte}_1 AS (SELECT *, regexp_matches(t, {s(U.HTTP_PATTERN)}) AS is_http,
    regexp_matches(t, {s(U.SCHEME_PATTERN)}) AND NOT regexp_matches(t, '(?i)^https?:') AS is_other,
    lower({part(1)}) AS scheme, lower({part(2)}) AS host, {part(3)} AS port0, {part(4)} AS path0,
    {part(5)} AS query0, {part(6)} AS frag0 FROM {cte}_0),
{cte}_2 AS (SELECT *, CASE WHEN port0 = '' OR (scheme='http' AND port0='80') OR (scheme='https' AND port0='443')
      THEN '' ELSE ':' || port0 END AS port,
    {sq_encode("(CASE WHEN path0='' THEN '/' ELSE path0 END)", U.PATH_UNSAFE)} AS path,
    CASE WHEN query0='?' THEN '' ELSE {sq_encode("query0", U.QUERY_UNSAFE)} END AS query,
    CASE WHEN frag0='#' THEN '' ELSE {sq_encode("frag0", U.PATH_UNSAFE)} END AS frag FROM {cte}_1),
{cte}_3 AS (SELECT *, scheme || '://' || host || port AS origin,
    CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END AS path1,
    regexp_replace(regexp_replace(host, '^\\.', ''), '^www\\.', '') AS bare FROM {cte}_2),
{cte} AS (SELECT *, {sq_root('bare')} AS root,
    CASE WHEN is_http THEN origin || path1 || query WHEN is_other THEN regexp_replace(t, '#.*$', '') ELSE t END AS page_key,
    CASE WHEN is_http THEN origin || path1 || query END AS canonical,
    CASE WHEN host LIKE 'm.%' THEN 'mo' ELSE 'pc' END AS viewport FROM {cte}_3)"""


def sq_root(bare: str) -> str:
    """Registrable domain of a cleaned host expression."""
    labels = f"list_filter(string_split({bare}, '.'), lambda x: x <> '')"
    tail = lambda n: f"array_to_string(list_slice({labels}, -{n}, -1), '.')"
    suffixes = ", ".join(s(x) for x in U.TWO_LABEL_SUFFIXES)
    return (
        f"CASE WHEN {bare} IN ('', 'localhost') OR regexp_matches({bare}, {s(U.IPV4_PATTERN)}) OR len({labels}) <= 2 "
        f"THEN {bare} WHEN {tail(2)} IN ({suffixes}) THEN {tail(3)} ELSE {tail(2)} END"
    )


def sq_title(html: str = "html") -> str:
    return f"trim(regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title>', 1))"


PAGES_U = "WITH " + sq_parse("u", "pages", "url", "page_id, url, html")
