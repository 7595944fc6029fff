import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ["link_inventory", "rank_links", "keep_or_rewrite", "dom_path", "selector_package", "candidate_groups", "merge_pairs", "common_rows", "taxonomy_rows", "capture_qc",
          "upsert_page_analyses", "job_latest", "parse_suggestions", "regroup_tabs"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == cols
    assert got == sorted(str(tuple(r[i] for i in order)) for r in cur.fetchall())


def test_other_queries_work_without_a_module_of_the_training_data_part(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("webplan.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    left = entry.queries()
    assert len(left) > 200 and not any(n == "pipeline" or n.startswith("op") and "_" in n and n[2:].split("_")[0].isdigit() for n in left)
