"""Registered queries against their SQL on the smallest tables, and the shape of those without."""

from pathlib import Path

import pytest
from conftest import rows_of

import __spark_entry__ as entry

HERE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(HERE).exists(), reason="no test tables")
LLM = ("p5_", "p6_", "p7_", "p8_", "p9_", "p10_")
CORE = [q for q in entry.queries() if not q.startswith(LLM)]
#: With SQL: one of each kind, as the others differ from these in a column or a bound.
CHECKED = [
    "p1_found", "p1_counts", "p2_found", "p2_targets", "p3_found", "p4_found", "p4_paths", "p4_descendants", "link_counts", "in_adjacency_chunks", "redirect_targets", "generality", "contains",
    "disambiguation_senses", "pages_by_title", "round_robin", "article_sample", "anchor_titles", "senses", "link_probability", "relatedness_both", "shared_links", "term_relatedness",
    "link_features", "ambiguous_context", "senses_in_terms", "topic_evaluation", "service_page", "service_compare", "service_responses", "tagged_documents", "dump_pagelinks", "links_by_window",
]
#: Without SQL.
OTHERS = {"p3_cover": 4, "tagged_regions": 2, "wikified_contents": 3, "plain_text": 5, "definition_summary": 3, "preprocessed_html": 6, "link_weights": 5}


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in Path(HERE).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, HERE)
    r = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(row[names.index(c)]) for c in df.columns) for row in r.fetchall()), key=repr)
    assert want and sorted((tuple(map(plain, row)) for row in rows_of(df)), key=repr) == want


@pytest.mark.parametrize("name", OTHERS)
def test_query_has_rows(spark, name):
    df = entry.queries()[name](spark, HERE)
    assert len(df.columns) == OTHERS[name] and df.count() > 0


def test_every_core_query_is_registered_once():
    assert len(CORE) == len(set(CORE)) and set(CHECKED) | set(OTHERS) <= set(CORE)
