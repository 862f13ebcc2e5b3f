"""Every query against the SQL that states its result."""

import math

import duckdb
import pytest

from vicinity import catalog

from .conftest import DATA

TABLES = ("part", "embeddings")


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def large(small):
    """A folder whose embeddings table has more rows than one thousand."""
    return small.replace("sf0.001", "sf0.1")


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    text = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else f"{round(x, 5) + 0.0:.5f}" if isinstance(x, float) else str(x)
    return sorted(columns), sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, small, name):
    df = catalog.queries()[name](spark, small)
    told = duck.execute(catalog.oracle_sql()[name])
    want = plain(told.fetchall(), [d[0] for d in told.description])
    assert plain([tuple(r) for r in df.collect()], df.columns) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows_only(spark, small, name):
    assert catalog.queries()[name](spark, small).count() > 0


@pytest.mark.parametrize("name", ["hnsw_knn", "swgraph_knn"])
def test_graph_recall(spark, small, name):
    exact = {(r["query_id"], r["id"]) for r in catalog.queries()["knn_l2"](spark, small).collect()}
    found = {(r["query_id"], r["id"]) for r in catalog.queries()[name](spark, small).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


@pytest.mark.parametrize("name", ["hnsw_knn", "swgraph_knn"])
def test_graph_recall_over_all_rows(spark, large, name):
    exact = {(r["query_id"], r["id"]) for r in catalog.queries()["knn_l2"](spark, large).collect()}
    found = {(r["query_id"], r["id"]) for r in catalog.queries()[name](spark, large).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_graphs_link_all_rows(spark, large):
    ids = {r["vec_id"] for r in spark.read.parquet(f"{large}/embeddings.parquet").select("vec_id").collect()}
    linked = lambda name, c: {r[0] for r in catalog.queries()[name](spark, large).select(c).distinct().collect()}
    assert linked("graph_edges", "src") == ids
    assert linked("graph_delete", "id") == {i for i in ids if i % 10 != 3}


def test_data_folder():
    assert DATA
