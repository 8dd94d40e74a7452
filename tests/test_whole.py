"""Queries over whole tables: against their statement, which must not cut its input either, and on small fixtures."""

import os

import duckdb
import pytest

from millrace import catalog
from millrace.operators import evidence as E
from millrace.registry import TABLES
from tests.test_queries import DATA, plain

needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def same(spark, name, *cuts, data=DATA):
    """The rows of a query, held against its DuckDB statement, which must be free of the given cuts."""
    sql = catalog.oracle_sql()[name]
    assert not any(old in sql for old, _ in cuts)
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    r = c.execute(sql)
    columns = [d[0] for d in r.description]
    want = sorted((tuple(plain(x) for x in row) for row in r.fetchall()), key=repr)
    got = sorted((tuple(plain(row[k]) for k in columns) for row in catalog.queries()[name](spark, data).collect()), key=repr)
    assert got == want
    return got


@needs_tables
@pytest.mark.parametrize("name, cut", [("claim_verification", " WHERE doc_id < 30"), ("claim_rates", " WHERE doc_id < 30"), ("evidence_sufficiency", " WHERE doc_id < 100")])
def test_evidence_is_the_whole_table(spark, name, cut):
    same(spark, name, (cut, ""))


def test_verify_beyond_the_first_texts(spark):
    c = spark.createDataFrame([(1, "green apples grow here"), (2, "green apples grow here"), (3, "nothing of that kind"), (4, None), (5, "It was never proven harmless")], "id long, claim string")
    e = [(i, "other text") for i in range(500)] + [(700, "Green apples grow there"), (800, "green apples, not pears, grow here"), (900, "proven harmless"), (None, None)]
    got = {r["id"]: (r["status"], round(r["confidence"], 6)) for r in E.verify(c, spark.createDataFrame(e, "ord long, body string").repartition(3)).collect()}
    assert got == {1: ("CONTRADICTED", 1.0), 2: ("CONTRADICTED", 1.0), 3: ("UNKNOWN", 0.0), 4: ("UNKNOWN", 0.0), 5: ("CONTRADICTED", 0.666667)}


@needs_tables
@pytest.mark.parametrize("name, cut, data", [("contradiction_pairs", " AND a.id < 200 AND b.id < 200", "/root/testdata/sf0.01"), ("set_jaccard", " WHERE doc_id < 40", DATA), ("reference_edges", " WHERE doc_id < 60", DATA)])
def test_pairs_are_of_the_whole_table(spark, name, cut, data):
    got = same(spark, name, (cut, ""), data=data)
    assert len(got) == len(set(got)) > 0


_GRAPH = [(x, " WHERE c_custkey % 10 = 0") for x in ("ppr_5_iterations", "bfs_closure", "reverse_closure", "call_chains", "best_first_expansion")]


@needs_tables
@pytest.mark.parametrize("name, cut", [("token_bucket", " WHERE user_id % 5 = 0"), ("hierarchical_budget", " WHERE o_custkey % 3 = 0"), *_GRAPH])
def test_no_key_is_left_out(spark, name, cut):
    assert cut not in catalog.oracle_sql()[name]
    same(spark, name, (cut, ""))


@needs_tables
def test_graph_weighs_all_customers(spark):
    from millrace.plans.graphs import _tree
    from millrace.registry import Tables

    t = Tables(spark, DATA)
    got = _tree(t).where("src like 'n%' and dst like 'r%'").agg({"weight": "sum"}).first()[0]
    assert got == 0.5 * t.customer.count()


@needs_tables
def test_bootstrap_is_of_all_orders(spark):
    import numpy as np

    c = duckdb.connect()
    v = np.array([float(x) for (x,) in c.execute(f"SELECT o_totalprice FROM '{DATA}/orders.parquet'").fetchall()])
    r = catalog.queries()["bootstrap_ci"](spark, DATA).first()
    half = 1.96 * v.std() / len(v) ** 0.5
    assert r["lower"] < v.mean() < r["upper"] and 0.7 * 2 * half < float(r["upper"] - r["lower"]) < 1.5 * 2 * half


@needs_tables
def test_elo_plays_all_matches(spark):
    r, c = [1200.0] * 4, duckdb.connect()
    for k, cust, st in c.execute(f"SELECT o_orderkey, o_custkey, o_orderstatus FROM '{DATA}/orders.parquet' ORDER BY 1").fetchall():
        a, b, s = cust % 4, (cust + 1 + k % 3) % 4, {"F": 1.0, "O": 0.0}.get(st, 0.5)
        gain = 32 * (s - 1 / (1 + 10 ** ((r[b] - r[a]) / 400)))
        r[a] += gain
        r[b] -= gain
    got = {x["player"]: x["rating"] for x in catalog.queries()["elo_ratings"](spark, DATA).collect()}
    assert got == pytest.approx(dict(enumerate(r)), abs=1e-3)


@needs_tables
def test_pareto_judges_all_suppliers(spark):
    got = same(spark, "pareto_frontier", (" WHERE l_suppkey <= 200", ""), data="/root/testdata/sf0.1")
    assert len(got) == 1000


@needs_tables
def test_belief_folds_all_events(spark):
    got = same(spark, "bayes_belief", (" WHERE n <= 40", ""))
    c = duckdb.connect()
    assert max(r[1] for r in got) == c.execute(f"SELECT max(n) FROM (SELECT count(*) AS n FROM '{DATA}/events.parquet' GROUP BY user_id)").fetchone()[0] > 40


@needs_tables
def test_idf_of_all_terms(spark):
    got = same(spark, "inverse_document_frequency", (" WHERE df >= 5", ""))
    assert len(got) == catalog.queries()["document_frequency"](spark, DATA).count()


@needs_tables
def test_sketch_is_near_the_exact_count(spark):
    c = duckdb.connect()
    want = dict(c.execute(f"SELECT l_returnflag, count(DISTINCT l_partkey) FROM '{DATA}/lineitem.parquet' GROUP BY 1").fetchall())
    got = {r["l_returnflag"]: r["distinct_parts"] for r in catalog.queries()["approximate_distinct"](spark, DATA).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) <= 0.08 * want[k] for k in want)
