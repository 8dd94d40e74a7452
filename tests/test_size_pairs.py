"""Pairs of opposite polarity: texts are read once, so repeated and null ids count as SQL counts them."""

import random

import duckdb
import pytest

from millrace import catalog
from millrace.operators import claims


def test_contradictions_of_repeated_ids(spark, tmp_path):
    words = ["it is so", "never do it", "DEPRECATED", None, "no longer", "fine"]
    rows = [(i % 17 if i % 11 else None, words[i % 6], f"s{i % 2}" if i % 13 else None, "en", i) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["contradiction_pairs"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(catalog.oracle_sql()["contradiction_pairs"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan


@pytest.mark.parametrize("block", [1, 300, 2_000_000])
def test_only_claims_that_meet_are_written(spark, monkeypatch, block):
    """Pairs that share words are found in blocks of claims, whatever their size, and none is shuffled."""
    seen, write = {}, claims.table
    monkeypatch.setattr(claims, "table", lambda df, name="t": seen.__setitem__(name, df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    monkeypatch.setattr(claims, "BLOCK", block, raising=False)
    r = random.Random(3)
    base = [[f"w{r.randrange(60)}" for _ in range(n)] for n in (1, 2, 5, 9, 30) for _ in range(3)]
    sets = [(r.choice("ab"), i, sorted({*r.choice(base), *(f"w{r.randrange(60)}" for _ in range(r.randrange(3)))})) for i in range(45)] + [("a", 99, [])]
    got = claims.meeting_pairs(spark.createDataFrame(sets, "scope string, first long, words array<string>"))
    want = {(i, j) for s, i, x in sets for t, j, y in sets if s == t and i < j and x and len(set(x) & set(y)) / len(x) > 0.85}
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 20
    assert "Exchange" not in seen["near"] and "CartesianProduct" in seen["near"]


def test_shared_words_of_two_blocks_in_slices(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(claims, "AT_ONCE", 2, raising=False)
    n, first = np.array([3, 3, 2]), np.array([5, 1, 2])
    h, d = np.array([1, 1, 2, 2, 3, 3, 4, 4]), np.array([0, 1, 0, 1, 0, 2, 1, 2], np.uint16)
    of = {"first": first, "n": n, "h": h, "d": d, "kh": h, "kd": d}
    assert [sorted(zip(*map(list, claims._met_in(of, of, met)))) for met in (0.6, 0.4)] == [[(1, 5)], [(1, 5), (2, 5)]]
