"""Assessment operators and the cut before folds, against hand-valued cases and plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import assess as A
from millrace.operators import graph as G
from millrace.operators import packing as P
from millrace.sources.work import table


def test_task_profiles(spark):
    rows = [
        ("where is main.go",),
        ("Why does the auth race delete config.yaml and schema.sql? check callers of func Open",),
        ("",),
        (None,),
        ("a.go b.py c.rs d.md refactor the consensus engine, maybe with security and deadlock and drop",),
    ]
    got = [r["p"] for r in spark.createDataFrame(rows, "t string").select(A.task_profile(F.col("t")).alias("p")).collect()]
    assert (got[0]["class"], got[0]["files"], got[0]["calls"]) == ("T0", 1, 0)
    assert (got[1]["files"], got[1]["symbols"], got[1]["risk"], got[1]["depth"]) == (2, 1, 1.0, 4)
    assert got[1]["ambiguity"] == 0.7 and got[1]["scope"] == 13
    assert got[2] == got[3] and got[2]["class"] == "T1" and got[2]["difficulty"] == pytest.approx(0.199)
    assert (got[4]["files"], got[4]["scope"], got[4]["class"]) == (4, 50, "T3")
    history = spark.createDataFrame([("x", 0.6)], "t string, h double").select(A.task_profile(F.col("t"), F.col("h")).alias("p")).first()["p"]
    assert history["difficulty"] == pytest.approx(0.2 / 50 + 0.03 + 0.1 + 0.15 * 0.2 + 0.02 + 0.06)


def test_task_budgets(spark):
    rows = [("Fix it", 0, 0.4), ("Fix it", 9, 0.0), ("migrate", 0, 1.0), (None, 0, 0.0)]
    got = spark.createDataFrame(rows, "t string, d int, u double").select(A.task_budget(F.col("t"), F.col("d"), F.col("u")).alias("b")).collect()
    assert [(r["b"]["kind"], r["b"]["budget"]) for r in got] == [("local_edit", 1024), ("cross_file_refactor", 2304), ("architectural_migration", 7936), ("simple_lookup", 256)]


def test_early_stop(spark):
    items = [(1, 300, 1.0), (2, 300, 0.9), (3, 900, 0.9), (4, 200, 0.01), (5, 10, 1.0)]
    df = spark.createDataFrame([(items,)], "items array<struct<id: long, tokens: long, confidence: double>>")
    g = df.select(A.early_stop_pack(F.col("items"), A.task_budget(F.lit("fix"), F.lit(0), F.lit(0.4)), F.lit(0.4)).alias("g")).first()["g"]
    assert tuple(g) == (600, 2, True)


def _contract(spark, evidence, required, claims):
    return A.contract(
        spark.createDataFrame([("a",), ("b",)], "task string"),
        spark.createDataFrame(evidence, "task string, id long, path string, text string, conflict boolean, stale boolean"),
        spark.createDataFrame(required, "task string, path string"),
        spark.createDataFrame(claims, "task string, claim string"),
    ).withColumn("l", A.layers())


def test_contract_layers(spark):
    ev = [("a", 1, "X/One.go", "red bolt here", False, False), ("a", 2, "x/two.go", "blue", True, False)]
    got = {r["task"]: r for r in _contract(spark, ev, [("a", "x/one.go"), ("a", "x/one.go"), ("a", "x/three.go")], [("a", "red bolt"), ("a", "blue ring"), ("a", "gear rod nut")]).collect()}
    a, b = got["a"], got["b"]
    assert (a["evidence"], a["required"], a["matched"], a["claims"], a["missing"]) == (2, 2, 1, 3, 1)
    assert a["precision"] == pytest.approx(1 / 3) and a["contradicted"] == pytest.approx(1 / 3) and a["coverage"] == pytest.approx(2 / 3)
    assert a["l"]["failure"] == "contradiction" and a["l"]["composite"] == pytest.approx(0.15 + 0.25 * 2 / 3 + 0.10 + 0.10)
    assert (b["evidence"], b["l"]["composite"], b["l"]["failure"], b["l"]["sufficient"]) == (0, 0.0, "existence", False)
    whole = {r["task"]: r["l"] for r in _contract(spark, ev[:1], [("a", "x/one.go")], [("a", "red bolt")]).collect()}
    assert tuple(whole["a"]) == (1.0, True, None)
    empty = {r["task"]: r["l"]["failure"] for r in _contract(spark, [], [], []).collect()}
    assert empty == {"a": "existence", "b": "existence"}


def test_actions_and_stops(spark):
    rows = [(0.2, 0.5, 0.1, 0.3, 1.0), (0.9, 0.02, 1.0, 0.1, 1.0), (0.5, 0.5, 1.0, 0.9, 1.0), (0.2, 0.5, 0.1, 0.9, 0.0)]
    c = F.col
    df = spark.createDataFrame(rows, "conf double, risk double, cov double, diff double, usd double")
    a = A.best_action(c("conf"), c("risk"), c("cov"), c("diff"), c("usd"), F.lit(4096), F.lit(0.8), F.lit(0.02))
    got = df.select(a.alias("a"), "*").withColumn("stop", A.stop_reason(F.lit(0), c("usd"), c("risk"), c("cov"), c("conf"), c("a.voi"))).collect()
    assert [(r["a"]["action"], r["stop"]) for r in got] == [("retrieve", None), ("stop", "target"), ("verify", None), ("stop", "budget")]
    assert got[0]["a"]["voi"] == pytest.approx(0.35 * 0.9 - 0.015 - 0.01 + 2 * 0.5 * 0.54)
    s = spark.range(1).select(A.calibrated(F.lit(0.9), F.lit(0.5), F.lit(0.5), F.lit(0.0)).alias("c"), A.residual_risk(F.lit(0.6), F.lit(1.0)).alias("r"), A.stop_reason(F.lit(15), F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("s")).first()
    assert (s["c"], s["r"], s["s"]) == (0.575, 0.4, "turns")


def test_rerank(spark):
    cands = spark.createDataFrame(
        [("t", 1, "pkg/scheduler.go", "x", "", 0.5), ("t", 2, "pkg/scheduler_test.go", "x", "", 0.5), ("t", 3, "legacy/run.go", "scheduler", "scheduler", 0.5), ("t", 4, "a/none.go", "x", "v2_api", 0.5), ("t", 5, "b/none.go", "x", "V2_API", 0.5)],
        "task string, id long, path string, name string, text string, score double",
    )
    asks = spark.createDataFrame([("t", "Scheduler v2_api without legacy")], "task string, q string").withColumn("ask", A.represent(F.col("q")))
    ask = asks.first()["ask"]
    assert [x["name"] for x in ask["entities"]] == ["scheduler"] and ask["identifiers"] == ["v2_api"] and ask["negations"] == ["legacy"]
    got = {r["id"]: (r["place"], r["score"]) for r in A.rerank(cands, asks, authority=0.1).collect()}
    assert got[1] == (1, pytest.approx(0.5 + 0.35 + 0.1)) and got[2] == (4, pytest.approx(0.5 + 0.35 - 0.15 + 0.05)) and got[3][0] == 5
    assert (got[4][0], got[5][0]) == (2, 3) and got[4][1] == got[5][1]


def test_stability(spark):
    q = spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "c"), ("one", "d"), ("none", "e"), ("none", "g")], "family string, query string")
    r = spark.createDataFrame([("a", "X", 1), ("a", "y", 2), ("b", "x", 1), ("b", "z", 2), ("b", "w", 3), ("c", "v", 1)], "query string, item string, place int")
    got = {x["family"]: (x["queries"], x["psi"]) for x in A.stability(q, r, 2).collect()}
    assert got == {"f": (3, pytest.approx((1 / 3) / 3)), "one": (1, 1.0), "none": (2, 1.0)}


def _plain(items, budget):
    spent, chosen = 0, []
    for _, id_, n, s in sorted(items):
        if n > 0 and spent + n <= budget:
            spent, chosen = spent + n, chosen + [id_]
    return spent, chosen


def test_the_cut_before_a_fold_loses_nothing(spark):
    draw = random.Random(7)
    rows = [(f"g{i % 3}", i, draw.choice([0, 1, 2, 3, 5, 8, 40, 70]), draw.random(), draw.choice([0.1, 0.2, 0.3])) for i in range(1200)]
    rows += [("large", 5000, 900, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "source string, id long, tokens long, score double, density double")
    got = {r["source"]: (r["spent"], r["chosen"]) for r in P.greedy_pack(df, "source", 60).collect()}
    assert got == {g: _plain([(-d, i, n, s) for k, i, n, s, d in rows if k == g], 60) for g in ("g0", "g1", "g2", "large")}
    left = P.fitting(df, ["source"], 60, F.desc("density"), F.col("id")).groupBy("source").count().collect()
    assert max(r["count"] for r in left) <= 60 * 6


def test_rescue_and_fill(spark):
    rows = [("s", 1, 10, 1.0, 0.9), ("s", 2, 80, 5.0, 0.5), ("s", 3, 15, 0.1, 0.2), ("s", 4, 200, 9.0, 0.8)]
    df = spark.createDataFrame(rows, "source string, id long, tokens long, score double, density double")
    plain = P.singleton_rescue(df, "source", 85).first()
    assert (plain["spent"], plain["chosen"], plain["rescued"]) == (80, [2], True)
    filled = P.singleton_rescue(df, "source", 95, fill=True).first()
    assert (filled["spent"], filled["chosen"], filled["rescued"]) == (90, [1, 2], False)  # both fit: no rescue
    filled = P.singleton_rescue(spark.createDataFrame(rows[:3] + [("s", 5, 90, 7.0, 0.1)], df.schema), "source", 100, fill=True).first()
    assert (filled["spent"], filled["chosen"], filled["rescued"]) == (100, [5, 1], True)


def test_pagerank_ends_when_ranks_rest(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0)], "src string, dst string, weight double")
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    s = spark.createDataFrame([("a", 1.0)], "id string, weight double")
    rounds = []

    def cut(df):
        rounds.append(1)
        return table(df)

    short = {r["id"]: r["rank"] for r in G.personalised_pagerank(n, e, s, iterations=30, cut=cut, tolerance=0.8).collect()}
    assert 1 < len(rounds) < 30
    long = {r["id"]: r["rank"] for r in G.personalised_pagerank(n, e, s, iterations=len(rounds), cut=table).collect()}
    assert short == pytest.approx(long)
    with pytest.raises(ValueError):
        G.personalised_pagerank(n, e, s, tolerance=0.1)


def test_query_classes(spark):
    rows = ["internal/store/db.go", "open db.py now", "store.Db.Open", "what calls HandlePlan?", "HandlePlan", "attach_policy", "how is it done", "why so", "", None]
    got = [r["c"] for r in spark.createDataFrame([(x,) for x in rows], "q string").select(A.query_class(F.col("q")).alias("c")).collect()]
    assert got == ["path", "file", "qualified_symbol", "relation", "symbol", "identifier", "lexical", "conceptual", "conceptual", "conceptual"]


def test_ladder_equals_judging_every_prefix(spark):
    """Each prefix, and each prefix less one piece, is judged from the start by `contract` and `layers`."""
    import random

    from pyspark.sql import functions as F

    from millrace.operators import assess

    r = random.Random(5)
    ev, req, cl = [], [], []
    for t in range(12):
        names = [f"p{t}_{i}" for i in range(4)]
        req += [(f"t{t}", f"F/{n}.go") for n in r.sample(names, r.randrange(0, 3))]
        cl += [(f"t{t}", f"alpha{n} beta{n}") for n in r.sample(names, r.randrange(0, 4))]
        for place in range(1, r.randrange(2, 7)):
            n = r.choice(names)
            ev.append((f"t{t}", place, place, f"f/{n}.go", " ".join(r.sample([f"alpha{x} beta{x}" for x in names], 2)), r.randrange(0, 30), r.random() < 0.05, r.random() < 0.05))
    E = "task string, id long, place int, path string, text string, tokens int, conflict boolean, stale boolean"
    tasks = spark.createDataFrame([(f"t{t}",) for t in range(13)], "task string")
    required, claims = spark.createDataFrame(req, "task string, path string"), spark.createDataFrame(cl, "task string, claim string")
    sets = []  # (task, rung, left out, piece)
    for t in {e[0] for e in ev}:
        mine = [e for e in ev if e[0] == t]
        for rung in range(1, len(mine) + 1):
            for out in range(rung + 1):
                sets += [(f"{t}|{rung}|{out}", *e[1:]) for e in mine if e[2] <= rung and e[2] != out]
    names = sorted({s[0] for s in sets} | {f"{e[0]}|1|1" for e in ev})
    many = spark.createDataFrame([(n, n.split("|")[0]) for n in names], "name string, task string")
    again = lambda df: df.join(many, "task").drop("task").withColumnRenamed("name", "task")
    judged = assess.contract(many.select(F.col("name").alias("task")), spark.createDataFrame(sets, E), again(required), again(claims)).select("task", assess.layers().alias("l")).select("task", "l.*")
    got = {tuple(x["task"].split("|")): (x["composite"], x["sufficient"]) for x in judged.collect()}
    want = {}
    for t in {e[0] for e in ev}:
        mine = sorted(e for e in ev if e[0] == t)
        n = len(mine)
        rung = next((k for k in range(1, n + 1) if got[t, str(k), "0"][1] and got[t, str(k), "0"][0] >= 0.8), n)
        base = got[t, str(rung), "0"]
        need = sum(got[t, str(rung), str(k)][0] < base[0] or not got[t, str(rung), str(k)][1] for k in range(1, rung + 1))
        tokens, full = sum(e[5] for e in mine[:rung]), sum(e[5] for e in mine)
        want[t] = (rung, n, tokens, round(full / tokens if tokens else 1.0, 9), *base, round(need / rung, 9))
    rows = assess.ladder(tasks, spark.createDataFrame(ev, E), required, claims).collect()
    assert {x["task"]: (x["rung"], x["rungs"], x["tokens"], round(x["compression"], 9), x["composite"], x["sufficient"], round(x["minimality"], 9)) for x in rows} == want
    assert any(x["sufficient"] for x in rows) and not all(x["sufficient"] for x in rows)
