"""Claims merged in order, names in texts and best-first expansion against plain versions."""

import heapq
import random
import re

import pandas as pd
import pytest

from millrace.operators import claims, expansion, mentions


def bag(text):
    return [w for w in re.split("[^a-z0-9_]+", (text or "").lower()) if len(w) >= 2]


def merged_by_hand(rows):
    kept, out = [], {}
    for scope, at, claim, evidence, confidence in sorted(rows, key=lambda r: r[1]):
        words = set(bag(claim))
        for k, kw, text in ((k, w, t) for s, k, w, t in kept if s == (scope or "")):
            if text == (claim or "").lower() or (kw and len(kw & words) / len(kw) > 0.85):
                break
        else:
            k = at
            kept.append((scope or "", at, words, (claim or "").lower()))
            out[k] = [scope or "", 0, set(), None]
        o = out[k]
        o[1] += 1
        o[2] |= {evidence} - {None}
        o[3] = confidence if o[3] is None else max(o[3], confidence if confidence is not None else o[3])
    return sorted((s, k, n, len(e), c) for k, (s, n, e, c) in out.items())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_claims_merge_as_in_a_loop(spark, seed):
    r = random.Random(seed)
    base = [" ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(1, 25))) for _ in range(12)]
    rows = []
    for i in range(300):
        words = r.choice(base).split()
        for _ in range(r.randrange(4)):  # chains: each differs a little from others that differ a little
            at = r.randrange(len(words) + 1)
            words = words[:at] + ([f"w{r.randrange(40)}"] if r.random() < 0.6 else []) + words[at + (r.random() < 0.5) :]
        text = r.choice([None, "", "?!", "¿"]) if r.random() < 0.05 else " ".join(words).upper() if r.random() < 0.2 else " ".join(words)
        rows.append((r.choice(["a", "a", None]), i, text, r.choice(["e1", "e2", "e3", None]), float(r.randrange(9))))
    df = spark.createDataFrame(rows, "scope string, ord long, claim string, evidence string, confidence double")
    got = sorted((x["scope"], x["ord"], x["claims"], x["evidence"], x["confidence"]) for x in claims.merge(df).collect())
    assert got == merged_by_hand(rows)


def test_claims_resolve_long_chains(spark):
    n = 12  # each meets the next only: every other one is kept
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n)], "earlier long, later long")
    assert sorted(tuple(x) for x in claims.resolve(pairs).collect()) == [(i, i - 1) for i in range(1, n + 1, 2)]
    assert claims.resolve(pairs.limit(0)).count() == 0 and claims.merge(spark.createDataFrame([], "scope string, ord long, claim string, evidence string, confidence double")).count() == 0


def test_names_in_texts(spark):
    texts = [(1, "call load_file then open it, LOAD_FILE again"), (2, "the preload_file and load_files are others"), (3, "open the big door; open the big doors; open the big door"), (4, None), (5, ""), (6, "the the the big the big door")]
    names = [(1, "load_file"), (7, "Load_File"), (8, "open the big door"), (9, "the big"), (10, "the the"), (11, ""), (12, None), (13, "absent word"), (14, "door")]
    got = mentions.mentions(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(names, "id long, name string"))
    want = []
    for i, t in texts:
        for j, m in names:
            w, k = bag(t), bag(m)
            times = sum(w[p : p + len(k)] == k for p in range(len(w) - len(k) + 1)) if k else 0
            if times and i != j:
                want.append((i, j, times))
    assert sorted(tuple(x) for x in got.collect()) == sorted(want) and (3, 8, 2) in want and (6, 10, 2) in want


def test_pair_types(spark):
    rows = [("t", 1, "code", "a.go", "alpha", "runs beta now"), ("t", 2, "code", "b.go", "beta", "x"), ("t", 3, "code", "a_test.go", "alpha test", "x"), ("t", 4, "decision", "d", "why", "x"), ("t", 5, "failure", "f", "oops", "x"), ("t", 6, "code", "c.go", "bet", "type S interface {"), ("u", 7, "constraint", "k", "no", None), ("u", 8, "code", None, None, "y")]
    got = {(r["a"], r["b"]): r["type"] for r in mentions.typed_pairs(spark.createDataFrame(rows, "task string, id long, kind string, path string, name string, text string"), "task").collect()}
    want = {(1, 2): "caller+callee", (1, 3): "source+test", (2, 3): "source+test", (1, 4): "decision+source", (2, 4): "decision+source", (3, 4): "decision+source", (4, 5): "failure+fix", (3, 5): "source+test", (1, 6): "interface+impl", (2, 6): "interface+impl", (3, 6): "source+test", (4, 6): "decision+source", (5, 6): "interface+impl", (7, 8): "architecture+code"}
    assert got == want


def plain_heap(seeds, near, nodes, edges, depth, decay, cost):
    heap = [(-(s * (1 + c)), i, s, c, 0) for i, s, c in seeds]
    heapq.heapify(heap)
    scores, order, walked, end = {i: -p for p, i, *_ in heap}, [], 0, "queue_empty"
    while heap:
        if len(order) >= nodes:
            end = "max_nodes"
            break
        p, i, s, c, at = heapq.heappop(heap)
        if i in order:
            continue
        order.append(i)
        if at > 0 and -p * decay**at < cost:
            end = "voi_below_cost"
            break
        if at >= depth:
            continue
        for j, w in near.get(i, []):
            if walked >= edges:
                end = "max_edges"
                break
            walked += 1
            if j in order:
                continue
            x = s * w * decay
            if x * (1 + c) > scores.get(j, -1):
                scores[j] = x * (1 + c)
                heapq.heappush(heap, (-x * (1 + c), j, x, 0.0, at + 1))
        if end == "max_edges":
            break
    return {i: (v, order.index(i) + 1 if i in order else None, end) for i, v in scores.items()}


@pytest.mark.parametrize("limits", [(30, 50, 2, 0.75, 0.0), (8, 500, 4, 0.75, 0.0), (500, 12, 3, 0.9, 0.0), (500, 500, 6, 0.8, 0.12)])
def test_best_first_equals_a_heap(spark, limits):
    r = random.Random(7)
    edges = [(f"n{r.randrange(60):02d}", f"n{min(59, int(r.expovariate(0.1))):02d}", r.choice([1.0, 0.8, 0.5]), r.choice("ab")) for _ in range(400)]
    edges = list({(a, b, k): (a, b, w, k) for a, b, w, k in edges}.values())
    seeds = [(f"t{t}", f"n{i:02d}", r.choice([0.0, 0.4, 1.0]), r.choice([None, 0.0, 0.5])) for t in range(25) for i in r.sample(range(60), r.randrange(1, 4))] + [("lone", "zz", 1.0, 1.0)]
    near = {}
    for a, b, w, k in sorted([(a, b, w, k) for a, b, w, k in edges if a != b] + [(b, a, w, k) for a, b, w, k in edges if a != b], key=lambda e: (e[1], e[3], e[2])):
        near.setdefault(a, []).append((b, w))
    got = {}
    nodes, most, depth, decay, cost = limits
    df = expansion.best_first(spark.createDataFrame(seeds, "task string, id string, score double, centrality double"), spark.createDataFrame(edges, "src string, dst string, weight double, kind string"), nodes, most, depth, decay, cost)
    for x in df.collect():
        got.setdefault(x["task"], {})[x["id"]] = (x["score"], x["place"], x["ended"])
    want = {}
    for t in {s[0] for s in seeds}:
        mine = [(i, s if s > 0 else 0.5, c or 0.0) for k, i, s, c in seeds if k == t]
        want[t] = plain_heap(mine, near, *limits)
    assert got == want
    assert len({v[2] for t in got.values() for v in t.values()}) >= 2 or limits[0] == 8


def test_best_first_of_no_task(spark):
    assert expansion.best_first(spark.createDataFrame([], "task string, id long, score double, centrality double"), spark.createDataFrame([(1, 2, 1.0, "a")], "src long, dst long, weight double, kind string")).count() == 0


def test_spans_and_contract_of_a_query(spark):
    from millrace.operators import asks

    rows = [("a", "Trace calls from pkg/io/load.go to LoadFile and v2 without the sqlite cache_layer, then fix policies for DRMC"), ("b", None), ("c", "why no tests?"), ("d", "compare fooBar with a.b.c")]
    q = spark.createDataFrame(rows, "query string, text string")
    got = {(r["query"], r["token"]): (r["kind"], r["salience"], r["negated"]) for r in asks.spans(q).collect()}
    assert got["a", "pkg/io/load.go"] == ("path", 1.0, False) and got["a", "LoadFile"] == ("symbol", 0.9, False) and got["a", "v2"][0] == "symbol"
    assert got["a", "Trace"][0] == "action" and got["a", "calls"][0] == "action" and got["a", "without"] == ("negation", 0.0, False) and got["a", "sqlite"] == ("concept", 0.0, True)
    assert got["a", "cache_layer"] == ("identifier", 0.8, False) and got["a", "policies"][0] == "artifact" and got["a", "DRMC"] == ("entity", 1.0, False) and ("a", "to") not in got
    assert got["c", "tests"] == ("artifact", 0.0, True) and got["d", "a.b.c"][0] == "symbol"
    c = {r["query"]: r for r in asks.contracts(q).collect()}
    assert [c[k]["intent"] for k in "abcd"] == ["trace", "lookup", "debug", "comparison"]
    assert c["a"]["paths"] == ["pkg/io/load.go"] and c["a"]["exclusions"] == ["sqlite"] and c["a"]["entities"][:2] == ["DRMC", "LoadFile"] and c["b"]["entities"] == [] and c["b"]["salience"] == 0
    assert {r["query"]: r["depth"] for r in asks.route(asks.contracts(q)).collect()} == {"a": 3, "b": 1, "c": 2, "d": 1}
    assert all(abs(sum(p[:6]) - 1) < 1e-9 for p in asks.PROFILES.values())


def test_break_even_memories_as_in_sql(spark):
    """persist turns on the last digit where gross meets cost, as for four uses of a code memory."""
    import duckdb
    from pyspark.sql import functions as F

    from millrace.operators import memory as M

    rows = [(k, r, tok, float(a)) for k, (_, v) in M.ECONOMICS.items() for r in range(13) for tok in (round((r + 1) * 0.8 * v / 5e-6) + i for i in (-1, 0, 1)) for a in (0, 4)]
    case = lambda i, other: "CASE " + " ".join(f"WHEN kind = '{k}' THEN {v[i]}" for k, v in M.ECONOMICS.items()) + f" ELSE {other} END"
    e = M.economics(F.col("kind"), F.col("reuse"), F.col("tokens"), F.col("age"))
    here = pd.DataFrame(rows, columns=["kind", "reuse", "tokens", "age"])
    want = duckdb.sql(f"""SELECT kind, reuse, tokens, age, (reuse + 1) * 0.8 * survival * val - (0.000005 * tokens + 0.000010 * age + (1 - survival) * 0.0050) > 0 AND survival > 0.15 AS persist
        FROM (SELECT *, exp(-{case(0, 0.20)} * age) AS survival, {case(1, 0.0020)} AS val FROM here)""").fetchall()
    assert sorted(map(tuple, spark.createDataFrame(here).select("kind", "reuse", "tokens", "age", e["persist"]).collect())) == sorted(want)


def test_halves_are_rounded_as_in_sql(spark):
    import duckdb
    from pyspark.sql import functions as F

    from millrace.operators import ranking as R

    here = pd.DataFrame([(k * 1e-9, n) for k in range(3124630, 3124670) for n in (400, 224, 240, 625)], columns=["f", "n"])
    got = spark.createDataFrame(here).select("f", "n", R.rounded(F.col("f") / F.col("n"), 12).alias("d")).collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.sql("SELECT f, n, round(f / n, 12) FROM here").fetchall())


def test_channels_score_equal_nodes_once(spark):
    """600 nodes of six texts: what is scored does not grow with the copies, and the lists are those of all nodes."""
    from pyspark.sql import functions as F

    from millrace.operators import retrieval as V

    names = ["red ring", "red bolt", "big ring", None, "RED ring", ""]
    nodes = [(i * 7 % 601, names[i % 6], None if i % 12 == 3 else "brand 16", "p", 1) for i in range(600)]
    df = spark.createDataFrame(nodes, "id long, name string, content string, path string, revision int")
    tasks = spark.createDataFrame([("red ring",), ("zzz",)], "task string")
    texts = V._by_text(df, 4)
    assert texts.count() == 4 * texts.where("id = text").count() == 4 * 6  # no name and an empty one are one text
    got = {(r["task"], r["channel"], r["id"], r["score"]) for r in V.channels(tasks, df, 4).collect()}
    want = set()
    for c, f in {"exact": lambda n, c: float((n or "x").lower() == "red ring"), "lexical": lambda n, c: len({"red", "ring"} & set(bag(f"{n or ''} {c or ''}"))) / 2}.items():
        best = sorted((-f(n, x), i) for i, n, x, *_ in nodes if f(n, x) > 0)[:4]
        want |= {("red ring", c, i, -s) for s, i in best}
    assert {x for x in got if x[1] != "semantic"} == want
    assert len([x for x in got if x[1] == "semantic"]) == 4 and all(x[3] == 1.0 for x in got if x[1] == "semantic")
    assert {r["task"] for r in V.exhaustive(tasks, df, limit=150).groupBy("task").agg(F.count("*").alias("n")).where("n = 150").collect()} == {"red ring"}


@pytest.mark.parametrize("name", ["joint_context_compute", "power_analysis"])
def test_made_up_inputs_are_read_from_a_table(spark, name):
    from millrace.catalog import queries

    files = queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("lineitem" in f for f in files)


def test_scope_joins_of_few_and_many_dependencies_agree(spark):
    from millrace.operators import scope as S

    tasks = spark.createDataFrame([(i, "fix a/x.go", f"p{i % 3}" if i % 2 else None, "p2") for i in range(40)], "task long, text string, package string, cwd string")
    paths = spark.createDataFrame([(i, f"p{i % 4}/f.go") for i in range(0, 40, 3)], "task long, path string")
    deps = spark.createDataFrame([("p0", "p1"), ("p1", "p2"), ("p2", "p0"), ("p2", "a"), ("a", "q")], "package string, dependency string")
    few, many = (S.infer(tasks, paths, paths, deps, few=n) for n in (100, 0))
    for a, b in zip(few, many, strict=True):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert (1, "q") in {(r["task"], r["member"]) for r in few[0].where("signals = 'dep_neighborhood' and tier = 'secondary'").collect()}
    assert few[0].where("tier = 'primary' and signals like '%dep_neighborhood%'").count() == 0
