"""Hand-valued cases and invariants of operators."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import evidence, graph, memory, packing, ranking, statistics
from millrace.streaming import ingest, limits


def one(df):
    return df.collect()[0][0]


def test_tokens(spark):
    d = spark.createDataFrame([("The the, a QUICK-brown_fox é1x  zz", ""), (None, " ")], "s string, e string")
    got = d.select(T.tokens(F.col("s")), T.all_tokens(F.col("s")), T.estimate_tokens(F.col("e"))).collect()
    assert got[0][0] == ["the", "quick", "brown_fox", "1x", "zz"] and got[0][1][:2] == ["the", "the"] and got[0][2] == 1 and got[1][0] is None


@pytest.mark.parametrize("word,value", [("", 2166136261), ("a", 0xE40C292C), ("foobar", 0xBF9CF968)])
def test_fnv1a(spark, word, value):
    assert one(spark.range(1).select(T.fnv1a(F.lit(word)))) == value


def test_overlap_and_cosine(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    r = spark.range(1).select(T.overlap(a("x", "y"), a("y", "z")), T.overlap(F.array().cast("array<string>"), a("y")), T.cosine(a(1.0, 0.0), a(0.0, 0.0)), T.cosine(a(1.0, 2.0), a(2.0, 4.0))).collect()[0]
    assert list(r)[:3] == [0.5, 0.0, 0.0] and abs(r[3] - 1) < 1e-9


def test_bm25_orders_the_tiny_corpus(spark):
    docs = ["kafka outbox pattern kafka outbox", "kafka consumer with outbox table and a long tail of words here", "kafka only", "nothing of the kind"]
    d = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    for f in (ranking.bm25, ranking.bm25_plus, ranking.bm25_l):
        s = {r["key"]: r["score"] for r in ranking.lexical_scores(d, "id", "text", ["kafka", "outbox"], f).collect()}
        assert set(s) == {0, 1, 2} and s[0] > s[1] > s[2] > 0


def test_rrf_and_tiers(spark):
    d = spark.createDataFrame([("a", 2, 0.9), ("a", 1, 0.1), ("a", 1, 0.3), ("b", 3, 1.0)], "k string, tier int, score double")
    assert sorted(map(tuple, ranking.merge_tiers(d, ["k"], "tier", "score").collect())) == [("a", 1, 0.3), ("b", 3, 1.0)]
    assert abs(one(spark.range(1).select(ranking.rrf(F.lit(1), F.lit(2), F.lit(3)))) - (1 / 61 + 1 / 62 + 1 / 63)) < 1e-12


def test_greedy_goes_on_after_an_item_that_does_not_fit(spark):
    rows = [("q", 1, 60, 6.0, 0.9), ("q", 2, 70, 7.0, 0.8), ("q", 3, 40, 1.0, 0.7), ("q", 4, 10, 9.0, None)]
    d = spark.createDataFrame(rows, "g string, id long, tokens long, score double, density double")
    assert list(packing.greedy_pack(d, "g", 100).collect()[0]) == ["q", 100, [1, 3], 7.0]
    big = spark.createDataFrame([("q", 1, 10, 1.0, 0.9), ("q", 2, 95, 5.0, 0.05)], d.schema)
    assert list(packing.singleton_rescue(big, "g", 100).collect()[0]) == ["q", 95, [2], 5.0, True]


def test_selectors_keep_to_the_budget_and_avoid_repeats():
    r = random.Random(1)
    for _ in range(40):
        rows = [(i, r.randint(1, 30), r.random(), frozenset(r.sample("abcdefgh", 3)), "decision", r.random(), r.random()) for i in range(10)]
        for f in packing.SELECTORS.values():
            got = f(rows, 60)
            assert len(set(got)) == len(got) and sum(rows[i][1] for i in got) <= 60
    twins = [(0, 10, 1.0, frozenset("ab")), (1, 10, 0.9, frozenset("ab")), (2, 10, 0.7, frozenset("cd"))]
    assert packing.submodular(twins, 20) == packing.lazy_greedy(twins, 20) == [0, 2]


def test_pagerank_of_a_chain_and_paths(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("b", "d", 1.0), ("d", "c", 1.0)], "src string, dst string, weight double")
    n = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    r = {x["id"]: x["rank"] for x in graph.personalised_pagerank(n, e, spark.createDataFrame([("a", 1.0)], "id string, weight double"), iterations=4).collect()}
    assert max(r.values()) == 1.0 and r["c"] > r["d"]
    assert sorted(x["path"] for x in graph.simple_paths(e, "a", "c", 3).collect()) == [["a", "b", "c"], ["a", "b", "d", "c"]]
    assert {x["id"]: x["depth"] for x in graph.closure(e, n.where("id = 'a'"), 2).collect()} == {"a": 0, "b": 1, "c": 2, "d": 2}


def test_staleness_cases(spark):
    m = [(1, "src/a.go", "file", 1, None, None), (2, "src", "file", 1, None, None), (3, "lib/x", "file", 1, None, None), (4, "", "file", 1, None, None), (5, "src/a.go", "file", 9, None, None), (6, "x", "file", 1, 3, None), (7, "gone", "file", 1, None, None), (8, "src/a.go/inner", "file", 1, None, None)]
    d = spark.createDataFrame(m, "id long, location string, scope string, valid_from long, invalidated_at long, superseded_by long")
    c = spark.createDataFrame([("src/a.go", "M"), ("src/b.go", "M"), ("gone/f", "D")], "path string, status string")
    got = {r["id"]: (round(r["risk"], 4), r["hard"]) for r in memory.staleness(d, c, 9).collect()}
    assert got == {1: (0.8, False), 2: (0.9, False), 3: (0.0, False), 4: (0.25, False), 5: (0.0, False), 6: (1.0, True), 7: (1.0, True), 8: (0.8, False)}


def test_belief_is_clamped(spark):
    b = one(spark.range(1).select(memory.belief(F.lit(0.5), F.array(*[F.lit("user_decision")] * 30))))
    assert b == 0.999


def test_classes(spark):
    paths = {"a/vendor/x.go": "vendored", "a/x_test.go": "test", "docs/x": "documentation", "web/a.min.js": "build_artifact", "src/gen/x.go": "generated", "src/x.go": "authoritative", "x.bin2": "unknown", "fixtures/a.json": "fixture", ".cache/a.go": "cache", "build/x.go": "build_artifact"}
    d = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r[0]: r[1] for r in d.select("p", evidence.classify(F.col("p"))).collect()} == paths


def test_symbols(spark):
    d = spark.createDataFrame([("f", "func (s *S) Run(x int) {\n  y\ntype T struct {\ndef go(a):\nexport class K {\n")], "p string, t string")
    got = [(r["line"], r["kind"], r["name"]) for r in evidence.symbols(d, "p", "t").orderBy("line").collect()]
    assert got == [(1, "function", "Run"), (3, "type", "T"), (4, "function", "go"), (5, "class", "K")]


def test_intervals_and_power(spark):
    assert statistics.power_size(0.05, 0.1) == 63
    v = spark.createDataFrame([(float(i % 10),) for i in range(400)], "x double")
    lo, hi = statistics.bootstrap_interval(v, "x", 100).collect()[0]
    assert lo < 4.5 < hi and hi - lo < 1.2
    assert statistics.permutation_p(v, "x", 100).collect()[0][0] <= 0.01


def test_bucket_and_its_fold_agree(spark):
    times = [0.0, 0.1, 0.2, 0.3, 5.0, 5.1, 9.0]
    tokens, last, ok = 2.0, None, 0
    for s in times:
        yes, tokens, _ = limits.allow(tokens, last, s, 0.5, 2.0)
        last, ok = s, ok + yes
    d = spark.createDataFrame([(times,)], "a array<double>").select(F.transform("a", lambda s: F.struct(s.alias("s"))).alias("a"))
    b = d.select(limits.bucket_fold(F.col("a"), 0.5, 2.0).alias("b")).collect()[0]["b"]
    assert b["allowed"] == ok and abs(b["tokens"] - tokens) < 1e-9


def events(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", i % 3, "error" if i % 7 == 0 else "click", float(i), f"note {i}") for i in range(600)]
    d = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, text string").withColumn("ts", F.to_timestamp("ts"))
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    return d


def drained(df, name, mode="complete"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_stream_equals_batch(spark, tmp_path):
    d = events(spark, tmp_path)
    s = ingest.events_stream(spark, str(tmp_path / "in"), d.schema)
    for name, f in (("w", ingest.windowed), ("u", ingest.running_usage)):
        want = sorted(map(str, f(d).collect()))
        assert sorted(map(str, drained(f(s), name).collect())) == want
    assert ingest.quota_alerts(ingest.running_usage(d), 70000.0).count() >= 1


def test_stream_ingest_and_limits(spark, tmp_path):
    d = events(spark, tmp_path)
    s = ingest.events_stream(spark, str(tmp_path / "in"), d.schema)
    ingest.ingest(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    m = spark.read.parquet(str(tmp_path / "out/memories"))
    assert m.count() == 600 and m.where("kind = 'failure'").count() == d.where("event_type = 'error'").count()
    seconds = s.select("user_id", F.unix_timestamp("ts").cast("double").alias("s"))
    got = drained(limits.limit_stream(seconds, "user_id", "s", 0.001, 2.0), "lim", "append")
    assert got.count() == 600 and 0 < got.where("allowed").count() < 600


def test_entry_survives_without_the_removable_parts(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_symbols_by_keyword(spark):
    text = "\n".join(["func (s *Store) Load(x int) {", "  type Node struct {", "export async function run$1(", "class Foo:", "export class Bar {", "  def go_on(self):", "public static class Baz {", "private enum Kind {", "interface Shape", "functional(x)", "typed struct", "  return class", "type Alias = int"])
    d = spark.createDataFrame([("a.x", text)], "p string, t string")
    got = [(r["line"], r["kind"], r["name"]) for r in evidence.symbols(d, "p", "t").orderBy("line").collect()]
    want = ["Load", "Node", "run$1", "Foo", "Bar", "go_on", "Baz", "Kind", "Shape"]
    kinds = ["function", "type", "function", "class", "class", "function", "type", "type", "type"]
    assert got == [(i + 1, k, n) for i, (k, n) in enumerate(zip(kinds, want, strict=True))]


def test_symbols_of_languages(spark):
    files = [
        ("a.go", "func (s *Store[T]) Load(x int) {\nclass No {\nfunc Map[T any](x T)\ntype S interface {"),
        ("b.py", "async def go(x):\nclass K(Base):\nfunction no(x) {\ndef nothing"),
        ("c.rs", "pub(crate) async fn run<T>(x: T) {\npub struct Point {\nimpl Trait for X\nlet fn_ = 1;"),
        ("d.rb", "def each\nmodule Tools\nend"),
        ("e.kt", "private sealed interface Shape\nrecord Pair(int a)\npublic int size() {"),
        ("f.ts", "export default class App {\nexport enum Color {\ndeclare function f<T>(x: T)\nfunction () {"),
        (None, None),
        ("g.md", ""),
    ]
    d = spark.createDataFrame(files, "p string, t string")
    got = sorted((r["path"], r["line"], r["kind"], r["name"]) for r in evidence.symbols(d, "p", "t").collect())
    assert got == [
        ("a.go", 1, "function", "Load"), ("a.go", 3, "function", "Map"), ("a.go", 4, "type", "S"), ("b.py", 1, "function", "go"), ("b.py", 2, "class", "K"),
        ("c.rs", 1, "function", "run"), ("c.rs", 2, "type", "Point"), ("d.rb", 1, "function", "each"), ("d.rb", 2, "type", "Tools"),
        ("e.kt", 1, "type", "Shape"), ("e.kt", 2, "type", "Pair"), ("f.ts", 1, "class", "App"), ("f.ts", 2, "type", "Color"), ("f.ts", 3, "function", "f"),
    ]


def test_draws_do_not_depend_on_the_layout(spark):
    rows = [(i, float((i * 7919) % 101)) for i in range(3000)]
    d = spark.createDataFrame(rows, "k long, x double")
    for f in (statistics.bootstrap_interval, statistics.permutation_p):
        for key in ("k", None):
            a, b = (f(d.repartition(n, "x"), "x", 60, key=key).collect()[0] for n in (1, 5))
            assert [round(v, 9) for v in a] == [round(v, 9) for v in b]


def test_lazy_greedy_equals_the_eager_form():
    import random

    from millrace.operators import packing

    r = random.Random(1)
    for _ in range(500):
        rows = [(i, r.randrange(0, 9), r.choice([-1.0, 0.0, 0.5, 1.0, 2.5, 3.0]), frozenset(r.sample("abcdefgh", r.randrange(5)))) for i in range(r.randrange(1, 9))]
        budget = r.randrange(1, 30)
        lazy, eager = packing.lazy_greedy(rows, budget), packing.submodular(rows, budget)
        assert lazy == eager


def test_token_classes(spark):
    from millrace.functions import text as T

    want = {"the": "STOPWORD", "a/b": "PATH/FILENAME", "main.go": "PATH/FILENAME", "os.path": "SYMBOL", "fooBar": "SYMBOL", "FooBar": "SYMBOL", "v2": "SYMBOL", "Bunker": "SYMBOL", "HTTP": "SYMBOL", "WHO": "ENTITY", "snake_case": "IDENTIFIER", "kebab-case": "IDENTIFIER", "verify": "ACTION", "explain": "GENERIC", "cache": "TECHNICAL_TERM", "9.5": "TECHNICAL_TERM"}
    d = spark.createDataFrame([(k,) for k in want], "x string")
    c = T.token_class(d["x"])
    got = {r["x"]: (r["c"], r["p"]) for r in d.select("x", c.alias("c"), T.token_priority(c).alias("p")).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert got["a/b"][1] == 1 and got["the"][1] == 8 and got["cache"][1] == 5


def test_similar_sets_lose_no_pair(spark):
    import random

    from millrace.operators import ranking

    r = random.Random(3)
    sets = [{r.randrange(30) for _ in range(r.randrange(1, 12))} for _ in range(80)]
    sets += [s | {99} for s in sets[:20]] + [set()]
    d = spark.createDataFrame([(i % 2, i, sorted(map(str, s))) for i, s in enumerate(sets)], "g int, k long, t array<string>")
    got = {(x["a"], x["b"]): x["jaccard"] for x in ranking.similar_sets(d, "g", "k", "t", 75).collect()}
    want = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and i % 2 == j % 2 and a and b and 100 * len(a & b) >= 75 * len(a | b)}
    assert got == pytest.approx(want) and want


def test_global_rank_is_row_number(spark):
    from pyspark.sql import functions as F

    from millrace.operators import ranking

    d = spark.range(500).select("id", (F.col("id") * 7919 % 50).alias("score"))
    got = {r["id"]: r["score_rank"] for r in ranking.ranks(d, "id", "score").collect()}
    order = sorted(range(500), key=lambda i: (-(i * 7919 % 50), i))
    assert got == {i: n + 1 for n, i in enumerate(order)}


def test_selection_by_utility():
    from itertools import combinations

    from millrace.operators import packing

    rows = [(1, 3, 0.0, frozenset("abc")), (2, 2, 0.0, frozenset("cd")), (3, 4, 0.0, frozenset("efgh")), (4, 1, 0.0, frozenset("a")), (5, 9, 0.0, frozenset("xyz"))]
    cover = lambda rs: float(len(frozenset().union(*(r[3] for r in rs)))) if rs else 0.0
    got = packing.by_utility(rows, 8, cover)
    by = {r[0]: r for r in rows}
    assert sum(by[i][1] for i in got) <= 8 and len(set(got)) == len(got)
    best = max(cover(s) for n in range(5) for s in combinations(rows, n) if sum(r[1] for r in s) <= 8)
    assert cover([by[i] for i in got]) >= 0.6 * best and packing.by_utility([], 8, cover) == []


def test_max_score_prunes_nothing_of_the_top(spark):
    import random

    from millrace.operators import retrieval

    r = random.Random(5)
    hits = [(k, t, r.random() * m) for k in range(60) for t, m in (("a", 3.0), ("b", 2.0), ("c", 1.0)) if r.random() < 0.6]
    h = spark.createDataFrame(hits, "key int, term string, weight double")
    b = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "term string, most double")
    want = {}
    for k, _, w in hits:
        want[k] = want.get(k, 0.0) + w
    top = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:5]
    got = sorted(((x["key"], x["score"]) for x in retrieval.max_score_topk(h, b, 5).collect()), key=lambda x: (-x[1], x[0]))[:5]
    assert [g[0] for g in got] == [x[0] for x in top] and [g[1] for g in got] == pytest.approx([x[1] for x in top])


def test_globs():
    import re

    from millrace.operators import retrieval

    hit = lambda p, x: re.search(retrieval.glob(p), x) is not None
    assert hit("vendor", "vendor/a.go") and hit("vendor/", "vendor") and not hit("vendor", "vendored/a")
    assert hit("**/x?.go", "a/b/x1.go") and hit("**/x?.go", "x1.go") and not hit("**/x?.go", "a/x12.go")
    assert hit("a/*.py", "a/b.py") and not hit("a/*.py", "a/c/b.py") and hit("a/**", "a/c/b.py")
