"""Search in tiers and by prefixes against plain loops."""

import re

from millrace.operators import search


def test_cascade_equals_loops(spark):
    nodes = [(1, "load_file", "pkg/io/load.go", "load_file reads", 5), (2, "loader", "pkg/io/load.go", "loader type", 9), (3, "Plan", "pkg/plan/plan.go", "a plan of loads", 2), (4, "planner", "pkg/plan/planner.go", "planner of plans", 7), (5, "x", "cmd/tool/main.go", "the floor plan", 1), (6, "load_file", "other/load.go", "again", 5)]
    queries = [("a", "open pkg/io/load.go now"), ("b", "load_file"), ("c", "where is the plan"), ("d", "?"), ("e", ""), ("f", None), ("g", "oader"), ("h", "zzz"), ("i", "pkg/x/Plan"), ("j", "PLAN load")]
    limit = 3

    def plain(text):
        tokens = sorted({re.sub(r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", "", w) for w in re.split(r"\s+", text or "")} - {""}, key=lambda t: (-len(t), t))
        tokens = [t for t in tokens if len(t) >= 2]
        if not tokens:
            return sorted((n[0], 4) for n in sorted(nodes, key=lambda n: (-n[4], n[0]))[:limit])
        sym = lambda t: bool(re.search("_|[0-9]|[a-z][A-Z]", t))
        rest = sorted([t for t in tokens if "/" not in t], key=lambda t: (not sym(t), -len(t), t))
        tests = [
            (limit, limit, lambda n: any("/" in t and (n[2] == t or n[1].lower() == t.split("/")[-1].lower()) for t in tokens)),
            (limit, limit, lambda n: n[1] in rest[:16]),
            (limit, limit, lambda n: any(n[1].lower().startswith(t.lower()) or f"/{t.lower()}" in n[2].lower() for t in [t for t in rest if len(t) >= 3][:6])),
            (min(limit, 10), 10, lambda n: any(t.lower() in n[3].lower() or t.lower() in n[2].lower() for t in [t for t in rest if len(t) >= 3 and not sym(t)][:2])),
        ]
        got = []
        for tier, (full, most, fits) in enumerate(tests):
            if len(got) < full:
                new = sorted([n for n in nodes if fits(n) and n[0] not in {g[0] for g in got}], key=lambda n: (-n[4], n[0]))
                got += [(n[0], tier) for n in new[: min(most, limit - len(got))]]
        return sorted(got)

    q = spark.createDataFrame(queries, "query string, text string")
    n = spark.createDataFrame(nodes, "id long, name string, path string, text string, weight long")
    got = {k: [] for k, _ in queries}
    for r in search.cascade(q, n, limit).collect():
        got[r["query"]].append((r["id"], r["tier"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain(t) for k, t in queries}
    assert search.cascade(q.limit(0), n, limit).count() == 0 and search.cascade(q, n.limit(0), limit).count() == 0


def test_prefix_search_falls_back_to_the_latest(spark):
    docs = spark.createDataFrame([(1, "loading files"), (2, "loads and loads"), (3, "nothing"), (4, None)], "id long, text string")
    queries = spark.createDataFrame([("a", "load"), ("b", "zzzz load file"), ("c", "abc"), ("d", None)], "query string, text string")
    got = sorted((r["query"], r["id"], r["score"] > 0, r["found"]) for r in search.prefix_search(queries, docs, 2).collect())
    assert got == [("a", 1, True, True), ("a", 2, True, True), ("b", 1, True, True), ("b", 2, True, True), ("c", 3, False, False), ("c", 4, False, False), ("d", 3, False, False), ("d", 4, False, False)]
