"""Vector codes, spelling variants and nearest neighbours against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import codes, neighbours, spelling
from millrace.llm.queries import queries
from tests.llm.util import LOWER, clash, docs, words

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


def random_rows(n, d, seed, copies=0):
    g = np.random.default_rng(seed)
    rows = [(int(i), g.normal(size=d).astype(np.float32).tolist(), int(g.integers(3)) if i % 11 else None) for i in range(n)]
    rows += [(n + j, rows[5][1], 1) for j in range(copies)] + rows[:3]
    rows += [(9001, None, 1), (9002, [float("nan")] * d, 2), (9003, [None] * d, 2), (9004, [0.0] * d, None), (9005, [float("inf")] * d, 0)]
    random.Random(seed).shuffle(rows)
    return rows


def lloyd(rows, parts=4, entries=256, rounds=4):
    """The contract, one vector at a time in whole numbers."""
    kept = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    cut = [[tuple((v + [0] * (parts * width))[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for turn in range(rounds + 1):
        got = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
        if turn == rounds:
            break
        for p in range(parts):
            group = defaultdict(list)
            for c, g in zip(cut, got, strict=True):
                group[g[p][1]].append(c[p])
            books[p] = [tuple(sum(col) // len(group[k]) for col in zip(*group[k], strict=True)) if k in group else e for k, e in enumerate(books[p])]
    label = Counter()
    for (_, _, lab), g in zip(kept, got, strict=True):
        label[lab] += sum(d for d, _ in g)
    out = [(i, "".join(f"{k:02x}" for _, k in g), sum(d for d, _ in g), label[lab]) for (i, _, lab), g in zip(kept, got, strict=True)]
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def coded(df, **k):
    got, books = codes.compress(df, **k)
    return sorted(((r["id"], r["code"].hex(), r["error"], r["label_error"]) for r in codes.with_label_errors(got).collect()), key=repr), codes.books_hash(books)


@pytest.mark.parametrize("n, d, k", [(300, 8, {}), (120, 16, {"entries": 16}), (40, 8, {"entries": 5, "rounds": 2}), (60, 6, {"entries": 7})])
def test_codes_equal_plain_lloyd(spark, n, d, k):
    rows = random_rows(n, d, n, copies=40)
    want, digest = lloyd(rows, **k)
    assert coded(vectors(spark, rows).repartition(3), **k) == (sorted(want, key=repr), digest)


def test_codes_of_odd_tables(spark):
    assert coded(vectors(spark, [])) == ([], codes.books_hash([np.zeros((0, 0))]))
    rows = [(None, [1.0, 2.0], None), (3, [-0.5, 0.25, 0.125, 9.0], 1), (3, [-0.5, 0.25, 0.125, 9.0], 1), (1, [], 2), (2, [7e4, -7e4, 1.5, 2.5, 3.5], 2), (4, [1e6] * 5, 2)]
    want, digest = lloyd(rows)
    assert coded(clash(vectors(spark, rows))) == (sorted(want, key=repr), digest)
    got = coded(vectors(spark, [(1, [3e38, -3e38], 1), (2, [-3e38, 3e38], 1)]), entries=1)[0]
    assert [r[2] for r in got] == [codes.LONG] * 2 or all(r[2] >= 0 for r in got)


def test_nearest_is_exact_beyond_doubles():
    g = np.random.default_rng(1)
    for scale in (1 << 10, 1 << 24, 1 << 30):
        x, b = g.integers(-scale, scale, (50, 4)), g.integers(-scale, scale, (9, 4))
        b[7] = b[2]
        at, d = codes.nearest(x, b)
        want = [min((sum((int(p) - int(q)) ** 2 for p, q in zip(r, e, strict=True)), i) for i, e in enumerate(b)) for r in x]
        assert [(int(y), int(z)) for y, z in zip(d, at, strict=True)] == want


def test_code_stands_for_its_entries(spark):
    got, books = codes.compress(vectors(spark, random_rows(80, 8, 3)), entries=8)
    whole = {r["id"]: np.array(r["v"]) for r in codes.whole_numbers(vectors(spark, random_rows(80, 8, 3)), "vec_id", "embedding", "label").collect()}
    for r in got.collect():
        assert int(((codes.decode(r["code"], books) - whole[r["id"]]) ** 2).sum()) == r["error"]


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows):
    import re

    n = Counter()
    for i, t in rows:
        for run in re.findall("[a-zÀ-ÿ]+", (t or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def plain_variants(n):
    out, form = {}, {}
    for w in n:
        ns = [v for v in n if near(w, v)]
        best = min(ns, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = len(ns)
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return sorted(rows)


def mutate(w, r):
    i = r.randrange(len(w) + 1)
    kind = r.randrange(3)
    ch = r.choice("abcdeé")
    return w[:i] + ch + w[i:] if kind == 0 else w[: max(0, i - 1)] + w[i:] if kind == 1 else w[: max(0, i - 1)] + ch + w[i:]


@pytest.mark.parametrize("block", [2, 5, 48])
def test_variants_equal_all_pairs(spark, block):
    r = random.Random(block)
    pool = ["abcde", "aaaaa", "aaaaaa", "abababab", "éàüöñ", "wordsmith", "a" * 300]
    for _ in range(240):
        pool.append(mutate(r.choice(pool), r))
    n = {w: r.choice([3, 4, 7, 8, 16, 33, 70]) for w in set(pool) if w}
    df = spark.createDataFrame(sorted(n.items()), "word string, n long")
    assert sorted(tuple(x) for x in spelling.group_variants(df, block).collect()) == plain_variants(n)


def test_words_of_odd_texts(spark):
    r = random.Random(4)
    pool = [mutate("wordsmith", r) for _ in range(20)] + ["Straße", "ÀÉÎõü", "plain"]
    texts = [None, "", "x" * 30_000 + " " + "y" * 30_000, *["x" * 30_000] * 3, "no_under_score-here 5five", *[" ".join(r.choice(pool).upper() if r.random() < 0.3 else r.choice(pool) for _ in range(40)) for _ in range(30)], words(3000, 5)]
    df = docs(spark, texts)
    from pyspark.sql import functions as F

    more = df.unionByName(df.limit(5)).unionByName(df.select(F.lit(None).cast("long").alias("doc_id"), "text", "lang", "source", "n_chars").limit(9))
    got = clash(more).withColumn("run", F.lit(1)).withColumn("word", F.lit("w"))
    rows = [(x["doc_id"], x["text"]) for x in more.collect()]
    counts = spelling.count_words(got)
    assert {x["word"]: x["n"] for x in counts.collect()} == plain_counts(rows)
    assert sorted(tuple(x) for x in spelling.group_variants(counts).collect()) == plain_variants(plain_counts(rows))
    assert spelling.group_variants(spelling.count_words(docs(spark, []))).count() == 0


def brute(rows, k=10):
    fine = [(i, np.asarray(v, np.float64)) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (q, v) in enumerate(fine):
        if q is not None and q % 100 == 0:
            d = sorted((float(np.sqrt(((w - v) ** 2).sum())), i is None, i or 0) for b, (i, w) in enumerate(fine) if b != a and len(w) == len(v))
            out.append((q, [(x[0], x[2]) for x in d[:k]]))
    return out


def found(df):
    got = defaultdict(list)
    for r in df.collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    return {q: [x[1:] for x in sorted(v)] for q, v in got.items()}


@pytest.mark.parametrize("k", [{"ratio": 9.0}, {"ratio": 9.0, "lists": 3, "divide": 40, "tile": 16}, {"ratio": 9.0, "lists": 12, "tile": 32}])
def test_all_lists_are_brute_force(spark, k):
    rows = [r for r in random_rows(700, 12, 8, copies=60) if r[0] < 900 or r[0] > 9000]
    rows = [r for r in rows if not (r[0] == 0)] + [next(r for r in rows if r[0] == 0)]
    want = dict(brute(rows))
    got = found(neighbours.nearest(vectors(spark, rows).repartition(3), **k))
    assert set(got) == set(want)
    for q, w in want.items():
        assert [x[1] for x in got[q]] == [x[1] for x in w] and np.allclose([x[0] for x in got[q]], [x[0] for x in w], rtol=1e-14)


def test_recall_of_the_default_search(spark):
    g = np.random.default_rng(2)
    rows = [(i, (v / np.sqrt((v * v).sum())).astype(np.float32).tolist(), 0) for i, v in enumerate(g.normal(size=(3000, 64)))]
    want, got = dict(brute(rows)), found(neighbours.nearest(vectors(spark, rows)))
    assert all(len(v) == 10 for v in got.values()) and set(got) == set(want)
    assert np.mean([len({x[1] for x in got[q]} & {x[1] for x in w}) / 10 for q, w in want.items()]) >= 0.9
    two = found(neighbours.nearest(vectors(spark, rows), divide=64, lists=5))
    assert np.mean([len({x[1] for x in two[q]} & {x[1] for x in w}) / 10 for q, w in want.items()]) >= 0.9


def test_default_search_is_exact_on_vectors_of_few_directions(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(4000, 6)) @ g.normal(size=(6, 64)) + 0.05 * g.normal(size=(4000, 64))
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    want = dict(brute(rows))
    for k in ({}, {"divide": 64, "lists": 5, "ratio": 0.0, "tile": 100}):
        got = found(neighbours.nearest(vectors(spark, rows), **k))
        assert {q: [y[1] for y in v] for q, v in got.items()} == {q: [y[1] for y in v] for q, v in want.items()}


def test_neighbours_of_odd_tables(spark):
    assert neighbours.nearest(vectors(spark, [])).count() == 0
    few = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 1.0], None), (None, [0.0, 1.0], 2), (100, [1.0, 2.0, 3.0], 1), (200, [0.0, 0.0], 1), (300, None, 1), (0, [1.0, 0.0], 1), (400, [], 1)]
    got = neighbours.nearest(clash(vectors(spark, few))).collect()
    assert sorted((r["query_id"], r["rank"], -1 if r["vec_id"] is None else r["vec_id"], round(r["score"], 6)) for r in got) == sorted([(0, 1, 0, 0.0), (0, 2, 1, 1.414214), (0, 3, 2, 1.414214), (0, 4, -1, 1.414214)] * 2)
    same = [(i, [1.0, 1.0], 0) for i in range(400)] + [(i, [1.0, -float(i)], 0) for i in range(400, 430)]
    got = found(neighbours.nearest(vectors(spark, same), lists=4, divide=10))
    assert got == {q: w for q, w in brute(same)}
    far = [(i, [1e200 * (i + 1), -1e200], 0) for i in range(40)]
    assert len(found(neighbours.nearest(spark.createDataFrame(far, "vec_id long, embedding array<double>, label int")))[0]) == 10


@pytest.mark.parametrize("name", ["op11_codes", "op12_spelling"])
def test_new_queries_equal_sql(spark, name):
    import duckdb

    from millrace.llm.oracles import oracle_sql

    data = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries()[name](spark, data)
    want = c.execute(oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[x] for x in cols)) for r in df.collect())
