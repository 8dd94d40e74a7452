"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample (SAMPLE vectors of the smallest hash) by
k-means whose small clusters are given to large ones until no cluster is much above
the mean. Every vector is indexed: it stands in the list of its nearest centroid
and, near a border, in up to REPLICAS lists whose centroid is at most 1 + BORDER
times as far. There is a list for about LIST vectors, up to MOST_LISTS; lists that
are still long are divided by seeds, as many members as there should be parts, by
the same rule; so no number of lists has to be held by one process.

A query walks a graph of centroids in memory (each joined to its nearest ones and
to a ring): from a few entries it goes on to the neighbours of all centroids within
the distance ratio of the best so far, until there is nothing new. The ratio also
selects the lists (LEAST_PROBES at least), and the parts of divided ones. Lists are
cut into tiles, held one at a time while their queries stream past; a task returns
of each tile only what may be among the nearest.

An exact check follows: with the distance of the k + 1st found, a query also searches
what it left out and the triangle inequality does not exclude (a list's members lie
between its least and largest distance from the centroid). There only the lists
nearest to a vector count, so no vector is compared twice. A query that has found
fewer than k excludes nothing, so it gets k or all there are.

Equal vectors (128-bit hashes) are one entry with its k + 1 smallest rows, which no
query needs more of, so a group of copies costs one entry and one search.

So the results are those of brute force. On vectors that lie nearly at random in many
dimensions nothing is excluded and a query reads the whole table; where there is
structure the check reads few lists. README has the share that the walk alone finds.

Defined cases: null, empty and zero vectors and those with null or non-finite
components take no part; only vectors of one length are compared; repeated rows are
neighbours of each other; a null id is no query and comes last among equals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.bytesfast import frugal
from millrace.llm.embeddings import _vectors
from millrace.llm.keys import table
from millrace.sources.work import spread

K = 10
SAMPLE, LIST, MOST_LISTS, TILE = 20_000, 128, 2048, 1024
REPLICAS, BORDER, RATIO, LEAST_PROBES = 3, 0.1, 0.22, 4
DIVIDE = 8
LINKS, ENTRIES = 16, 32
FAR = 1e100


def _padded(vs: list[np.ndarray], d: int) -> np.ndarray:
    """Vectors as rows of d components, for choosing lists only: cut or filled with zeros, and held to finite squares."""
    out = np.zeros((len(vs), d))
    for i, v in enumerate(vs):
        out[i, : min(d, len(v))] = v[:d]
    return np.clip(out, -FAR, FAR)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T)))


def fit(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centroids of balanced clusters of the sample: after a round, those with few members move next to members of those with many."""
    c = sample[:lists].copy()
    for turn in range(rounds):
        at = np.concatenate([_distances(sample[z : z + 4096], c).argmin(1) for z in range(0, len(sample), 4096)])
        n = np.bincount(at, minlength=lists)
        sums = np.zeros_like(c)
        np.add.at(sums, at, sample)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if turn < rounds - 2:
            order = np.argsort(n, kind="stable")
            mean = len(sample) / lists
            for small, large in zip(order, order[::-1], strict=True):
                if n[large] <= 2 * mean or n[small] >= mean / 2:
                    break
                c[small] = sample[np.flatnonzero(at == large)[turn % n[large]]]
    return c


def link(c: np.ndarray) -> np.ndarray:
    """The graph: for each centroid its nearest others, and the next and last by number so that all are reached."""
    n, m = len(c), min(LINKS, len(c) - 1)
    near = np.zeros((n, m), np.int64)
    for z in range(0, n, 1024):
        d = _distances(c[z : z + 1024], c)
        d[np.arange(len(d)), np.arange(z, z + len(d))] = np.inf
        if m:
            near[z : z + 1024] = np.argsort(d, axis=1, kind="stable")[:, :m]
    ring = np.arange(n)[:, None]
    return np.concatenate([near, (ring + 1) % n, (ring - 1) % n], 1)


def walk(x: np.ndarray, c: np.ndarray, graph: np.ndarray, ratio: float) -> np.ndarray:
    """Distances of rows of x to the centroids met on the walk; infinite where it did not come."""
    n, k = len(x), len(c)
    d = np.full((n, k), np.inf)
    start = np.unique(np.linspace(0, k - 1, min(k, ENTRIES)).astype(np.int64))
    d[:, start] = _distances(x, c[start])
    closed = np.zeros((n, k), bool)
    while True:
        open_ = (d <= d.min(1)[:, None] * (1 + ratio)) & ~closed & np.isfinite(d)
        if not open_.any():
            return d
        closed |= open_
        q, at = np.nonzero(open_)
        q, to = np.repeat(q, graph.shape[1]), graph[at].ravel()
        new = np.unique(q[np.isinf(d[q, to])] * k + to[np.isinf(d[q, to])])
        for z in range(0, len(new), 1 << 16):
            q, to = new[z : z + (1 << 16)] // k, new[z : z + (1 << 16)] % k
            d[q, to] = np.sqrt(((x[q] - c[to]) ** 2).sum(1))


def _chosen(d: np.ndarray, ratio: float, least: int, most: int) -> np.ndarray:
    """Which columns of each row are taken: those within the ratio of the nearest, `least` and at most `most`, the nearest first (ties: the lower)."""
    order = np.argsort(d, axis=1, kind="stable")
    near = np.take_along_axis(d, order, 1)
    take = (near <= near[:, :1] * (1 + ratio)) & np.isfinite(near)
    take[:, :least] = np.isfinite(near[:, :least])
    take[:, most:] = False
    out = np.zeros(d.shape, bool)
    np.put_along_axis(out, order, take, 1)
    return out


@frugal
def _list_batches(it, held, query: bool, ratio: float, least: int, most: int):
    """A row for each vector and list that it stands in (or, if query, that it searches)."""
    c, graph = held.value
    for whole in it:
        for batch in (whole.slice(z, 256) for z in range(0, whole.num_rows, 256)):
            x = _padded(_vectors(batch.column("v")), c.shape[1])
            d = walk(x, c, graph, ratio) if query else _distances(x, c)
            row, to = np.nonzero(_chosen(d, ratio, least, most))
            first, far = pa.array(to == d.argmin(1)[row]), pa.array(d[row, to])
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *(batch.column(n).take(pa.array(row)) for n in ("cid", "least", "dim", "v")), first, far], names=["list", "cid", "least", "dim", "v", "first", "far"])


def _slack(x: np.ndarray, c: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """More than what rounding can take from a difference of two computed distances to the rows of c."""
    norm = lambda m: np.sqrt((m * m).sum(1))
    return np.sqrt(1e-15 * c.shape[1]) * (norm(x)[:, None] + 2 * norm(c) + np.where(np.isfinite(hi), hi, 0))


@frugal
def _open_batches(it, held, rings):
    """A row for each query (with bound) and list that may hold something within its bound: least is what its members are away at least."""
    c, _ = held.value
    lo, hi = rings.value
    for whole in it:
        for batch in (whole.slice(z, 256) for z in range(0, whole.num_rows, 256)):
            x = _padded(_vectors(batch.column("v")), c.shape[1])
            d, slack = _distances(x, c), _slack(x, c, hi)
            bound = np.asarray(batch.column("bound").to_numpy(zero_copy_only=False), np.float64)
            with np.errstate(invalid="ignore"):
                row, to = np.nonzero(~(np.maximum(d - hi, lo - d) - slack > bound[:, None]) & (lo <= hi))
            cols = [pa.array(to, pa.int32()), *(batch.column(n).take(pa.array(row)) for n in ("cid", "dim", "bound")), pa.array(d[row, to]), pa.array(slack[row, to])]
            yield pa.RecordBatch.from_arrays(cols, names=["list", "cid", "dim", "bound", "away", "slack"])


def _meet(held: DataFrame, streamed: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """work(key, ids, leasts, vectors held, then of those streamed) for slices of the streamed rows of each key. Held rows of a key must be bounded."""
    rows = ["cid", "least", "v"]
    both = held.select(*keys, F.lit(0).alias("kind"), *rows).unionByName(streamed.select(*keys, F.lit(1).alias("kind"), *rows))
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @frugal
    def run(it):
        key, mine = None, []
        for whole in it:
            for batch in (whole.slice(z, 512) for z in range(0, whole.num_rows, 512)):
                names = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*keys, "kind")], 1)
                ends = [*(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1).tolist(), len(names)]
                ids, leasts, vs = batch.column("cid").to_numpy(), batch.column("least").to_numpy(zero_copy_only=False), _vectors(batch.column("v"))
                lo = 0
                for hi in ends:
                    if tuple(names[lo, :-1]) != key:
                        key, mine, packed = tuple(names[lo, :-1]), [], None
                    if names[lo, -1] == 0:
                        mine.append((ids[lo:hi], leasts[lo:hi], vs[lo:hi]))
                    elif mine:
                        if packed is None:
                            packed = np.concatenate([m[0] for m in mine]), np.concatenate([m[1] for m in mine]), [v for m in mine for v in m[2]]
                        yield from work(key, *packed, ids[lo:hi], leasts[lo:hi], vs[lo:hi])
                    lo = hi

    return both.repartition(parts, *keys).sortWithinPartitions(*keys, "kind", "cid").mapInArrow(run, schema)


def _dividing(ratio: float, least: int, most: int):
    """Streamed vectors and the seeds of their list: a row for each part taken."""

    def work(key, seeds, _, at, ids, leasts, vs):
        d = max(map(len, at))
        away = _distances(_padded(vs, d), _padded(at, d))
        row, to = np.nonzero(_chosen(away, ratio, least, most))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), key[0]), pa.int32()), pa.array(to, pa.int32()), pa.array(ids[row]), pa.array(to == away.argmin(1)[row])], names=["list", "sub", "cid", "leads"])

    return work


def _searching(k: int):
    """Streamed queries and the vectors of their tile: a row for each vector that may be among a query's nearest."""
    bounds: dict = {}

    def work(_, cids, leasts, vs, queries, __, qs):
        if len(bounds) > 100_000:
            bounds.clear()
        h, q = np.stack(vs), np.stack(qs)
        with np.errstate(all="ignore"):
            size = (h * h).sum(1)
            rough = (q * q).sum(1)[:, None] + size - 2 * (q @ h.T)
            slack = 1e-9 * ((q * q).sum(1) + size.max())
            most = np.partition(rough, k - 1, axis=1)[:, k - 1] if k <= len(h) else np.full(len(q), np.inf)
            most = np.minimum(most, [bounds.get(i, np.inf) for i in queries.tolist()]) + slack
            row, col = np.nonzero(~(rough > most[:, None]))
            d = np.sqrt(((q[row] - h[col]) ** 2).sum(1))
        order = np.lexsort((np.isnan(leasts[col]), leasts[col], d, row))
        row, col, d = row[order], col[order], d[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        for i in np.flatnonzero(place == k - 1).tolist():
            name = int(queries[row[i]])
            bounds[name] = min(bounds.get(name, np.inf), float(d[i]) ** 2)
        row, col, d = row[keep], col[keep], d[keep]
        yield pa.RecordBatch.from_arrays([pa.array(queries[row]), pa.array(cids[col]), pa.array(d)], names=["q", "cid", "d"])

    return work


def nearest(vectors: DataFrame, query: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, lists: int | None = None, ratio: float = RATIO, divide: int = DIVIDE * LIST, tile: int = TILE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where `query` holds (a Column of the table; ids that 100 divides), its k nearest others."""
    spark = vectors.sparkSession
    kind = vectors.schema[embedding].dataType.elementType.simpleString()
    v = vectors[embedding].cast(f"array<{kind if kind in ('float', 'double') else 'double'}>")
    asked = F.coalesce(query if query is not None else vectors[vec_id] % 100 == 0, F.lit(False))
    src = spread(vectors).select(vectors[vec_id].alias("id"), v.alias("v"), asked.alias("asked"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    hashes = (F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), F.reverse("v")).alias("h2"))
    rows = table(src.where(F.coalesce(fine, F.lit(False))).select("*", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("rid"), *hashes), "vectors")
    repeats = table(rows.groupBy("h1", "h2").agg(F.min("rid").alias("cid"), F.min("id").alias("least"), F.count("*").alias("c"), F.max("asked").alias("some")).where("c > 1"), "repeats")
    named = rows.select("rid", "id", "asked", "h1", "h2", "dim", "v").join(repeats, ["h1", "h2"], "left")
    single = F.col("cid").isNull()
    named = named.select("rid", "id", "asked", "dim", F.coalesce("cid", "rid").alias("cid"), F.when(single, F.col("id")).otherwise(F.col("least")).alias("least"), F.coalesce("some", "asked").alias("some"), (~single).alias("repeated"), "h1", "v")
    named = table(named, "named")
    classes = named.where("rid = cid").select("cid", F.col("least").try_cast("double").alias("least"), "dim", "v", "some", "h1")
    n = classes.count()
    if not n:
        return named.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))

    share = min(1.0, 1.5 * SAMPLE / n)
    picked = classes.where(F.pmod("h1", F.lit(1 << 30)) <= int(share * (1 << 30))).select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE)
    sample = [np.array(r["v"], np.float64) for r in picked.collect()]  # at most SAMPLE vectors
    if lists is None:
        lists = -(-n // LIST)
    lists = max(1, min(lists, MOST_LISTS, len(sample)))
    centroids = fit(_padded(sample, max(map(len, sample))), lists) if sample else np.zeros((1, 1))
    held = spark.sparkContext.broadcast((centroids, link(centroids)))
    lists = len(centroids)
    listed = f"list int, cid bigint, least double, dim int, v {classes.schema['v'].dataType.simpleString()}, first boolean, far double"
    base = ["cid", "least", "dim", "v"]
    posts = table(classes.select(*base).mapInArrow(lambda it: _list_batches(it, held, False, BORDER, 1, REPLICAS), listed), "lists")
    asks = classes.where("some").select(*base)
    probes = table(asks.mapInArrow(lambda it: _list_batches(it, held, True, ratio, LEAST_PROBES, lists), listed), "probes")

    sizes = {r["list"]: r["c"] for r in posts.groupBy("list").agg(F.count("*").alias("c")).collect()}  # at most MOST_LISTS
    # of a list to be divided: one in `every` of its entries is a seed, and its rows are dealt to so many lots
    plan = [(i, max(1, c // min(-(-c // LIST), MOST_LISTS)), -(-c // (16 * tile))) for i, c in sizes.items() if c > divide]
    plan = spark.createDataFrame(plan, "list int, every bigint, lots int")
    seeds = posts.join(F.broadcast(plan), "list").where(F.pmod(F.xxhash64("cid", "list"), F.col("every")) == 0).select("list", "lots", *base)
    seeds = table(seeds, "seeds")
    plan = table(seeds.select("list", "lots").distinct(), "divided")

    def divided(df, r, least, most):
        """df with sub: the parts of a divided list that a row goes to, by the seeds; 0 for other lists."""
        lot = F.explode(F.sequence(F.lit(0), F.col("lots") - 1))
        long = df.join(F.broadcast(plan), "list").withColumn("lot", F.pmod(F.xxhash64("cid"), F.col("lots")).cast("int"))
        got = _meet(seeds.withColumn("lot", lot), long, ["list", "lot"], _dividing(r, least, most), "list int, sub int, cid bigint, leads boolean")
        rest = df.join(F.broadcast(plan), "list", "left_anti")
        both = rest.select("list", F.lit(0).alias("sub"), *base, "first", "far")
        return both.unionByName(got.join(df, ["list", "cid"]).select("list", "sub", *base, (F.col("first") & F.col("leads")).alias("first"), "far"))

    posts = table(divided(posts, BORDER, 1, REPLICAS), "posts")
    probes = table(divided(probes, ratio, LEAST_PROBES, MOST_LISTS), "parts")

    cell = ["list", "sub", "dim"]

    def found(posts, probes, name):
        """q, cid, d: of each tile of the cells in probes what may be among the k + 1 nearest of its queries."""
        cells = table(posts.groupBy(*cell).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "cells")
        tiled = posts.join(cells, cell).withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
        to = probes.join(cells, cell).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        return table(_meet(tiled, to, [*cell, "tile"], _searching(k + 1), "q bigint, cid bigint, d double"), name)

    def ranked(found):
        got = found.groupBy("q", "cid").agg(F.min("d").alias("d")).join(members, "cid")
        return got.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", *order))).where(F.col("r") <= k + 1)

    order = [F.col("id").asc_nulls_last(), F.col("rid")]
    copies = named.where("repeated").select("cid", "id", "rid", F.pmod(F.xxhash64("rid"), F.lit(64)).alias("deal"))
    for by in (["cid", "deal"], ["cid"]):  # the k + 1 smallest of a group of copies, first within shares of it
        copies = copies.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= k + 1)
    members = table(copies.select("cid", "id", "rid").unionByName(named.where("not repeated").select("cid", "id", "rid")), "members")

    walked = found(posts, probes, "walked")
    best = table(ranked(walked), "best")
    far = best.groupBy("q").agg(F.count("*").alias("there"), F.max("d").alias("d")).where(F.col("there") > k).select(F.col("q").alias("cid"), F.col("d").alias("bound"))
    bounded = asks.join(far, "cid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    # the exact check: each vector in the cell that is nearest to it, and each cell that its query has not searched
    homes = posts.where("first")
    rings = table(homes.groupBy(*cell).agg(F.min("far").alias("lo"), F.max("far").alias("hi")), "rings")
    lo, hi = np.full(lists, np.inf), np.full(lists, -np.inf)
    for r in rings.groupBy("list").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():  # at most MOST_LISTS
        lo[r["list"]], hi[r["list"]] = r["lo"], r["hi"]
    around = spark.sparkContext.broadcast((lo, hi))
    open_ = bounded.mapInArrow(lambda it: _open_batches(it, held, around), "list int, cid bigint, dim int, bound double, away double, slack double")
    open_ = open_.join(rings, ["list", "dim"]).where(~(F.greatest(F.col("away") - F.col("hi"), F.col("lo") - F.col("away")) - F.col("slack") > F.col("bound")))
    open_ = open_.select(*cell, "cid").join(probes.select(*cell, "cid"), [*cell, "cid"], "left_anti")
    checked = found(homes, table(open_.join(asks, ["cid", "dim"]).select(*cell, "cid", "least", "v"), "open"), "checked")
    found_ = best.select("q", "cid", "d").distinct().unionByName(checked)
    near = table(ranked(found_).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "d", "id", "rid"))).alias("near")), "near")

    answers = named.where("asked").select(F.col("id").alias("query_id"), F.col("rid").alias("own"), F.col("cid").alias("q")).join(near, "q")
    others = F.slice(F.filter("near", lambda x: x["rid"] != F.col("own")), 1, k)
    out = answers.select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").alias("score"))
