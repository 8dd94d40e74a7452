"""Benchmark decontamination by winnowing.

Every text is hashed in k-grams of words; of each window of w neighbouring
k-grams the smallest hash is kept. Any span of w + k - 1 words that two texts
share then leaves a kept fingerprint in both, so with k + w - 1 = 10 no
benchmark window of 10 words is missed. Training fingerprints are joined with
the test fingerprints, and each hit is extended to the 10-word windows around
it, which are looked up among the benchmark's windows.

Two ways give the same rows. While the benchmark has at most
`broadcast_windows` windows, its fingerprints and windows (8 bytes each and the
item lists) go to every worker and the documents are read once, without a
shuffle. Above that bound nothing is broadcast: fingerprints of documents are
joined with those of the benchmark by a shuffle on the hash.

Defined cases: null or empty text has no words, no hit; an item of fewer than
10 words is one window (its k-gram is the whole item, w = 1); an item without
words, or with a null id, names no window of an item (its words still hit when
only the id is null); repeated documents and items count row by row and id by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bytesfast import LOWER, U64, Words, byte_values, frugal, grams, mix, text_slices
from millrace.llm.keys import fresh, table, text_key
from millrace.sources.work import small_batches

WINDOW = 10
K = 5
BROADCAST_WINDOWS = 1 << 17

IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
VALUES = byte_values(11)[LOWER]


def winnow(words: Words, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept fingerprints: word positions and k-gram hashes. Ties within a window are all kept."""
    g = grams(words.hash, k)
    n = len(g)
    if not n:
        return np.zeros(0, np.int64), g
    whole = words.doc_ends()[:n] >= np.arange(n) + k
    if w == 1:
        at = np.flatnonzero(whole)
        return at, g[at]
    top = ~U64(0)
    g = np.where(whole, g, top)
    padded = np.concatenate([g, np.full(w - 1, top, U64)])
    low = padded[:n].copy()
    for j in range(1, w):
        np.minimum(low, padded[j : j + n], out=low)
    keep = g == low
    for j in range(1, w):
        keep[j:] |= g[j:] == low[:-j]
    at = np.flatnonzero(keep & whole)
    return at, g[at]


@frugal
def _window_rows(it, text: str, key: str):
    """Benchmark windows: (length, window hash, k-gram hashes inside, item id or null)."""
    for batch in it:
        ids = batch.column(key)
        size, wh, fp, item = [], [], [], []
        for a, b, data, off in text_slices(batch, text):
            words = Words(data, off, IS_WORD, VALUES)
            n = np.diff(words.rows)
            for r in range(b - a):
                if not n[r]:
                    continue
                own = words.hash[words.rows[r] : words.rows[r + 1]]
                m = min(WINDOW, int(n[r]))
                k = K if m == WINDOW else m
                hashes, inner = grams(own, m), grams(own, k)
                name = ids[a + r].as_py()
                for i, h in enumerate(hashes.view(np.int64).tolist()):
                    size.append(m)
                    wh.append(h)
                    fp.append(inner[i : i + m - k + 1].view(np.int64).tolist())
                    item.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(wh, pa.int64()), pa.array(fp, pa.list_(pa.int64())), pa.array(item, pa.string())], ["size", "window", "grams", "item"])


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """size int, window long, grams array<long>, item string: a row for each window of each item."""
    src = benchmark.select(F.col(item_id).cast("string").alias("k"), F.col(text).cast("string").alias("t"))
    return src.mapInArrow(lambda it: _window_rows(it, "t", "k"), "size int, window long, grams array<long>, item string")


class _Index:
    """Windows in memory, by length: sorted k-gram hashes, sorted window hashes, item lists."""

    def __init__(self, rows):
        self.by: dict[int, tuple] = {}
        per: dict[int, dict[int, set]] = {}
        inner: dict[int, set] = {}
        for size, window, gr, item in rows:
            s = per.setdefault(size, {}).setdefault(window, set())
            if item is not None:
                s.add(item)
            inner.setdefault(size, set()).update(gr)
        for size, d in per.items():
            order = np.array(sorted(d), np.int64).view(U64)
            order.sort()
            fps = np.array(sorted(inner[size]), np.int64).view(U64)
            fps.sort()
            seen = np.zeros(1 << 20, bool)
            seen[fps & U64((1 << 20) - 1)] = True
            self.by[size] = (fps, seen, order, [sorted(d[int(x)]) for x in order.view(np.int64)])


def _member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Place of each x in the sorted array, -1 if it is not there."""
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return np.where(among[at] == x, at, -1)


def _scan(words: Words, index: _Index) -> tuple[np.ndarray, list[list[str]]]:
    """For each row of the slice: number of hit words, and the items that hit, sorted."""
    n, rows = len(words.hash), len(words.rows) - 1
    cover = np.zeros(n + 1, np.int32)
    items: dict[int, set] = {}
    ends = words.doc_ends()
    starts = np.repeat(words.rows[:-1], np.diff(words.rows))
    doc = np.repeat(np.arange(rows), np.diff(words.rows))
    for size, (fps, seen, windows, names) in index.by.items():
        k, w = (K, WINDOW - K + 1) if size == WINDOW else (size, 1)
        at, g = winnow(words, k, w)
        hit = seen[g & U64((1 << 20) - 1)]
        at, g = at[hit], g[hit]
        at = at[_member(g, fps) >= 0]
        if not len(at):
            continue
        begin = np.unique((at[:, None] - np.arange(w)[None, :])[(at[:, None] - np.arange(w)[None, :]) >= starts[at][:, None]])
        begin = begin[begin + size <= ends[begin]]
        if not len(begin):
            continue
        h = words.hash[begin].copy()  # as in grams()
        for j in range(1, size):
            h *= U64(0xD6E8FEB86659FD93)
            h += words.hash[begin + j]
        found = _member(mix(h + U64(size)), windows)
        begin, found = begin[found >= 0], found[found >= 0]
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + size, -1)
        pair = np.unique(doc[begin].astype(np.int64) * len(names) + found)
        for d, f in zip((pair // len(names)).tolist(), (pair % len(names)).tolist(), strict=True):
            items.setdefault(d, set()).update(names[f])
    inside = np.concatenate([[0], np.cumsum(np.cumsum(cover[:n]) > 0)])
    return inside[words.rows[1:]] - inside[words.rows[:-1]], [sorted(items.get(r, ())) for r in range(rows)]


@frugal
def _scan_batches(it, text: str, index_b, keep: int):
    index = index_b.value
    for batch in it:
        n_words, n_hit, items = [], [], []
        for _, _, data, off in text_slices(batch, text):
            words = Words(data, off, IS_WORD, VALUES)
            hits, found = _scan(words, index)
            n_words.append(np.diff(words.rows))
            n_hit.append(hits)
            items += found
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:keep], cat(n_words), cat(n_hit), pa.array(items, pa.list_(pa.string()))], names=[*batch.schema.names[:keep], "n_words", "n_hit", "items"])


@frugal
def _fp_batches(it, text: str, sizes: list[int]):
    """For the joined way: each kept fingerprint with the windows around it."""
    for batch in it:
        for a, b, data, off in text_slices(batch, text, 1 << 20):
            words = Words(data, off, IS_WORD, VALUES)
            ends = words.doc_ends()
            starts = np.repeat(words.rows[:-1], np.diff(words.rows))
            doc = np.repeat(np.arange(a, b), np.diff(words.rows))
            for size in sizes:
                k, w = (K, WINDOW - K + 1) if size == WINDOW else (size, 1)
                at, g = winnow(words, k, w)
                whole = grams(words.hash, size)
                begin = at[:, None] - np.arange(w)[None, :]
                ok = (begin >= starts[at][:, None]) & (begin + size <= ends[np.maximum(begin, 0)])
                row, begin = np.nonzero(ok)[0], begin[ok]
                d = doc[begin]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k").take(pa.array(d)), batch.column("h").take(pa.array(d)), pa.array(np.full(len(d), size), pa.int32()), pa.array(g[row].view(np.int64)), pa.array((begin - starts[begin]).astype(np.int64)), pa.array(whole[begin].view(np.int64))],
                    names=["k", "h", "size", "gram", "begin", "window"],
                )


@frugal
def _count_batches(it):
    for batch in it:
        parts = [np.diff(Words(data, off, IS_WORD, VALUES).rows) for _, _, data, off in text_slices(batch, "t")]
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("h"), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.int64())], names=["k", "h", "n_words"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS, keep_columns: bool = False) -> DataFrame:
    """A row for each document: its id (or, with keep_columns, all its columns), n_words, n_hit, items array<string>.

    With keep_columns the three get underscores before their names where the documents have such columns.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, item_id, item_text)
    n = windows.limit(broadcast_windows + 1).count()
    if n <= broadcast_windows:
        index = spark.sparkContext.broadcast(_Index(windows.collect()))
        names = docs.columns if keep_columns else [doc_id]
        out = [fresh(names, c) for c in ("n_words", "n_hit", "items")]
        inner = [f"c{i}" for i in range(len(names))]
        src = docs.select(*[docs[c].alias(i) for c, i in zip(names, inner, strict=True)], docs[text].cast("string").alias("t"))
        schema = T.StructType([*src.schema.fields[: len(names)], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])
        got = src.mapInArrow(lambda it, keep=len(names): _scan_batches(it, "t", index, keep), schema)
        return got.toDF(*names, *out)
    base = docs.select(docs[doc_id].alias("k"), docs[text].cast("string").alias("t")).withColumn("h", text_key(F.col("t")))
    windows = table(windows, "windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most 10 lengths
    kind = docs.schema[doc_id].dataType.simpleString()
    fps = base.mapInArrow(lambda it: _fp_batches(it, "t", sizes), f"k {kind}, h long, size int, gram long, begin long, window long")
    tests = windows.select("size", F.explode("grams").alias("gram")).distinct()
    hits = fps.join(tests, ["size", "gram"], "left_semi").select("k", "h", "size", "begin", "window").distinct()
    spans = hits.join(windows.select("size", "window").distinct(), ["size", "window"], "left_semi")
    cover = spans.groupBy("k", "h").agg(F.array_sort(F.collect_set(F.struct("begin", (F.col("begin") + F.col("size")).alias("end")))).alias("s"))
    merged = F.aggregate("s", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["to"], x["begin"]))).alias("n"), F.greatest(a["to"], x["end"]).alias("to")))
    n_hit = cover.select("k", "h", merged["n"].alias("n_hit"))
    named = windows.where("item is not null").select("size", "window", "item").distinct()
    items = spans.join(named, ["size", "window"]).select("k", "h", "item").distinct().groupBy("k", "h").agg(F.array_sort(F.collect_list("item")).alias("items"))
    n_words = base.mapInArrow(_count_batches, f"k {kind}, h long, n_words long")
    same = lambda a, b: a["k"].eqNullSafe(b["k"]) & (a["h"] == b["h"])
    got = n_words.join(n_hit, same(n_words, n_hit), "left").select(n_words["k"], n_words["h"], "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"))
    got = got.join(items, same(got, items), "left").select(got["k"], got["h"], "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    if not keep_columns:
        return got.select(F.col("k").alias(doc_id), "n_words", "n_hit", "items")
    names = docs.columns
    out = [fresh(names, c) for c in ("n_words", "n_hit", "items")]
    left = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], docs[doc_id].alias("k0"), text_key(docs[text].cast("string")).alias("h0"))
    one = got.dropDuplicates(["k", "h"])
    return left.join(one, left["k0"].eqNullSafe(one["k"]) & (left["h0"] == one["h"])).select(*[f"c{i}" for i in range(len(names))], "n_words", "n_hit", "items").toDF(*names, *out)

