"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are runs without ASCII white space. Features are hashed into 2**BITS
slots: word 1- and 2-grams (A-Z lower-cased) and 1- to 3-grams of word shapes
(first and last byte's class, share of upper case, length class, whether the
word repeats one of the two before it). A feature's value is its count over the
number of words, so a text's score is a bias and a mean of sparse dot products.

Training reads at most `train_rows` labelled rows, those of the smallest hash
of their id, leaves out every row whose crc32(id as text) mod 5 is 0, and runs
in one task over that bounded sample. Scoring is one pass over all texts.

Defined cases: null and empty texts score by the bias alone; a null id counts
as held out; a document with several labels takes the largest, one
of several texts the least; without any
label of the training rows all scores are 0.5; repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bytesfast import LOWER, U64, Words, byte_values, frugal, mix, text_slices
from millrace.llm.keys import fresh
from millrace.sources.work import small_batches

BITS = 18
TRAIN_ROWS = 6000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.2
SCALE = 8.0
THRESHOLD = 0.3
SLICE = 1 << 20

IS_WORD = np.ones(256, bool)
IS_WORD[9:14] = IS_WORD[32] = False
VALUES = byte_values(83)[LOWER]

CLASS = np.zeros(256, np.uint64)  # letters and digits by kind, every other byte for itself
CLASS[:128] = np.arange(128) + 8
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 1, 2, 3, 1
UPPER = np.zeros(256, np.int64)
UPPER[65:91] = 1


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, valid, rows): slots and valid are (kinds, words); rows are the word offsets of the texts."""
    w = Words(data, off, IS_WORD, VALUES)
    n, h = len(w.hash), w.hash
    if not n:
        return np.zeros((5, 0), np.int64), np.zeros((5, 0), bool), w.rows
    size = (w.ends - w.starts).astype(U64)
    up = np.concatenate([[0], np.cumsum(UPPER[data])])
    upper = (up[w.ends] - up[w.starts]).astype(U64)
    begin = np.repeat(w.rows[:-1], np.diff(w.rows))
    at = np.arange(n)
    again = np.zeros(n, bool)
    for d in (1, 2):
        again[d:] |= (h[d:] == h[:-d]) & (at[d:] - d >= begin[d:])
    shape = CLASS[data[w.starts]] | (CLASS[data[w.ends - 1]] << U64(8)) | (np.minimum(upper * U64(2) // size, U64(2)) << U64(16)) | (np.minimum(size // U64(4), U64(4)) << U64(20)) | (again.astype(U64) << U64(24))
    shape = mix(shape + U64(1 << 40))

    def chain(x, k):
        g = x.copy()
        ok = at + k <= np.repeat(w.rows[1:], np.diff(w.rows))
        for j in range(1, k):
            g[: n - j] = g[: n - j] * U64(0x9FB21C651E98DF25) + x[j:]
        return mix(g + U64(k)), ok

    got = [chain(h, 1), chain(h, 2), chain(shape, 1), chain(shape, 2), chain(shape, 3)]
    mask = U64((1 << BITS) - 1)
    slots = np.stack([((mix(g + U64(100 + i))) & mask).astype(np.int64) for i, (g, _) in enumerate(got)])
    return slots, np.stack([ok for _, ok in got]), w.rows


@frugal
def _rows(it):
    for batch in it:
        idx, val = [], []
        for a, b, data, off in text_slices(batch, "t", SLICE):
            slots, valid, rows = features(data, off)
            for r in range(b - a):
                lo, hi = rows[r], rows[r + 1]
                u, c = np.unique(slots[:, lo:hi][valid[:, lo:hi]], return_counts=True)
                idx.append(u.astype(np.int32))
                val.append((c * (SCALE / max(1, hi - lo))).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("y"), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], names=["o", "y", "idx", "val"])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the bias last."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = np.array([1 << BITS])

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for e in range(epochs):
        order = np.random.default_rng(e).permutation(len(rows))
        for r in order:
            idx, val, y = rows[r]
            i = np.concatenate([idx, bias])
            x = np.concatenate([val, [1.0]])
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            g2 = g * g
            z[i] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + g2
    return weights(z, n)


@frugal
def _train(it):
    rows = []
    for batch in it:
        for o, y, i, v in zip(batch.column("o").to_pylist(), batch.column("y").to_pylist(), batch.column("idx"), batch.column("val"), strict=True):
            rows.append((o, i.values.to_numpy(zero_copy_only=False), v.values.to_numpy(zero_copy_only=False).astype(np.float64), float(y)))
    rows.sort(key=lambda r: r[0])
    w = ftrl([r[1:] for r in rows])
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], names=["slot", "weight"])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights fitted on at most train_rows labelled rows that are not held out."""
    small_batches(docs.sparkSession)
    own = labels.select(labels[doc_id].alias("k"), labels[label].cast("int").alias("y")).where("k is not null and y in (0, 1)").where(~held_out(F.col("k")))
    some = own.groupBy("k").agg(F.max("y").alias("y")).withColumn("o", F.xxhash64(F.col("k").cast("string"))).orderBy("o", "k").limit(train_rows)
    src = docs.select(docs[doc_id].alias("d"), docs[text].cast("string").alias("t"))
    rows = src.join(F.broadcast(some), F.col("d") == F.col("k"))  # at most train_rows ids and labels
    rows = rows.groupBy("o", "y").agg(F.min("t").alias("t"))  # one text for an id, however often it stands
    feats = rows.mapInArrow(_rows, "o long, y int, idx array<int>, val array<float>")
    got = feats.repartition(1).mapInArrow(_train, "slot int, weight double").collect()
    w = np.zeros((1 << BITS) + 1)
    for r in got:
        w[r["slot"]] = r["weight"]
    return w


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column, the score; and that column's name."""
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2**BITS + 1 numbers
    names = docs.columns
    out = fresh(names, "score")
    src = docs.select(*[docs[c].cast("string").alias(f"c{i}") if c == text else docs[c].alias(f"c{i}") for i, c in enumerate(names)])
    column = f"c{names.index(text)}"

    @frugal
    def run(it):
        w = held.value
        for batch in it:
            parts = []
            for _, _, data, off in text_slices(batch, column, SLICE):
                slots, valid, rows = features(data, off)
                per = np.zeros(slots.shape[1])
                for s, ok in zip(slots, valid, strict=True):
                    per += np.where(ok, w[s], 0.0)
                total = np.concatenate([[0.0], np.cumsum(per)])
                n = np.diff(rows)
                z = float(w[-1]) + (total[rows[1:]] - total[rows[:-1]]) * SCALE / np.maximum(n, 1)
                parts.append(1 / (1 + np.exp(-np.clip(z, -35, 35))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=[*batch.schema.names, "score"])

    got = src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField("score", T.DoubleType())]))
    return got.toDF(*names, out), out


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """A row for each document: its id, held_out, score, predicted."""
    got, s = score(docs.select(doc_id, text), train(docs, labels, doc_id, text, train_rows=train_rows), text)
    return got.select(doc_id, held_out(F.col(doc_id)).alias("held_out"), F.col(s).alias("score"), (F.col(s) >= threshold).cast("int").alias("predicted"))
