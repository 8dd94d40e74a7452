"""Vector code compression: product codes from codebooks kept by delta-maintained Lloyd rounds.

Each component becomes a whole number, a vector is cut into equal parts, and every
part position has a codebook that starts with that part of the vectors of the
smallest ids. The table in the shared folder holds, beside each vector, the codes
that the last round gave it; the running sums and counts of all entries are whole
numbers too. A round reads the table, assigns every part to its nearest entry and
writes the table anew (no shuffle: a code stays with its vector). Only parts whose
code changed add to what is shuffled: plus to the entry they go to, minus to the
one they leave, summed within each task first, so a round sends at most two rows
for each entry and task however many vectors there are. What reaches the driver is
as large as the codebooks.

Distances are exact: in doubles while every term is a whole number below 2**53,
else in 64-bit integers, else in Python's.

Defined cases: null vectors and those with null or non-finite components are
dropped; repeated rows are vectors of their own; null ids come after all others,
and equal ids are ordered by their components; a vector shorter than the longest
one, or of a length that the parts do not divide, ends in zeros; components beyond
32 bits and errors beyond 64 bits are held at those bounds; fewer vectors than
entries make a shorter codebook; an empty table gives no row. Other columns do
not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytesfast import frugal
from millrace.llm.keys import table
from millrace.sources.work import spread

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
ROWS = 2048
LEAST, MOST, LONG = -(1 << 31), (1 << 31) - 1, (1 << 63) - 1


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the index of its nearest row of the book (ties: the lower) and their squared distance, exactly."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    span = x.shape[1] * (2 * most) ** 2
    if span < 1 << 53:
        f, b = x.astype(np.float64), book.astype(np.float64)
        d = (f * f).sum(1)[:, None] + ((b * b).sum(1) - 2 * (f @ b.T))
        at = d.argmin(1)
        return at, d[np.arange(len(x)), at].astype(np.int64)
    kind = np.int64 if span < 1 << 63 else object
    x, best, at = x.astype(kind), None, np.zeros(len(x), np.int64)
    for i, entry in enumerate(book.astype(kind)):
        d = ((x - entry) ** 2).sum(1)
        if best is None:
            best = d
        else:
            at[d < best] = i
            best = np.minimum(best, d)
    return at, best


def _slices(it, width: int, parts: int):
    """(batch, parts of its vectors as rows x parts x width), a few thousand rows at a time."""
    for whole in it:
        for batch in (whole.slice(z, ROWS) for z in range(0, whole.num_rows, ROWS)):
            v = batch.column("v")
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            x = np.zeros((batch.num_rows, parts * width), np.int64)
            x[np.arange(parts * width) < sizes[:, None]] = v.flatten().to_numpy()
            yield batch, x.reshape(-1, parts, width)


@frugal
def _round_batches(it, held, width: int):
    books = held.value
    parts, entries = len(books), len(books[0])
    sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
    touched = np.zeros((parts, entries), bool)
    for batch, x in _slices(it, width, parts):
        before = np.array([list(c) if c is not None else [-1] * parts for c in batch.column("code").to_pylist()], np.int64).reshape(-1, parts)
        now = np.stack([nearest(x[:, p], books[p])[0] for p in range(parts)], 1)
        for p in range(parts):
            moved = now[:, p] != before[:, p]
            left = moved & (before[:, p] >= 0)
            for rows, to, sign in ((moved, now, 1), (left, before, -1)):
                cell = to[rows, p][:, None] * width + np.arange(width)
                # a slice of 2,048 sums of 32 bits is exact in doubles
                sums[p] += sign * np.bincount(cell.ravel(), x[rows, p].ravel(), entries * width).astype(np.int64).reshape(entries, width)
                counts[p] += sign * np.bincount(to[rows, p], minlength=entries)
                touched[p, to[rows, p]] = True
        n = batch.num_rows
        codes = pa.array([r.tobytes() for r in now.astype(np.uint8)], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), batch.column("v"), codes, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())],
            names=["id", "label", "v", "code", "part", "entry", "sums", "n"],
        )
        kinds = batch.schema
    p, e = np.nonzero(touched)
    if len(p):
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(len(p), kinds.field(c).type) for c in ("id", "label", "v")), pa.nulls(len(p), pa.binary()), pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(sums[p, e].tolist(), pa.list_(pa.int64())), pa.array(counts[p, e], pa.int64())],
            names=["id", "label", "v", "code", "part", "entry", "sums", "n"],
        )


@frugal
def _code_batches(it, held, width: int):
    books = held.value
    for batch, x in _slices(it, width, len(books)):
        got = [nearest(x[:, p], books[p]) for p in range(len(books))]
        codes = np.stack([g[0] for g in got], 1).astype(np.uint8)
        errors = [min(LONG, sum(map(int, e))) for e in zip(*(g[1] for g in got), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])


def whole_numbers(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """id, label and v (components as whole numbers) of the vectors that take part."""
    x = vectors[embedding].cast("array<double>")
    src = vectors.select(vectors[vec_id].alias("id"), vectors[label].alias("label"), x.alias("x"))
    fine = F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("x", lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(float(LEAST))), F.lit(float(MOST)))).cast("int"))
    return src.where(F.coalesce(fine, F.lit(False))).select("id", "label", whole.alias("v"))


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(a row for each kept vector: id, label, code (a byte for each part) and error; the codebooks, one a part)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: entries must be 1 to 256")
    spark = vectors.sparkSession
    kept = table(whole_numbers(spread(vectors), vec_id, embedding, label), "whole")
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)
    first = kept.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    start = np.zeros((len(first), parts * width), np.int64)
    for i, r in enumerate(first):
        start[i, : len(r["v"])] = r["v"]
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    sums = np.zeros((parts, len(first), width), object)
    counts = np.zeros((parts, len(first)), object)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    state = kept.select("*", F.lit(None).cast("binary").alias("code"))
    for _ in range(rounds if first else 0):
        held = spark.sparkContext.broadcast(books)
        schema = f"id {kinds['id']}, label {kinds['label']}, v array<int>, code binary, part int, entry int, sums array<bigint>, n bigint"
        got = table(state.mapInArrow(lambda it, h=held: _round_batches(it, h, width), schema), "coded")
        state = got.where("part is null").select("id", "label", "v", "code")
        moved = got.where("part is not null").select("part", "entry", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "x"))
        for r in moved.groupBy("part", "entry", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # as many as the codebooks hold
            if r["at"]:
                sums[r["part"], r["entry"], r["at"] - 1] += int(r["x"])
            else:
                counts[r["part"], r["entry"]] += int(r["x"])
        for p in range(parts):
            used = counts[p] > 0
            books[p] = books[p].copy()
            if used.any() and width:
                books[p][used] = (sums[p][used] // counts[p][used][:, None]).astype(np.int64)
    if not first:
        return kept.select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(0).cast("long").alias("error")), books
    held = spark.sparkContext.broadcast(books)
    coded = state.mapInArrow(lambda it: _code_batches(it, held, width), f"id {kinds['id']}, label {kinds['label']}, code binary, error bigint")
    return table(coded, "codes"), books


def decode(code: bytes, books: list[np.ndarray]) -> np.ndarray:
    """The vector that a code stands for, as whole numbers."""
    return np.concatenate([book[c] for c, book in zip(code, books, strict=True)])


def books_hash(books: list[np.ndarray]) -> str:
    """SHA-256 of all components, comma-joined by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error: the errors of equal labels in all (nulls are equal)."""
    total = codes.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return codes.join(total, codes["label"].eqNullSafe(total["of"])).drop("of")
