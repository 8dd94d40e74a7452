"""Small inputs with every odd case, shared by the tests of this folder."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, texts, sources=None):
    """Documents of the texts, ids 0.., languages and sources by turns."""
    rows = [(i, t, "en" if i % 2 else None, (sources[i] if sources else f"s{i % 3}"), len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(n, seed, size=200):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def clash(df):
    """The same with columns named as operators name theirs."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in ("k", "h", "t", "score", "n_hit", "items", "n_words", "size", "spans", "c0", "c1", "begin")])
