"""URL filters: gradient-boosted trees on lexical features, behind host and path rules.

A rule names a host (all its subdomains too) and the start of a path; the
longest rule that fits decides. The rest is judged by trees trained on labelled
URLs: the query takes the URLs that a rule decides as the labelled ones
(`labelled_by_rules`), so what the rules say of .org and .com is carried to hosts
that they do not name; any table of labelled URLs can be passed instead.

The features are built-in Columns: lengths, depth, digit ratios, entropy,
hyphens, labels, parameter counts, and the smoothed block rates of the host's
suffixes and of the path's first segment. The trees see no words. Only they run
in Python, over Arrow batches of features.

Training reads at most `train_rows` URLs, those of the smallest hash; every
URL is scored.

Defined cases: null, empty and scheme-less URLs have an empty host and path, fit
no rule and are judged like others (all features of an empty URL are 0);
repeated rows are judged alike; without labelled rows of both kinds the method
allows all.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the contract: verdict, host, start of the path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
TRAIN_ROWS = 20000
TREES, DEPTH, BINS, RATE, LEAF, L2 = 60, 3, 32, 0.3, 5, 1.0


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text or null, its verdict or null)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def labelled_by_rules(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """url, y (1: block) of the URLs that a rule decides."""
    u = pages[url].cast("string")
    _, verdict = rule_for(host_of(u), path_of(u), rules)
    return pages.select(u.alias("url"), (verdict == "block").cast("int").alias("y")).where("y is not null")


def _count(text: Column, what: str) -> Column:
    """Matches of a pattern of one character."""
    return F.length(text) - F.length(F.regexp_replace(text, what, ""))


def lexical(url: Column) -> dict[str, Column]:
    """Numeric features of a URL; all 0 of one that is null or empty."""
    u = F.coalesce(url, F.lit(""))
    host, path = host_of(u), path_of(u)
    query = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    labels, chars = F.split(host, r"\."), F.split(host, "")
    n = F.greatest(F.lit(1), F.length(host)).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    some = F.length(host) > 0
    out = {
        "n_url": F.length(u), "n_host": F.length(host), "n_path": F.length(path), "depth": _count(path, "[/]"),
        "digits": _count(u, "[0-9]") / F.greatest(F.lit(1), F.length(u)), "host_digits": _count(host, "[0-9]") / n,
        "entropy": F.when(some, entropy).otherwise(0.0), "hyphens": _count(host, "[-]"), "labels": F.when(some, F.size(labels)).otherwise(0),
        "longest": F.array_max(F.transform(labels, F.length)), "parameters": _count(query, "[=]"), "n_query": F.length(query),
        "fragment": u.contains("#"), "secure": F.lower(F.substring(u, 1, 5)) == "https", "vowels": _count(host, "[aeiou]") / n,
    }
    return {k: c.cast("double") for k, c in out.items()}


def groups(url: Column) -> dict[str, Column]:
    """What block rates are kept of: the host's last label and last three labels, the path's first segment."""
    host = host_of(url)
    return {"last": F.substring_index(host, ".", -1), "suffix": F.substring_index(host, ".", -3), "head": F.regexp_extract(path_of(url), "(?s)^/([^/]*)/", 1)}


LEXICAL = ("n_url", "n_host", "n_path", "depth", "digits", "host_digits", "entropy", "hyphens", "labels", "longest", "parameters", "n_query", "fragment", "secure", "vowels")
GROUPS = ("last", "suffix", "head")


def _features(url: Column) -> list[Column]:
    return [c.alias(k) for k, c in {**lexical(url), **groups(url)}.items()]


class Trees:
    """Boosted regression trees for the logistic loss, over binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = self._bin(x)
        p = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.start, self.trees = math.log(p / (1 - p)), []
        z = np.full(len(y), self.start)
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-z))
            tree: dict = {}
            z += RATE * self._grow(binned, y - q, q * (1 - q), np.arange(len(y)), 0, 1, tree, np.zeros(len(y)))
            self.trees.append(tree)
        return self

    def _bin(self, x):
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], 1)

    def _grow(self, b, g, h, rows, depth, node, tree, out):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-9, None, None)
        if depth < DEPTH and len(rows) >= 2 * LEAF:
            for f in range(b.shape[1]):
                c = b[rows, f]
                cg, ch, cn = (np.cumsum(np.bincount(c, v, BINS + 1)) for v in (g[rows], h[rows], np.ones(len(rows))))
                gain = cg**2 / (ch + L2) + (gs - cg) ** 2 / (hs - ch + L2) - gs**2 / (hs + L2)
                gain[(cn < LEAF) | (cn > len(rows) - LEAF)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] is None:
            tree[node] = (None, 0, gs / (hs + L2))
            out[rows] = tree[node][2]
            return out
        _, f, k = best
        tree[node] = (f, k, 0.0)
        left = b[rows, f] <= k
        self._grow(b, g, h, rows[left], depth + 1, 2 * node, tree, out)
        return self._grow(b, g, h, rows[~left], depth + 1, 2 * node + 1, tree, out)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        z = np.full(len(x), self.start)
        for tree in self.trees:
            node = np.ones(len(x), np.int64)
            for n in sorted(tree):  # parents before children
                f, k, _ = tree[n]
                if f is not None:
                    here = node == n
                    node[here] = 2 * n + (b[here, f] > k)
            value = np.zeros(2 << (DEPTH + 1))
            for n, (f, _, v) in tree.items():
                if f is None:
                    value[n] = v
            z += RATE * value[node]
        return 1 / (1 + np.exp(-z))


class Model:
    """Group rates and trees, fitted on features of labelled URLs (1: unwanted)."""

    def __init__(self, x: pd.DataFrame, y: np.ndarray):
        self.base = float(y.mean()) if len(y) else 0.0
        self.rates: dict[str, dict[str, float]] = {g: {} for g in GROUPS}
        self.trees = None
        if not len(y) or y.min() == y.max():
            return
        half = np.array([zlib.crc32(u.encode()) & 1 for u in x["url"]], bool)  # rates come from one half, trees from the other
        for g in GROUPS:
            seen = pd.DataFrame({"g": x[g][half], "y": y[half]}).groupby("g")["y"].agg(["sum", "count"])
            self.rates[g] = ((seen["sum"] + 4 * self.base) / (seen["count"] + 4)).to_dict()
        rest = y[~half]
        if len(rest) and rest.min() < rest.max():
            self.trees = Trees().fit(self.matrix(x[~half]), rest.astype(np.float64))

    def matrix(self, x: pd.DataFrame) -> np.ndarray:
        rates = [x[g].map(self.rates[g]).fillna(self.base).to_numpy(np.float64) for g in GROUPS]
        return np.column_stack([x[list(LEXICAL)].to_numpy(np.float64), *rates])

    def predict(self, x: pd.DataFrame) -> np.ndarray:
        return np.zeros(len(x)) if self.trees is None else self.trees.predict(self.matrix(x))


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """labelled: url, y. A bounded sample: the URLs of the smallest hash."""
    rows = labelled.where("url is not null and y is not null").groupBy("url").agg(F.max("y").alias("y")).orderBy(F.xxhash64("url"), "url").limit(train_rows)
    got = rows.select("url", "y", *_features(F.col("url"))).toPandas().sort_values("url", ignore_index=True)  # at most train_rows rows
    return Model(got, got["y"].to_numpy(np.int64))


def judge(pages: DataFrame, labelled: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, train_rows: int = TRAIN_ROWS, cut: float = 0.5) -> DataFrame:
    """A row for each page: its id, host, path, rule, verdict, and score (0 to 1, the method's, rule or not). labelled: url, y (1: unwanted)."""
    u = pages[url].cast("string")
    held = pages.sparkSession.sparkContext.broadcast(train(labelled, train_rows))  # trees and suffix rates of at most train_rows URLs

    def scored(it):
        for batch in it:
            x = pa.Table.from_batches([batch]).select([*LEXICAL, *GROUPS]).to_pandas()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(held.value.predict(x), pa.float64())], names=[*kept, "score"])

    host, path = host_of(u), path_of(u)
    rule, verdict = rule_for(host, path, rules)
    rows = pages.select(pages[page_id].alias("id"), host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("own"), *_features(u))
    kept = ["id", "host", "path", "rule", "own"]
    got = rows.mapInArrow(scored, T.StructType([*(rows.schema[c] for c in kept), T.StructField("score", T.DoubleType())]))
    return got.select(F.col("id").alias(page_id), "host", "path", "rule", F.coalesce("own", F.when(F.col("score") >= cut, "block").otherwise("allow")).alias("verdict"), "score")
