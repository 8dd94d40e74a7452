"""Text, hash and similarity functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FNV32_START, FNV32_PRIME = 2166136261, 16777619  # fixed values of FNV-1a, 32 bits


def words(c: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(c, "[ \\t\\n\\r\\f]+"), lambda x: x != "")


def all_tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores, of two or more characters."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9_]+", " "), " "), lambda x: F.length(x) >= 2)


def tokens(c: Column) -> Column:
    """Distinct tokens, first occurrence first."""
    return F.array_distinct(all_tokens(c))


def estimate_tokens(c: Column) -> Column:
    n = F.size(words(c))
    return F.when(n == 0, F.lit(1)).otherwise(F.floor(n * F.lit(1.3) + F.lit(0.999))).cast("long")


def overlap(a: Column, b: Column) -> Column:
    """Share of the distinct tokens of a that b has; arrays of distinct tokens."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def fnv1a(c: Column) -> Column:
    """FNV-1a of an ASCII string, as a long of 32 bits."""
    chars = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))
    return F.when(c == "", F.lit(FNV32_START)).otherwise(F.aggregate(chars, F.lit(FNV32_START).cast("long"), lambda h, x: (h.bitwiseXOR(x) * FNV32_PRIME).bitwiseAND(F.lit(0xFFFFFFFF))))


def trigrams(c: Column) -> Column:
    """Distinct runs of three characters of the trimmed, lower-cased text."""
    s = F.lower(F.trim(c))
    return F.when(F.length(s) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3)))))


def content_id(*parts: Column) -> Column:
    """The first 20 hex digits of the SHA-256 of the parts, joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20)


def binary_entropy(p: Column) -> Column:
    p = F.greatest(F.lit(0.001), F.least(F.lit(0.999), p))
    return -p * F.log2(p) - (1 - p) * F.log2(1 - p)


def cosine(a: Column, b: Column) -> Column:
    """Of arrays of one length, 0 where a norm is 0, clamped to [-1, 1]."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot / d)))


#: Words of a query by what they are, and endings of files.
STOP_WORDS = "a an the in on at by for to of from with is are was were be been being that this those these it its their and or as into if out up".split()
ACTIONS = "attach attaches exclude excludes excluding hydrate hydrates filter filters trace tracing debug verify verifies check inspect build compile route block blocks deny denies prevent prevents".split()
GENERIC = "find where show tell what does how logic code file files project projects thing things why which when who look explain about implement implementation details example give want need work system operations pattern related handled handles".split()
FILE_ENDINGS = "go py ts tsx js json md yaml yml proto sh sql rs c cpp h".split()
#: Classes in the order in which a search prefers them, from 1.
TOKEN_CLASSES = ("PATH/FILENAME", "SYMBOL", "ENTITY", "IDENTIFIER", "TECHNICAL_TERM", "ACTION", "GENERIC", "STOPWORD")


def _is_symbol(runs: Column) -> Column:
    """Is one of these runs of letters, digits and underscores in mixed case, or a name with a digit?"""
    plain = lambda r: ~r.contains("_")
    first = lambda r: F.substring(r, 1, 1)
    starts_low = lambda r: first(r).between("a", "z")
    starts_high = lambda r: first(r).between("A", "Z")
    capitals = lambda r: F.length(r) - F.length(F.regexp_replace(r, "[A-Z]", ""))
    camel = lambda r: plain(r) & starts_low(r) & (capitals(r) > 0)
    pascal = lambda r: plain(r) & starts_high(r) & (capitals(r) > 1) & ~r.rlike("[A-Z]([A-Z]|$)")
    numbered = lambda r: (starts_low(r) | starts_high(r) | r.startswith("_")) & r.rlike("[0-9]")
    return F.exists(runs, lambda r: camel(r) | pascal(r) | numbered(r))


def token_class(token: Column) -> Column:
    """One of TOKEN_CLASSES for a token of a query."""
    low = F.lower(token)
    ending = F.regexp_extract(low, r"[a-z0-9_.-]\.([a-z]+)$", 1)
    dotted = F.size(F.filter(F.split(token, "-"), lambda c: c.rlike(r"(^|[^A-Za-z0-9_])[A-Za-z_]\w*\.[A-Za-z_]"))) > 0
    high = F.substring(token, 1, 1).between("A", "Z") & (F.length(token) >= 2)
    acronym = F.exists(F.split(token, "[^A-Za-z0-9_]+"), lambda r: r.rlike("^[A-Z]{2,6}$")) & ~token.isin("AND", "THE", "FOR", "NOT")
    return (
        F.when(low.isin(STOP_WORDS), "STOPWORD")
        .when(token.contains("/") | ending.isin(FILE_ENDINGS), "PATH/FILENAME")
        .when(dotted | _is_symbol(F.split(token, "[^A-Za-z0-9_]+")), "SYMBOL")
        .when(high & ~low.isin(GENERIC) & ~low.isin(ACTIONS), "SYMBOL")
        .when(acronym, "ENTITY")
        .when(token.contains("_") | token.contains("-"), "IDENTIFIER")
        .when(low.isin(ACTIONS), "ACTION")
        .when(low.isin(GENERIC), "GENERIC")
        .otherwise("TECHNICAL_TERM")
    )


def token_priority(cls: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in TOKEN_CLASSES]), cls)


def trigram_score(text: Column, query: Column) -> Column:
    """Struct of score and matched: 0.60 coverage, 0.25 proximity and 0.15 for a text that holds some of the query's trigrams."""
    low = F.lower(F.trim(text))
    at = F.filter(F.transform(query, lambda g: F.call_function("instr", low, g)), lambda p: p > 0)
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(at) - 1)), lambda i: F.try_element_at(at, i + 1) - F.try_element_at(at, i))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + F.when(g.between(1, 5), 1 / g).otherwise(0.0))
    score = 0.6 * F.size(at) / F.size(query) + F.when(F.size(at) > 1, 0.25 * near / (F.size(at) - 1)).otherwise(0.0) + 0.15
    return F.struct(F.size(at).cast("long").alias("matched"), F.round(score, 6).alias("score"))


def varint(n: Column) -> Column:
    """A number from 0 as hexadecimal bytes of seven bits each, the lowest first, the high bit set on all but the last."""
    n = n.cast("long")
    size = F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("int")
    byte = lambda i: F.call_function("shiftright", n, 7 * i).bitwiseAND(F.lit(127)) + F.when(i < size - 1, 128).otherwise(0)
    return F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), "")


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(counts, F.lit(0.0), lambda s, x: s - F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0))
