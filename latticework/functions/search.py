"""Search functions: analyzer, token predicates, BM25, vector distance, mock embeddings."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
K1, B = 1.2, 0.75


def analyze(text: str) -> list[str]:
    """Tokens of a query: lower case, no stop words, plural s cut."""
    return [_stem(t) for t in re.split(r"[^\w]+|_+", text.lower()) if t and t not in STOP]


def _stem(t: str) -> str:
    return t[:-1] if len(t) > 3 and t.endswith("s") and not t.endswith("ss") else t


def tokens(text: Column) -> Column:
    """Tokens of a column, as analyze() makes them."""
    parts = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & ~t.isin(*sorted(STOP)))
    return F.transform(parts, lambda t: F.when((F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))


def has_token(text: Column, query: str) -> Column:
    found = analyze(query)
    return F.coalesce(F.arrays_overlap(tokens(text), F.array(*map(F.lit, found))), F.lit(False)) if found else F.lit(False)


def fuzzy_token(text: Column, query: str, edits: int = 2) -> Column:
    tests = [lambda t, q=q: F.levenshtein(t, F.lit(q), edits) >= 0 for q in analyze(query)]
    return F.coalesce(F.exists(tokens(text), lambda t: F.greatest(*[x(t) for x in tests], F.lit(False))), F.lit(False)) if tests else F.lit(False)


def distance(vector: Column, query: list[float]) -> Column:
    """Squared Euclidean distance to a constant vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)


def _equals(w: str):
    return lambda x: x == w  # one parameter: a second one would be the index


def _once(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def bm25_statistics(text: Column, query: str) -> list[Column]:
    """Aggregates of the corpus: documents, mean length, and documents with each query token."""
    words = list(dict.fromkeys(analyze(query)))
    found = _once(tokens(text), lambda t: F.array(F.size(t), *[F.array_contains(t, w).cast("int") for w in words]))
    seen = F.when(text.isNotNull(), found)  # one array a document, so that the aggregates share it
    return [F.count(text).alias("bm_n"), F.avg(F.get(seen, 0)).alias("bm_len"), *[F.sum(F.get(seen, i + 1).cast("long")).alias(f"bm_{i}") for i in range(len(words))]]


def may_match(text: Column, query: str) -> Column:
    """A cheap condition without which no token of the query is in the text."""
    low = F.lower(text)
    out = F.lit(False)
    for w in dict.fromkeys(analyze(query)):
        out = out | F.contains(low, F.lit(w))
    return F.coalesce(out, F.lit(False))


def bm25_score(text: Column, query: str) -> Column:
    """Score of a text beside the columns of bm25_statistics(); 0 where no token matches."""

    def of(t: Column) -> Column:
        score = F.lit(0.0)
        for i, w in enumerate(dict.fromkeys(analyze(query))):
            tf = F.size(F.filter(t, _equals(w))).cast("double")
            idf = F.log(1 + (F.col("bm_n") - F.col(f"bm_{i}") + 0.5) / (F.col(f"bm_{i}") + 0.5))
            score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size(t) / F.col("bm_len")))
        return score

    return F.coalesce(_once(tokens(text), of), F.lit(0.0))


def mock_embedding(text: str, dim: int) -> list[float]:
    """A deterministic unit vector: FNV-1a seeds a xorshift generator."""
    mask, h = (1 << 64) - 1, 0xCBF29CE484222325
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) & mask
    h, out = h or 1, []
    for _ in range(dim):
        h ^= h << 13 & mask
        h ^= h >> 7
        h ^= h << 17 & mask
        out.append(2 * h / mask - 1)
    norm = math.sqrt(sum(x * x for x in out))
    if not math.isfinite(norm) or norm == 0:
        raise ValueError("an embedding must be finite and not zero")
    return [x / norm for x in out]
