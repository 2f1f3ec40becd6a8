"""Vector and set similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 where a norm is 0. Norms that are known already are not computed again."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def keyword_similarity(a: Column, b: Column) -> Column:
    """Jaccard, raised by 30 % (to 1 at most) where more than 60 % of the smaller set is shared."""
    both, base = F.size(F.array_intersect(a, b)), jaccard(a, b)
    share = both / F.least(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).when(share > 0.6, F.least(F.lit(1.0), base * 1.3)).otherwise(base)


def alike(a: Column, b: Column, tokens_a: Column, tokens_b: Column, threshold: float = 0.55, short: int = 30) -> Column:
    """Short texts are alike if one contains the other, longer ones by Jaccard."""
    return F.when((F.length(a) < short) | (F.length(b) < short), a.contains(b) | b.contains(a)).otherwise(jaccard(tokens_a, tokens_b) >= threshold)
