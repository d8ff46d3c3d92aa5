"""Vector columns: cosine similarity and distance."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, not clamped; 0 where a vector is null, empty or zero, or lengths differ."""
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(ok, F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))).otherwise(F.lit(0.0))


def _sum(terms: list[Column]) -> Column:
    """The terms' sum as a balanced tree: a chain of as many terms as a vector has numbers is too deep for the planner's stack."""
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) // 2 * 2 :]
    return terms[0]


def cosine_to(a: Column, query: list[float]) -> Column:
    """cosine() to one query: a sum of products with literals, which stays in generated code."""
    length = math.sqrt(sum(x * x for x in query))
    if not length:
        return F.lit(0.0)
    at = [F.get(a, i).cast("double") for i in range(len(query))]
    both, own = _sum([x * F.lit(float(q)) for x, q in zip(at, query, strict=True)]), _sum([x * x for x in at])
    return F.when(a.isNotNull() & (F.size(a) == len(query)), F.coalesce(F.try_divide(both, F.sqrt(own) * F.lit(length)), F.lit(0.0))).otherwise(F.lit(0.0))


def similarity(raw: Column) -> Column:
    """Clamped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
