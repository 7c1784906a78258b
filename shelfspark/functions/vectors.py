"""Arithmetic on arrays of numbers; elements become doubles first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, falsy_null


def doubles(v) -> Column:
    return col(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v, floor: float = 1e-8) -> Column:
    n = F.greatest(norm(v), F.lit(floor))
    return F.transform(doubles(v), lambda x: x / n)


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def softmax(v) -> Column:
    v = doubles(v)
    raised = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda s, y: s + y))


def probabilities(v) -> Column:
    """As they are where they look like probabilities (0 to 1, sum near 1), else their softmax."""
    v = doubles(v)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    fine = F.forall(v, lambda x: (x >= 0) & (x <= 1)) & (F.abs(total - 1) < 0.05)
    return F.when(fine, v).otherwise(softmax(v))


def product_key(catalog_sku, product, brand, sku, model) -> Column:
    parts = [F.coalesce(col(c), F.lit("")) for c in (brand, sku, model)]
    return F.coalesce(falsy_null(catalog_sku), falsy_null(product), F.concat_ws(":", *parts))


def feedback_rank(conf, productness, area, sharpness) -> Column:
    return (
        col(conf) * 0.40 + col(productness) * 0.35 + F.least(F.lit(1.0), col(area) * 5) * 0.20 + F.least(F.lit(1.0), col(sharpness)) * 0.05
    )
