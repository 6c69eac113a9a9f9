"""Column -> Column vector helpers over ``array<double>`` (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS_CLASS

# --- fixed values: hash embedder defaults ---
HASH_DIM = 384
# --- end fixed values ---


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return F.transform(_col(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    """Sum of element products, accumulated left to right."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def sq_norm(a) -> Column:
    return F.aggregate(_col(a), F.lit(0.0), lambda acc, x: acc + x * x)


def l2_norm(a) -> Column:
    """Euclidean length."""
    return F.sqrt(sq_norm(a))


def sq_l2(a, b) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda acc, x: acc + x)


def sparse_dot(idx, val, dense) -> Column:
    """Dot product of a sparse vector (indices, values) with a dense array: O(nnz)."""
    return F.aggregate(F.zip_with(_col(idx), _col(val), lambda i, v: v * F.try_element_at(_col(dense), i + 1)),
                       F.lit(0.0), lambda acc, x: acc + x)


def distance_from_parts(dotp: Column, sq_a: Column, sq_b: Column, metric: str = "cosine") -> Column:
    """V3 cosine and inner product from the dot product and the two squared norms (L2: ``sq_l2``)."""
    metric = metric.lower()
    if metric == "cosine":
        den = F.sqrt(sq_a) * F.sqrt(sq_b)
        return F.lit(1.0) - F.when(den == 0, F.lit(0.0)).otherwise(dotp / den)
    if metric == "ip":
        return F.lit(1.0) - dotp
    raise ValueError(f"unknown metric {metric}")


def hash_tokens(text) -> Column:
    """V1 tokenizer: lower-case, split on (Unicode) whitespace, drop empties."""
    parts = F.split(F.lower(F.coalesce(_col(text), F.lit(""))), f"{WS_CLASS}+")
    return F.filter(parts, lambda t: t != "")


def hash_bucket(token, dim: int = HASH_DIM) -> Column:
    """V1 bucket: first 8 hex digits of md5(token) as an integer, modulo ``dim``."""
    return (F.conv(F.substring(F.md5(_col(token)), 1, 8), 16, 10).cast("bigint") % int(dim)).cast("int")
