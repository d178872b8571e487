"""Functions of array<double> columns (other numeric arrays are cast)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _vec(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def inner_product(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_vec(a), _vec(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(inner_product(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where a norm is 0."""
    return F.try_divide(inner_product(a, b), norm(a) * norm(b))


def neg_euclidean(a: Column | str, b: Column | str, sqrt: bool = False) -> Column:
    """Minus the squared distance, or minus the distance."""
    d = inner_product(a, a) + inner_product(b, b) - 2.0 * inner_product(a, b)
    d = F.greatest(d, F.lit(0.0))
    return -F.sqrt(d) if sqrt else -d


def l2_normalize(v: Column | str) -> Column:
    """Null where the norm is 0."""
    n = norm(v)
    return F.when(n > 0, F.transform(_vec(v), lambda x: x / n))


def log_sum_exp(values: Column | str) -> Column:
    """Of an array, shifted by its largest element; null for an empty one."""
    v = _vec(values)
    top = F.array_max(v)
    return F.when(F.size(v) > 0, top + F.log(_total(F.transform(v, lambda x: F.exp(x - top)))))


def softmax(values: Column | str) -> Column:
    v = _vec(values)
    whole = log_sum_exp(v)
    return F.transform(v, lambda x: F.exp(x - whole))


SCORERS = {"inner": inner_product, "cosine": cosine, "euclidean": neg_euclidean}
