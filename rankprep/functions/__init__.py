"""Column functions: vectors, softmax, deterministic draws."""

from .draws import uniform
from .vectors import cosine, inner_product, l2_normalize, log_sum_exp, neg_euclidean, norm, softmax

__all__ = ["cosine", "inner_product", "l2_normalize", "log_sum_exp", "neg_euclidean", "norm", "softmax", "uniform"]
