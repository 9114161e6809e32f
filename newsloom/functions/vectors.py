"""Vector arithmetic on array columns, in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(_doubles(vector), F.lit(0.0), lambda total, x: total + x * x)
    )


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine; null for a zero vector, a missing one or unequal widths."""
    return 1.0 - F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(vector: Column) -> Column:
    """The vector scaled to length one; elements are null for a zero vector."""
    # Inside a lambda over the elements the norm would be computed once per element.
    lengths = F.array_repeat(norm(vector), F.size(vector))
    return F.zip_with(_doubles(vector), lengths, lambda x, length: F.try_divide(x, length))
