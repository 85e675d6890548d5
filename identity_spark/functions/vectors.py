"""Vectors are ARRAY<FLOAT> or ARRAY<DOUBLE>; all sums are made in double."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """v over its length, which counts as EPSILON at least."""
    # the length is one column of a one-element array, so that it isn't computed for each component
    return F.flatten(F.transform(F.array(F.greatest(norm(v), F.lit(EPSILON))), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(EPSILON))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def mean_vector(v: Column) -> Column:
    """Mean of vectors of one length, as an aggregate with partial sums; normalise it with :func:`l2_normalize`."""
    return vector_to_array(Summarizer.mean(array_to_vector(as_double(v))))


def vector_sum(v: Column) -> Column:
    """Sum of vectors of one length, as an aggregate with partial sums."""
    return vector_to_array(Summarizer.sum(array_to_vector(as_double(v))))
