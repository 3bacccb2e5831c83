"""Vectors as ``array<float>``; sums are taken in double."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def norm(vector: Column) -> Column:
    squares = F.aggregate(
        vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def unit(vector: Column) -> Column:
    """The vector at length one in double; a zero vector stays as it is."""
    length = norm(vector)
    scale = F.when(length == 0, F.lit(1.0)).otherwise(length)
    return F.transform(vector, lambda x: x.cast("double") / scale)


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def all_finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


@F.pandas_udf(T.StringType())
def encode_vector(vector: pd.Series) -> pd.Series:
    """Little-endian float32 as base64, the way recordings store a vector."""
    return vector.map(
        lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode()
    )


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else np.frombuffer(base64.b64decode(t), "<f4"))
