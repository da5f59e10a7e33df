"""Vectors: normalising, means, and a deterministic stand-in for an embedding model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType

from threadloom.operators.index import exact_tokens


def unit(vector: Column) -> Column:
    """The vector over its length; null where the length is zero or not a number."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm > 0) & ~F.isnan(norm), F.transform(vector, lambda x: x.cast("double") / norm))


def mean_unit(segments: DataFrame, by: list[str], vector: str = "vector") -> DataFrame:
    """Component means of each group's vectors, then normalised: ``by..., pos, value`` (one row per component)."""
    parts = segments.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    norm = parts.groupBy(*by).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return parts.join(norm.where("norm > 0"), by).select(*by, "pos", (F.col("x") / F.col("norm")).alias("value"))


#: Dimensions of the stand-in vectors.
DIMENSIONS = 64


@F.pandas_udf(ArrayType(DoubleType()))
def _counted(positions: pd.Series) -> pd.Series:
    def one(row):
        counts = np.bincount(row, minlength=DIMENSIONS).astype(float)
        norm = np.sqrt((counts * counts).sum())
        return counts / norm if norm else None

    return positions.map(lambda row: None if row is None else one(np.asarray(row, int)))


def hashed(text: Column) -> Column:
    """Unit vector of token counts, each token in the dimension its digest names; null for a text without tokens.

    A stand-in for an embedding model in tests and demos: deterministic, without any claim of quality.
    """
    return _counted(F.transform(exact_tokens(text), lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") % DIMENSIONS))


@F.pandas_udf(BinaryType())
def encoded(vector: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats of a vector; null for null."""
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def decoded(blob: pd.Series) -> pd.Series:
    """The vector of ``encoded``; null where the bytes are no whole floats, hold a number that isn't finite, or give a
    length that is off 1 by more than a thousandth."""

    def one(b):
        if b is None or not b or len(b) % 4:
            return None
        v = np.frombuffer(b, "<f4")
        return v if np.isfinite(v).all() and abs(float(np.sqrt((v.astype(float) ** 2).sum())) - 1) <= 1e-3 else None

    return blob.map(one)


def norm(vector: Column) -> Column:
    """Length of a vector."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def equivalent(a: Column, b: Column) -> Column:
    """Whether two vectors may stand for each other: a cosine of at least .999999 and no component off by more than 1e-5."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    apart = F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return F.coalesce((F.size(a) == F.size(b)) & (dot / (norm(a) * norm(b)) >= 0.999999) & (apart <= 1e-5), F.lit(False))
