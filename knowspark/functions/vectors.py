"""Vectors stored as array<float>: scalar maths, text form, scoring."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Similarities are ranked at this many decimals, so that equal vectors tie
#: whatever order a machine adds their products in.
RANK_DECIMALS = 12


def _c(column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def dot(a, b) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(
        _c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_similarity(a, b) -> Column:
    """One minus cosine distance; NULL for a zero vector. For ranking many rows
    against a known vector use :func:`similarity_to`, which is much faster."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def format_vector(vector) -> Column:
    """Interchange text ``[v1,v2,...]``."""
    return F.concat(
        F.lit("["), F.array_join(F.transform(_c(vector), lambda v: v.cast("string")), ","),
        F.lit("]"))


def parse_vector(text) -> Column:
    return F.from_json(_c(text), T.ArrayType(T.FloatType()))


def matrix_of(vectors: pa.Array, dims: int, kind=np.float64) -> np.ndarray:
    """Rows of a non-null list array as a matrix."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if flat.size != len(vectors) * dims or not np.all(
            np.asarray(vectors.value_lengths()) == dims):
        raise ValueError(f"expected vectors of {dims} dimensions")
    return flat.reshape(len(vectors), dims).astype(kind)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows become NaN and never rank."""
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(length > 0, matrix / length, np.nan)


def similarity_to(vector, embedding) -> Column:
    """Cosine similarity of an embedding column with one known vector.

    An Arrow UDF: only the embedding column leaves the JVM, and each batch is one
    matrix-vector product. NULL and zero vectors give NULL.
    """
    target = unit_rows(np.asarray([vector], dtype=np.float64))[0]

    @F.arrow_udf(T.DoubleType())
    def score(vectors: pa.Array) -> pa.Array:
        present = np.asarray(vectors.is_valid())
        out = np.full(len(vectors), np.nan)
        if present.any():
            rows = unit_rows(matrix_of(vectors.drop_null(), len(target)))
            out[present] = np.round(rows @ target, RANK_DECIMALS)
        return pa.array(out, mask=np.isnan(out))

    return score(_c(embedding))
