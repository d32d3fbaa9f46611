"""Vector expressions: similarities, normalization, quantization."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIMILARITIES = ("Dot", "Cosine", "Euclidean")
SCALE = 16129.0


def _doubles(c: Column) -> Column:
    return c.cast("array<double>")


def literal(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.transform(_doubles(a), lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    """Negated squared distance."""
    return -F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def similarity(kind: str, a: Column, b: Column) -> Column:
    return {"Dot": dot, "Cosine": cosine, "Euclidean": euclidean}[kind](a, b)


def similarity_to(query, kind: str):
    """Similarity of an array column to one query vector, by Arrow batches."""
    q = np.asarray(query, np.float64)
    if kind == "Cosine":
        q = q / np.linalg.norm(q)

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        x = np.stack(s.to_numpy()).astype(np.float64) if len(s) else np.zeros((0, len(q)))
        if kind == "Euclidean":
            return pd.Series(-((x - q) ** 2).sum(axis=1))
        y = x @ q
        return pd.Series(y / np.linalg.norm(x, axis=1) if kind == "Cosine" else y)

    return score


def similarity_to_i8(query, kind: str):
    """Similarity of (int8 components, scale) columns to one query vector, by Arrow batches."""
    q = np.asarray(query, np.float64)
    if kind == "Cosine":
        q = q / np.linalg.norm(q)

    @F.pandas_udf("double")
    def score(s: pd.Series, scale: pd.Series) -> pd.Series:
        x = np.stack(s.to_numpy()).astype(np.float64) * scale.to_numpy()[:, None] if len(s) else np.zeros((0, len(q)))
        if kind == "Euclidean":
            return pd.Series(-((x - q) ** 2).sum(axis=1))
        return pd.Series(x @ q / (np.linalg.norm(x, axis=1) if kind == "Cosine" else 1))

    return score


def reported(score: Column, kind: str, quantized: bool = False) -> Column:
    """The score that a result shows: the squared distance, or (s + 1) / 2."""
    if kind == "Euclidean":
        return -score
    return ((score / SCALE if quantized else score) + 1) / 2


def _int8(c: Column) -> Column:
    return F.greatest(F.least(F.round(c), F.lit(127.0)), F.lit(-127.0)).cast("tinyint")


def quantize_cosine(a: Column) -> Column:
    """Components of a unit vector times 127."""
    return F.transform(_doubles(a), lambda x: _int8(x * 127))


def quantize_symmetric(a: Column) -> Column:
    """Struct of scale (largest magnitude / 127), norm and int8 components."""
    scale = F.array_max(F.transform(_doubles(a), lambda x: F.abs(x))) / 127
    return F.struct(scale.alias("scale"), norm(a).alias("norm"), F.transform(_doubles(a), lambda x: F.when(scale == 0, F.lit(0).cast("tinyint")).otherwise(_int8(x / scale))).alias("values"))


def quantized_dot(a: Column, b: Column) -> Column:
    return dot(a["values"], b["values"]) * a["scale"] * b["scale"]


def quantized_euclidean(a: Column, b: Column) -> Column:
    """Negated squared distance from norms and the int8 dot product."""
    return -(a["norm"] * a["norm"] + b["norm"] * b["norm"] - 2 * quantized_dot(a, b))


def affine_range(low: float, high: float) -> tuple[float, float]:
    """Step and zero of an affine int8 code over a range that is widened to 2**n - 1."""
    span = high - low
    n = max(1, int(np.ceil(np.log2(span + 1)))) if span > 0 else 1
    return ((1 << n) - 1) / 255, low


def quantize_affine(a: Column, step: float, zero: float) -> Column:
    return F.transform(_doubles(a), lambda x: F.greatest(F.least(F.round((x - zero) / step), F.lit(255.0)), F.lit(0.0)).cast("smallint"))


def dequantize_affine(a: Column, step: float, zero: float) -> Column:
    return F.transform(a, lambda x: x * F.lit(step) + F.lit(zero))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of rows whose length is a power of two."""
    y = x.astype(np.float64).copy()
    n, h = y.shape[1], 1
    while h < n:
        z = y.reshape(len(y), n // (2 * h), 2, h)
        a, b = z[:, :, 0].copy(), z[:, :, 1].copy()
        z[:, :, 0], z[:, :, 1] = a + b, a - b
        h *= 2
    return y / np.sqrt(n)


def rotate(x: np.ndarray, seed: int = 1234) -> np.ndarray:
    """Rows padded to a power of two, signs flipped by a fixed mask, and mixed by the transform; dot products stay."""
    n = 1 << max(0, x.shape[1] - 1).bit_length()
    signs = np.where(np.random.default_rng(seed).integers(0, 2, n) == 1, 1.0, -1.0)
    return hadamard(np.pad(x.astype(np.float64), ((0, 0), (0, n - x.shape[1]))) * signs)


def rotated_int8(x: np.ndarray, seed: int = 1234) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes of rotated rows, and each row's scale."""
    r = rotate(x, seed)
    scale = np.maximum(np.abs(r).max(axis=1, keepdims=True), 1e-30) / 127
    return np.clip(np.round(r / scale), -127, 127).astype(np.int8), scale[:, 0]


def quantize_rotated(seed: int = 1234):
    """Arrow UDF: array column to struct(scale, values) of rotated int8 codes."""

    @F.pandas_udf("struct<scale: double, values: array<tinyint>>")
    def q(s: pd.Series) -> pd.DataFrame:
        codes, scale = rotated_int8(np.stack(s.to_numpy()), seed)
        return pd.DataFrame({"scale": scale, "values": list(codes)})

    return q


def decode_external(b64: str) -> list[float]:
    """A vector from base64 of big-endian 32-bit floats."""
    import base64

    return np.frombuffer(base64.b64decode(b64), ">f4").astype(float).tolist()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def external_vector(s: pd.Series) -> pd.Series:
    return s.map(decode_external, na_action="ignore")


def json_vector(c: Column) -> Column:
    return F.from_json(c, "array<float>")
