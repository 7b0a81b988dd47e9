"""Block and audio transforms in numpy on Arrow batches, and integer maths as expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def dct_matrix(n: int = 8) -> np.ndarray:
    """Orthonormal DCT-II."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


_D8 = dct_matrix(8)
_COMPLEX = T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])


def _blocks(s: pd.Series) -> np.ndarray:
    return np.array(s.tolist(), float).reshape(-1, 8, 8)


@pandas_udf(T.ArrayType(T.IntegerType()))
def idct8(coef: pd.Series) -> pd.Series:
    """Inverse DCT of 64 coefficients in raster order, rounded to integers."""
    out = np.rint(_D8.T @ _blocks(coef) @ _D8).astype(int).reshape(-1, 64)
    return pd.Series(out.tolist())


@pandas_udf(T.ArrayType(T.DoubleType()))
def fdct8(pixels: pd.Series) -> pd.Series:
    """Forward DCT of 64 pixels in raster order."""
    return pd.Series((_D8 @ _blocks(pixels) @ _D8.T).reshape(-1, 64).tolist())


def hadamard(n: int = 8) -> np.ndarray:
    h = np.ones((1, 1), int)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


@pandas_udf(T.LongType())
def satd8(diff: pd.Series) -> pd.Series:
    """Sum of absolute Hadamard coefficients of 64 differences."""
    h = hadamard(8)
    return pd.Series(np.abs(h @ _blocks(diff) @ h).sum(axis=(1, 2)).astype(int))


def mdct(x: np.ndarray, window: np.ndarray) -> np.ndarray:
    """MDCT of 2n windowed samples to n coefficients, by the defining sum as one matrix."""
    n = x.shape[-1] // 2
    k, t = np.arange(n)[:, None], np.arange(2 * n)[None, :]
    return (x * window) @ np.cos(np.pi / n * (t + 0.5 + n / 2) * (k + 0.5)).T


def imdct(c: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The aliased 2n samples of n coefficients; overlap-adding neighbours restores the signal."""
    n = c.shape[-1]
    k, t = np.arange(n)[:, None], np.arange(2 * n)[None, :]
    return (c @ np.cos(np.pi / n * (t + 0.5 + n / 2) * (k + 0.5))) * window * (2 / n)


def sine_window(n2: int) -> np.ndarray:
    return np.sin(np.pi * (np.arange(n2) + 0.5) / n2)


@pandas_udf(T.ArrayType(T.DoubleType()))
def mdct_udf(frame: pd.Series) -> pd.Series:
    """MDCT of each frame with a sine window."""
    return frame.map(lambda f: mdct(np.asarray(f, float), sine_window(len(f))).tolist())


@pandas_udf(T.ArrayType(T.DoubleType()))
def imdct_udf(coefs: pd.Series) -> pd.Series:
    return coefs.map(lambda c: imdct(np.asarray(c, float), sine_window(2 * len(c))).tolist())


@pandas_udf(T.ArrayType(_COMPLEX))
def fft_udf(re: pd.Series, im: pd.Series) -> pd.Series:
    """Complex FFT of each row."""
    out = []
    for a, b in zip(re, im):
        z = np.fft.fft(np.asarray(a, float) + 1j * np.asarray(b, float))
        out.append([(float(v.real), float(v.imag)) for v in z])
    return pd.Series(out)


@pandas_udf(T.ArrayType(T.DoubleType()))
def rotate_udf(x: pd.Series, theta: pd.Series) -> pd.Series:
    """Spread a vector by plane rotations of neighbours; the angle's negative undoes it."""

    def run(v, t):
        v, (c, s) = np.asarray(v, float).copy(), (np.cos(t), np.sin(t))
        order = range(len(v) - 1) if t >= 0 else range(len(v) - 2, -1, -1)
        for i in order:
            v[i], v[i + 1] = c * v[i] - s * v[i + 1], s * v[i] + c * v[i + 1]
        return v.tolist()

    return pd.Series([run(a, b) for a, b in zip(x, theta)])


def isqrt(v: Column) -> Column:
    """Integer square root."""
    return F.floor(F.sqrt(v.cast("double"))).cast("long")


def ilog(v: Column) -> Column:
    """Number of bits of a non-negative integer; 0 for 0."""
    return F.when(v > 0, F.length(F.bin(v.cast("long")))).otherwise(0)


def reciprocal(v: Column, bits: int = 16) -> Column:
    """2^bits / v, truncated."""
    return F.floor(F.lit(float(1 << bits)) / v).cast("long")


def rsqrt(v: Column) -> Column:
    """1 / sqrt(v) of a positive number; null else."""
    return F.when(v > 0, 1 / F.sqrt(v.cast("double")))


def cos_turns(v: Column) -> Column:
    """Cosine of a number of quarter turns."""
    return F.cos(v.cast("double") * float(np.pi / 2))


def exp2(v: Column) -> Column:
    return F.pow(F.lit(2.0), v.cast("double"))


def log2(v: Column) -> Column:
    """Logarithm to base 2 of a positive number; null else."""
    return F.when(v > 0, F.log2(v.cast("double")))
