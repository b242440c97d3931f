"""Term weights. All logarithms are natural."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(n: Column, df: Column) -> Column:
    """ln(N / df), for TF-IDF."""
    return F.ln(n / df)


def robertson(n: Column, df: Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5) + 1), for BM25, LSI, feedback and difficulty."""
    return F.ln((n - df + 0.5) / (df + 0.5) + 1.0)


def log_tf(tf: Column) -> Column:
    return 1.0 + F.ln(tf)


def saturation(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    """BM25's term-frequency part."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def bit_length(x: Column) -> Column:
    """floor(log2(x)) + 1 of a positive integer, exactly."""
    return F.length(F.bin(x))


def gamma_bits(x: Column) -> Column:
    return 2 * (bit_length(x) - 1) + 1


def delta_bits(x: Column) -> Column:
    return gamma_bits(bit_length(x)) + bit_length(x) - 1


def vbyte_bytes(x: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(bit_length(F.greatest(x, F.lit(1))) / 7)).cast("long")
