"""Digests of a whole value held in one column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALGORITHMS = ("MD2", "MD5", "SHA-1", "SHA-256", "SHA-384", "SHA-512")


def check_algorithm(algorithm: str) -> str:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm must be one of {ALGORITHMS}, got {algorithm!r}")
    return algorithm


def digest(col: Column, algorithm: str = "MD5") -> Column:
    """Lower-case hex digest. MD2 takes text only: the JVM helper behind it is string-typed."""
    check_algorithm(algorithm)
    if algorithm == "MD2":
        codec = F.lit("org.apache.commons.codec.digest.DigestUtils")
        return F.java_method(codec, F.lit("md2Hex"), col)
    if algorithm == "MD5":
        return F.md5(col)
    if algorithm == "SHA-1":
        return F.sha1(col)
    return F.sha2(col, int(algorithm.split("-")[1]))
