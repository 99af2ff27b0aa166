"""Engine-independent hashes and the task payload."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A linear congruential step and the modulus of the mixing step.
STEP, SHIFT, MODULUS = 1103515245, 12345, 2147483648
PRIME = 2147483647


def priority(key: Column, turn: int | Column, seed: int) -> Column:
    """A hash of any long key that any SQL engine can compute, 0 .. PRIME-1."""
    turn = F.lit(turn) if isinstance(turn, int) else turn
    h = F.pmod(F.pmod(key.cast("long"), F.lit(MODULUS)) * STEP + turn.cast("long") * SHIFT + F.lit(seed), F.lit(MODULUS))
    return F.pmod(h * (h + 1), F.lit(PRIME))


def priority_of(key: np.ndarray, turn: int, seed: int) -> np.ndarray:
    """The same hash of an array."""
    h = (key % MODULUS * STEP + turn * SHIFT + seed) % MODULUS
    return h * (h + 1) % PRIME


def priority_sql(key: str, turn: str, seed: int) -> str:
    h = f"((({key})::BIGINT % {MODULUS} * {STEP} + ({turn})::BIGINT * {SHIFT} + {seed}) % {MODULUS})"
    return f"(({h} * ({h} + 1)) % {PRIME})"


def checksum(size: int | Column) -> Column:
    """Sum of the entries of (ones) x (twos), square matrices of that size."""
    n = (F.lit(size) if isinstance(size, int) else size).cast("long")
    return n * n * n * 2


def payload(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """(matrix_size, entries, entry_min, entry_max, total) of the product,
    actually multiplied out."""
    n = spark.createDataFrame([(s,) for s in sizes], "matrix_size long").distinct()
    cells = lambda r, c, v: n.select("matrix_size", F.explode(F.sequence(F.lit(1), F.col("matrix_size"))).alias(r)).select(
        "matrix_size", r, F.explode(F.sequence(F.lit(1), F.col("matrix_size"))).alias(c), F.lit(v).cast("long").alias(f"v{v}")
    )
    product = cells("i", "k", 1).join(cells("k", "j", 2), ["matrix_size", "k"]).groupBy("matrix_size", "i", "j").agg(F.sum(F.col("v1") * F.col("v2")).alias("c"))
    return product.groupBy("matrix_size").agg(F.count("*").alias("entries"), F.min("c").alias("entry_min"), F.max("c").alias("entry_max"), F.sum("c").alias("total"))
