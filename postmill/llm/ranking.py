"""Keeping the best of many scored rows, shared by the search operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 64


def best_of(owner: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's k best rows: highest score first, ties to the smaller key."""
    order = np.lexsort((key, -score, owner))
    if not len(order):
        return order
    own = owner[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order[rank < k]


def ranked(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The k first rows of each group, with ``rank`` from 1.

    Groups may be of any size: the k first of each of ``SALTS`` parts of a group are found first, and those before them
    by every task that has rows of the group, so that no group meets in one task as a whole.
    """
    salted = rows.withColumn("__salt", F.spark_partition_id() % SALTS)
    first = salted.withColumn("__rank", F.row_number().over(W.partitionBy(*by, "__salt").orderBy(*order))).filter(F.col("__rank") <= k)
    return first.drop("__salt", "__rank").withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def usable(embedding: str, *, zero: bool) -> Column:
    """Whether a vector has components and all of them are numbers; ``zero``: whether they may all be 0."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    numbers = F.col(embedding).cast("array<double>")
    good = numbers.isNotNull() & (F.size(numbers) > 0) & ~F.exists(numbers, bad)
    good = good if zero else good & F.exists(numbers, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Arrays of ``width`` numbers as the rows of a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), width)
