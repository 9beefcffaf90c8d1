"""Bounded training samples and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def sample(rows: DataFrame, id_col: str, limit: int) -> DataFrame:
    """The ``limit`` rows whose ids have the smallest hashes: the same ones in every run and partitioning.

    It holds at most ``limit`` ids and labels, so it may be broadcast.
    """
    return F.broadcast(rows.orderBy(F.xxhash64(id_col), id_col).limit(limit))
