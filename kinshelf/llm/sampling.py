"""Bounded samples of labelled rows, and the rows that are kept from learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: str) -> Column:
    """Whether a row is kept for testing; rows without an id are not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def uniform(doc_id: str, seed: int) -> Column:
    """A number from 0 to 1 that depends on the id alone."""
    return F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 30)) / (1 << 30)


def sample_by(rows: DataFrame, group: str, doc_id: str, most: int, seed: int = 1) -> DataFrame:
    """About ``most`` rows of each value of ``group`` at most, chosen by a hash of the id.

    All rows are counted first, so nothing is sorted or held. Values of ``group`` are few.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    chosen = F.lit(False)
    for value, n in counts.items():
        chosen = chosen | ((F.col(group) == F.lit(value)) & (uniform(doc_id, seed) < most / n))
    return rows.where(chosen)
