"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps
from typing import get_type_hints

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import drop, fresh_path, shared_dir, ship
from ..store import written as _written

__all__ = ["drop", "fresh_path", "give_back", "shared_dir", "table", "tidied", "unit", "written"]


def give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def written(df: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """``store.written``; the driver's Python gives back what it no longer needs before the job."""
    ship(df.sparkSession)
    give_back()
    return _written(df, name, keep)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function over a partition's batches; when it ends, freed memory goes back to the
    system. Python workers live on between tasks, and what their allocators keep adds up."""

    if (session := SparkSession.getActiveSession()) is not None:
        ship(session)

    @wraps(run)
    def own(parts: Iterator) -> Iterator:
        try:
            yield from run(parts)
        finally:
            give_back()

    own.__annotations__ = get_type_hints(run)
    return own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit(*cols: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) fixed by the columns and the seed."""
    h = F.xxhash64(F.lit(seed), *cols)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))
