"""What the corpus operators share: inputs, the shared folder, bounded batches of texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.session import scratch, written

__all__ = ["batches", "documents", "expr_crc_fold", "give_back", "scratch", "shuffle_partitions", "table", "tidy", "tidy_group", "unused", "written"]

#: Bytes of text that a Python task works on at a time; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def expr_crc_fold(key: Column, folds: int = 5) -> Column:
    """crc32 of a key's text modulo the number of folds; a null key hashes as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def unused(columns: Iterable[str], stem: str) -> str:
    """A name that none of the columns has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Hands memory that is free back to the machine. Python workers serve one task after another,
    and what a task let go would else stay with the worker."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def tidy(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that hands back its memory when its task ends."""

    @wraps(run)
    def tidied(*args, **kwargs) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(*args, **kwargs)
        finally:
            give_back()

    return tidied


def tidy_group(run: Callable[..., pa.Table], *given) -> Callable[[pa.Table], pa.Table]:
    """A function for applyInArrow, of a group and what is given, that hands back its memory after
    each group."""

    def tidied(group: pa.Table) -> pa.Table:
        try:
            return run(group, *given)
        finally:
            give_back()

    return tidied


def batches(it: Iterable[pa.RecordBatch], text: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most limit bytes of text each, or one row."""
    for b in it:
        at = b.schema.get_field_index(text)
        if not b.num_rows:
            continue
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(at)), 0), dtype=np.int64))
        start, base = 0, 0
        while start < b.num_rows:
            end = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
            yield b.slice(start, end - start)
            base, start = int(sizes[end - 1]), end
