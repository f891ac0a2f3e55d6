"""Values of rows that are asked for outside, one by one: a bounded pool in each task.

Rows that have a value are passed on; for each other row the lookup is called, and again after a
failure, each time after a longer wait. Answers go back to their rows in their order, whatever order
they come in. A row that fails too often fails the task, which Spark runs again; a stage in parts
(``resume.resumed``) then keeps what other parts have got.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Calls of one task at a time, further tries after a failure, seconds of the first wait, and rows handed over at a time.
POOL, RETRIES, WAIT, ROWS = 20, 5, 2.0, 500


class LookupFailed(Exception):
    """A row failed at the last try."""


def tried(look: Callable, args: tuple, retries: int = RETRIES, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep):
    """look(*args); after the nth failure there are n waits before the next try. None is a failure too."""
    for attempt in range(retries + 1):
        try:
            if (value := look(*args)) is None:
                raise ValueError("no value")
            return value
        except Exception as e:  # whatever the other side does
            if attempt == retries:
                raise LookupFailed(f"failed after {retries} retries for {args}: {e}") from e
            sleep(wait * (attempt + 1))


def looked_up(df: DataFrame, look: Callable, by: list[str], out: str, pool: int = POOL, retries: int = RETRIES, wait: float = WAIT) -> DataFrame:
    """df with look(*by) in out where that is null; look gives a value that fits the column's type.

    At most pool calls of a task run at a time, and cores x pool in all; fewer partitions make
    fewer. Each row is asked for once, but a task that is run again asks anew.
    """
    name = out + "_"
    while name in df.columns:
        name += "_"
    kind = df.schema[out].dataType

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(pool) as workers:
            for whole in it:
                for at in range(0, whole.num_rows, ROWS):
                    b = whole.slice(at, ROWS)
                    column = b.column(b.schema.get_field_index(out))
                    asked = zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in by))
                    calls = [None if has else workers.submit(tried, look, args, retries, wait) for has, args in zip(column.is_valid().to_pylist(), asked)]
                    found = [v if c is None else c.result() for v, c in zip(column.to_pylist(), calls)]
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, column.type)], names=[*b.schema.names, name])

    made = df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))
    return made.withColumn(out, F.col(f"`{name}`")).drop(name)
