"""Shared plumbing of the training-data operators: words, scratch tables and code shipping."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mixlens.shipping import ship
from mixlens.sources.tables import drop_stored, scratch, stored, table

__all__ = ["BROADCAST_ROWS", "Bitmap", "WORD", "WORD_BYTES", "WORD_PATTERN", "batches_of", "drop_stored", "held", "hot_join", "release", "scratch", "ship", "small", "stored", "table", "trim", "unused", "with_python", "word_count"]

#: A word is a run of characters other than the ASCII white space of the contracts.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)
#: The same on UTF-8 bytes: the class only excludes ASCII, so both split alike.
WORD_BYTES = re.compile(WORD_PATTERN.encode())


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df has no column of, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of a few numbers each that may be broadcast, 16 MB.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, count: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df as the side of a join to broadcast, if its rows, counted before, are few; else the join is left to Spark."""
    return F.broadcast(df) if count <= most else df


#: Rows of a key from which hot_join broadcasts it, and the most keys that it broadcasts.
HOT_ROWS = 5_000
HOT_KEYS = 100_000


def hot_join(df: DataFrame, side: DataFrame, key: str, rows: str) -> DataFrame:
    """df with the columns of side, which has each value of key once, null included, and how many rows of df it has.

    Keys of many rows are broadcast and their rows stay where they are; the others meet by a shuffle. No more than total
    rows / HOT_ROWS keys can be hot, and the limit rises with the rows so that at most HOT_KEYS are. side is read twice.
    """
    total = side.agg(F.sum(rows)).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_KEYS)
    added = [c for c in side.columns if c not in (key, rows)]
    left, hot_, cold_ = unused(df, "left", "hot", "cold")
    part = lambda some, name: some.select(F.struct(F.col(key).alias("k")).alias("k"), F.struct(*(F.col(c) for c in added)).alias("v")).toDF(f"{name}_k", name)
    own = df.withColumn(left, F.struct(F.col(key).alias("k")))
    hot = own.join(F.broadcast(part(side.filter(F.col(rows) > limit), hot_)), F.col(left) == F.col(f"{hot_}_k"), "left")
    # a row that has its values already takes a key of its own, so hot keys do not meet in the shuffle
    spread = F.when(F.col(hot_).isNull(), F.col(left))
    seed = F.when(F.col(hot_).isNotNull(), F.xxhash64(F.monotonically_increasing_id()))
    cold = part(side.filter(F.col(rows) <= limit), cold_).withColumn(f"{cold_}_s", F.lit(None).cast("long"))
    joined = hot.withColumns({left: spread, f"{left}_s": seed}).join(cold, F.col(left).eqNullSafe(F.col(f"{cold_}_k")) & F.col(f"{left}_s").eqNullSafe(F.col(f"{cold_}_s")), "left")
    return joined.select(*df.columns, *(F.coalesce(F.col(hot_)[c], F.col(cold_)[c]).alias(c) for c in added))


#: Bounds of the binary logarithm of the bits of a bitmap that filters rows.
FILTER_BITS = (16, 26)


class Bitmap:
    """Rows of a table by a hash of some columns: what it does not pass is not in the table.

    It holds 8 bits for each row, within bounds, so it is a table of 2**26 / 64 rows, 16 MB, at most, and is broadcast
    for that bound.
    """

    def __init__(self, rows: DataFrame, columns: list[str], count: int) -> None:
        self.bits = min(FILTER_BITS[1], max(FILTER_BITS[0], count.bit_length() + 3))
        cell = self._cell(columns)
        self.words = rows.groupBy(F.shiftright(cell, 6).alias("word")).agg(F.bit_or(self._bit(cell)).alias("bits"))

    def _cell(self, columns: list[str]) -> Column:
        return F.xxhash64(*columns).bitwiseAND(F.lit((1 << self.bits) - 1))

    @staticmethod
    def _bit(cell: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(63)).cast("int"))

    def marked(self, df: DataFrame, columns: list[str], name: str) -> DataFrame:
        """df with a boolean column of that name: false where a row is in no case in the table."""
        word, bits = unused(df, "word", "bits")
        cell = self._cell(columns)
        both = df.withColumn(word, F.shiftright(cell, 6)).join(F.broadcast(self.words.toDF(word, bits)), word, "left")
        return both.withColumn(name, F.coalesce(F.col(bits).bitwiseAND(self._bit(cell)) != 0, F.lit(False))).drop(word, bits)


def with_python(df: DataFrame, inputs: list[str], keep: list[str], added: str, factory: Callable[[], Callable[..., list]], rows: int = 256) -> DataFrame:
    """Add columns that Python makes from whole rows, a few rows at a time.

    factory runs once in each task and gives the function from lists of inputs to lists of outputs. Of columns in keep,
    those that added names again are replaced.
    """
    ship(df.sparkSession)
    new = StructType.fromDDL(added)
    keep = [c for c in keep if c not in new.names]
    needed = list(dict.fromkeys([*keep, *inputs]))
    source = df.select(*(f"`{c}`" for c in needed))
    out = StructType([source.schema[c] for c in keep] + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = None
        kinds = to_arrow_schema(new)
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                if make is None:
                    make = factory()
                    if make not in _HELD.values():
                        release()
                batch = whole.slice(k, rows)
                made = make(*(batch.column(c).to_pylist() for c in inputs))
                columns = [batch.column(c) for c in keep] + [pa.array(v, f.type) for v, f in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *new.names])
        trim()

    return source.mapInArrow(run, out)


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """What runs meanwhile gives Python no more than about size bytes at once, or one row.

    An executor holds a batch in its JVM, in buffers of up to twice its size, and in each worker that reads it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_HELD: dict = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What make returns, kept in this worker for later tasks; only the last one asked for stays, so memory is bounded."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Drop what this worker holds of earlier tasks."""
    if _HELD:
        _HELD.clear()
    trim()


def trim() -> None:
    """Give freed memory back to the system: a worker waits for further tasks, and its executor has other uses for it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
