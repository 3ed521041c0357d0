"""What the operators share: word pattern, label folds, column names, bounded samples and a sieve for large joins."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.cut import materialise as cut  # noqa: F401
from ..plans.cut import new_folder, scratch, shared_folder  # noqa: F401

#: A word, for the operators that count words: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have (Spark compares names without case)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: str | Column) -> Column:
    """True for the fifth of rows whose labels are never learnt from: crc32 of the id's text mod 5 is 0.

    A null id counts as empty text (crc32 0), so it is held out.
    """
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def spread(*columns: str | Column) -> Column:
    """A 64-bit hash that orders rows for bounded samples: the same rows for the same data, in any layout."""
    return F.xxhash64(*columns)


@functools.cache
def _trim() -> Callable[[int], int] | None:
    """The C library's own way to give memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy() -> None:
    """Gives the memory that Arrow and numpy keep after a batch back to the machine; an executor's workers share little
    of it, and stay for the next stage."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


#: Bounds of what goes to a Python worker at once, where the session doesn't say otherwise. Texts are of any length, so
#: Spark's own bound, 10,000 rows, is none of bytes.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("64m", "8m")}


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session's batches are bounded from now on."""
    for key, (default, ours) in BATCH.items():
        if df.sparkSession.conf.get(key, default).lower() in (default, "67108864", "67108864b"):
            df.sparkSession.conf.set(key, ours)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowest(keys: DataFrame, by: str, most: int) -> DataFrame:
    """Of each ``by`` the ``most`` rows with the least ``h``, a 64-bit hash that no two rows of one ``by`` share.

    A threshold from the count lets twice as many through, on average, before they are numbered, so no task sorts all
    rows of a ``by``; fewer than ``most`` only pass where there are no more.
    """
    n = keys.groupBy(by).agg(F.count("*").alias("n")).select(F.col(by).alias("b"), "n")
    passing = keys.join(n, F.col(by).eqNullSafe(F.col("b"))).where(F.col("h") / F.lit(2.0**64) + 0.5 <= F.lit(2.0 * most + 50) / F.col("n"))
    return passing.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy("h"))).where(F.col("nth") <= most).select(*keys.columns)


#: Bits of the largest sieve: 64 MB, in 16,384 rows.
SIEVE_BITS = 1 << 29
_CELL = 15


def sieved(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean ``name`` that is false where the hash ``key`` surely is none of ``keys`` (one long column).

    The keys make a bitmap, 16 bits or more a key up to SIEVE_BITS, which bounds what is broadcast whatever their
    number. Beyond that more rows pass, and beyond ten times as many nearly all do: then the exact join that follows
    moves what it would without a sieve.
    """
    k = keys.columns[0]
    bits = min(SIEVE_BITS, max(1 << 20, 1 << (16 * keys.count()).bit_length()))
    cell, at = F.shiftright(F.pmod(F.col(k), F.lit(bits)), _CELL), F.col(k).bitwiseAND((1 << _CELL) - 1)
    found = keys.select(cell.cast("long").alias("cell"), at.alias("at")).repartition("cell").groupBy("cell").agg(F.bitmap_construct_agg("at").alias("map"))
    names = {c: fresh(df, c) for c in ("cell", "map")}
    found = found.select(F.col("cell").alias(names["cell"]), F.col("map").alias(names["map"]))
    bit = key.bitwiseAND((1 << _CELL) - 1).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(names["map"]), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    # at most SIEVE_BITS in all
    x = df.join(F.broadcast(found), F.shiftright(F.pmod(key, F.lit(bits)), _CELL).cast("long") == F.col(names["cell"]), "left")
    return x.withColumn(name, F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(7))) != 0, F.lit(False))).drop(*names.values())
