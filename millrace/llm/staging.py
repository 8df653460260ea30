"""Intermediate tables in the folder that the whole cluster shares.

Iterative operators cut their lineage by writing a table under ``spark.checkpoint.dir`` and reading it
again, so a lost executor costs a re-read, never a recomputation of earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.shared import Stage

__all__ = ["Stage", "is_small", "mark_maybe", "maybe_in", "small_side"]

#: A side with at most this many bytes may be broadcast.
BROADCAST_BYTES = 24_000_000
#: Bits of a bitmap of keys: 32 MB, the bound of what is broadcast of it. More bits would let fewer others pass.
BITMAP = 1 << 28
#: Bytes of a value; a row has so many more. Strings and binaries are measured.
WIDTHS = {T.LongType: 8, T.DoubleType: 8, T.IntegerType: 4, T.DateType: 4, T.FloatType: 4, T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.TimestampType: 8, T.TimestampNTZType: 8}
ROW = 16


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """Whether ``df`` has at most ``limit`` bytes (BROADCAST_BYTES).

    Asking reads rows only up to the limit. A column of another kind than those of WIDTHS, strings and binaries
    has no known size, so then the answer is no.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    kinds = [type(f.dataType) for f in df.schema]
    if any(k not in WIDTHS and not issubclass(k, (T.StringType, T.BinaryType)) for k in kinds):
        return False
    fixed = ROW + sum(WIDTHS.get(k, 8) for k in kinds)
    measured = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)).cast("long") for f in df.schema if type(f.dataType) not in WIDTHS]
    sizes = df.limit(limit // fixed + 1).select(sum(measured, F.lit(fixed).cast("long")).alias("b"))
    return (sizes.agg(F.sum("b")).first()[0] or 0) <= limit


def small_side(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it ``is_small``, else as it is for a shuffled join."""
    return F.broadcast(df) if is_small(df, limit) else df


def maybe_in(rows: DataFrame, keys: DataFrame, column: str, *, inside: bool = True) -> DataFrame:
    """The rows whose ``column`` has its bit set in a bitmap of that of ``keys``: all that are in it, and few others.

    With ``inside`` false all the rest: rows that are certainly not in it.
    """
    marked = mark_maybe(rows, keys, column, "_maybe")
    return marked.where("_maybe" if inside else "not _maybe").select(*rows.columns)


def mark_maybe(rows: DataFrame, keys: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with ``name``, whether the bit of ``column`` is set in a bitmap of that of ``keys``."""
    bit = F.pmod(F.xxhash64(column), F.lit(BITMAP))
    maps = keys.select(bit.alias("_x")).groupBy(F.bitmap_bucket_number("_x").alias("_m")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_x")).alias("_bits"))
    placed = rows.withColumn("_m", F.bitmap_bucket_number(bit)).withColumn("_at", F.bitmap_bit_position(bit))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")), F.lit(0).cast("byte")) == 1
    return placed.join(F.broadcast(maps), "_m", "left").select(*rows.columns, is_set.alias(name))
