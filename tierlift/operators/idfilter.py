"""Rows of a given set of users, filtered before they are shuffled.

``only_users`` is a semi-join whose filter side is a bitmap: ids map to
``2^bits`` slots (a BIGINT id by its low bits, a text id by a hash), the set is
one 4 KB bitmap per 32,768 slots, built by partial aggregation, and each row
looks its slot up by bucket.  The relation is broadcast, as its size is bounded
by the parameter alone: at most ``2^bits / 8`` bytes, however many users there
are.  BIGINT ids below ``2^bits`` have slots of their own, so the filter is
exact for them; otherwise rows of a user who shares a slot with the set pass
too.  It is therefore followed by the join on the id wherever the result must
not contain them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Slots of one bitmap of the built-in bitmap functions.
BUCKET = 32_768


def _slot(df: DataFrame, id_col: str, bits: int) -> Column:
    text = isinstance(df.schema[id_col].dataType, T.StringType)
    # The bitmap functions count slots from 1.
    return F.pmod(F.xxhash64(id_col) if text else F.col(id_col), F.lit(1 << bits)) + F.lit(1)


def user_bitmaps(users: DataFrame, id_col: str = "user_id", bits: int = 27) -> DataFrame:
    """``_bucket, _map``: the slots of the users' ids, at most ``2^bits / 32768`` rows."""
    if not 15 <= bits <= 31:
        raise ValueError("bits must be between 15 and 31")
    return (users.where(F.col(id_col).isNotNull()).select(_slot(users, id_col, bits).alias("_slot"))
            .groupBy(F.bitmap_bucket_number("_slot").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_map")))


def only_users(rows: DataFrame, users: DataFrame, id_col: str = "user_id", bits: int = 27) -> DataFrame:
    """The rows whose ``id_col`` has the slot of an id of ``users`` (all rows of
    those users, possibly some of others); rows without an id are dropped."""
    marked = rows.where(F.col(id_col).isNotNull()).withColumn("_slot", _slot(rows, id_col, bits))
    met = (marked.withColumn("_bucket", F.bitmap_bucket_number("_slot"))
           .join(F.broadcast(user_bitmaps(users, id_col, bits)), "_bucket"))
    bit = "bitmap_bit_position(_slot)"
    # One byte of the bitmap as a number, then its bit.
    byte = f"ascii(decode(substring(_map, CAST({bit} DIV 8 AS INT) + 1, 1), 'ISO-8859-1'))"
    return met.where(F.expr(f"shiftright({byte}, CAST({bit} % 8 AS INT)) & 1 = 1")).select(*rows.columns)
