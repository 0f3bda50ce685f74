"""Membership filter of a fixed size: rows whose key is surely not in a set skip the join with it.

The set's hashes set bits of bitmaps built by Spark (``bitmap_construct_agg``);
the bitmaps together have the size asked for, whatever the data, so they can be
broadcast.  A clear bit proves absence.  A set bit proves nothing, so such rows
still go through an exact join: the filter saves shuffling and changes no result.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.session import cut_lineage

FILTER_MB = 16
_SLICE = 32768  # bits of one bitmap of bitmap_construct_agg


def _bit(key: str, mb: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(mb * 256 * _SLICE))


def with_maybe(rows: DataFrame, key: str, members: DataFrame, mb: int = FILTER_MB) -> DataFrame:
    """``rows`` with a boolean ``_maybe``: false where ``key`` is surely not in column ``key`` of ``members``."""
    # at most 256 rows of 4 KB for each MB; stored, since the callers read the result in two branches
    bits = cut_lineage(members.select(_bit(key, mb).alias("_bit"))
                       .groupBy(F.expr(f"_bit div {_SLICE}").alias("_slice"))
                       .agg(F.bitmap_construct_agg(F.col("_bit") % _SLICE).alias("_bits")))
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast(_bit % {_SLICE} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0
    return (rows.withColumn("_bit", _bit(key, mb)).withColumn("_slice", F.expr(f"_bit div {_SLICE}"))
            .join(F.broadcast(bits), "_slice", "left")
            .withColumn("_maybe", F.coalesce(is_set, F.lit(False))).drop("_slice", "_bit", "_bits"))


def row_key(id_col: str, text_col: str) -> Column:
    """128 hash bits of a row's id and text, null or not: what tells rows apart that share an id or have none."""
    parts = [F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col).cast("string")]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("k1"), F.xxhash64(F.lit(2), *parts).alias("k2"))


def without_rows(rows: DataFrame, key: Column, listed: DataFrame, mb: int = FILTER_MB) -> DataFrame:
    """``rows`` whose ``key`` isn't in ``listed`` (``_key``, ``_one``), or one of them where ``_one`` is true.

    Only rows that may be listed are shuffled.  Column names of ``rows`` that begin with an underscore may clash and
    are carried in a struct.
    """
    listed = cut_lineage(listed)
    marked = with_maybe(rows.select(F.struct("*").alias("_row"), key.alias("_key")), "_key", listed, mb)
    stay = marked.filter(~F.col("_maybe")).select("_row")
    rest = marked.filter("_maybe").join(listed, "_key", "left")
    unlisted = rest.filter("_one is null").select("_row")
    one = rest.filter("_one").dropDuplicates(["_key"]).select("_row")
    return stay.unionByName(unlisted).unionByName(one).select("_row.*")
