"""Exact dedup: 128-bit content hashes, the fullest row stays, bytes compared inside groups.

DataFrame functions only.  Three steps, none of which moves the text of a
document that has no copy:

1. every row's normalised text is hashed (md5, 128 bits) and hashes are counted
   (partial counts per task, so a group of copies of any size is one row per
   task in the shuffle);
2. hashes counted twice or more make a filter of fixed size; a row that it
   excludes has no copy and is answered in place;
3. the other rows are grouped by ``(hash, normalised text)``, so Spark's own
   key equality compares the bytes and two texts that share a hash stay apart,
   and each row takes its group's answer by an equality join on the same pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinity.llm.fixed_filter import FILTER_MB, with_maybe
from vicinity.session import cut_lineage

SEPARATORS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """Text without the characters 0x20 and 0x09-0x0D; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SEPARATORS, "")


def _alone_and_grouped(docs: DataFrame, id_col: str, text_col: str, carry: list[str],
                       filter_mb: int) -> tuple[DataFrame, DataFrame]:
    """Rows without a copy, and the others with ``_keep``, ``_size`` and ``_best``; columns ``carry`` are in ``_row``."""
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("_row"), F.col(f"`{id_col}`").alias("_id"),
        F.char_length(F.coalesce(f"`{text_col}`", F.lit(""))).alias("_chars"),
        normalised(F.col(f"`{text_col}`")).alias("_norm")).withColumn("_h", F.unhex(F.md5("_norm")))
    twice = rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    marked = with_maybe(rows, "_h", twice, filter_mb)

    # both are stored: the copies are read twice, and with a stored side of their groups (one text each) the join below
    # has an exchange on both sides, so the engine can split the partition of a text that many rows repeat
    copies = cut_lineage(marked.filter("_maybe").drop("_maybe"))
    # bitwise_not turns "smallest id" into "largest" without overflow; a null is the smallest value in a struct
    groups = cut_lineage(copies.groupBy("_h", "_norm").agg(
        F.count(F.lit(1)).alias("_size"), F.max(F.struct("_chars", F.bitwise_not("_id").alias("_inv"))).alias("_top")))
    keep = F.bitwise_not("_top._inv")
    grouped = copies.join(groups, ["_h", "_norm"]).select(
        "_row", "_id", "_h", "_norm", "_size", keep.alias("_keep"),
        (F.col("_id").eqNullSafe(keep) & (F.col("_chars") == F.col("_top._chars"))).alias("_best"))
    return marked.filter(~F.col("_maybe")), grouped


def _first_of_repeated() -> Column:
    """Among rows that repeat the best row (same id, same text), one is chosen; any other grouping key is as good."""
    return F.row_number().over(Window.partitionBy("_id", "_h", "_best").orderBy(F.lit(0))) == 1


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 filter_mb: int = FILTER_MB) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows are copies when their texts are equal after deleting white space
    (``[\\x20\\x09-\\x0D]``).  Of the copies, the row with the most code points
    in its original text stays, then the smallest id.

    * null text: the empty text, a copy of other nulls and of all-blank texts;
    * null id: loses every tie against a row with an id;
    * repeated rows (same id, same text): one of them is marked as kept, and they are interchangeable;
    * empty table: no rows; other columns of the input, whatever their names, are not read.

    ``filter_mb`` is the size of the broadcast filter (16 MB: 1.3e8 bits); it bears on speed only.
    """
    alone, grouped = _alone_and_grouped(docs, id_col, text_col, [id_col], filter_mb)
    sha = F.sha2("_norm", 256)
    alone = alone.select(F.col("_id").alias("doc_id"), F.col("_id").alias("keep_id"),
                         F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha.alias("text_sha256"))
    grouped = grouped.select("_id", "_h", "_best", "_keep", "_size", sha.alias("_sha")).select(
        F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_best") & _first_of_repeated()).alias("kept"), F.col("_sha").alias("text_sha256"))
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                filter_mb: int = FILTER_MB) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all their columns; only rows with copies are shuffled."""
    alone, grouped = _alone_and_grouped(docs, id_col, text_col, docs.columns, filter_mb)
    best = grouped.filter("_best").select("_row", _first_of_repeated().alias("_one")).filter("_one")
    return alone.select("_row.*").unionByName(best.select("_row.*"))
