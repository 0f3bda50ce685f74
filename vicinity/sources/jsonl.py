"""JSON-lines corpus source (S1) and label-name dictionary source.

The corpus format is one JSON object per line, gzip-compressed, latin-1
encoded, with ``title``, ``content`` and ``target_ind``; a ``uid`` of any kind
is carried along, other fields are ignored.  The row id is the 0-based line
number.  The label-name file has one name per line; the label id is the
0-based line number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinity.session import cut_lineage

CORPUS_SCHEMA = "uid string, title string, content string, target_ind array<int>"
LATIN1 = "ISO-8859-1"


def read_jsonl_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(pid, uid, title, text, labels)``; ``pid`` is the line number over the files in name order.

    An explicit schema (no inference pass) and ``lineSep`` are required for non-UTF-8 JSON in Spark.  Lines are
    numbered within each split by the scan and shifted by the sizes of the splits before (one row per split).  The
    numbered scan is stored, so counting and shifting see the same splits.
    """
    df = cut_lineage(spark.read.schema(CORPUS_SCHEMA).option("encoding", LATIN1).option("lineSep", "\n").json(path)
          .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
                  F.monotonically_increasing_id().alias("_n")))
    splits = df.groupBy("_file", "_at").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    shift = splits.select("_file", "_at", (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return df.join(F.broadcast(shift), ["_file", "_at"]).select(
        (F.col("_n") + F.col("_shift")).alias("pid"), "uid", "title", F.col("content").alias("text"),
        F.col("target_ind").alias("labels"))


def write_jsonl_corpus(df: DataFrame, path: str) -> None:
    """Write ``([uid,] title, text, labels)`` in the corpus format (gzip, latin-1).

    Characters that latin-1 lacks are written as JSON escapes, so every text comes back as it was.
    """
    uid = [F.col("uid").cast("string").alias("uid")] if "uid" in df.columns else []
    (df.select(*uid, "title", F.col("text").alias("content"), F.col("labels").alias("target_ind"))
     .write.mode("overwrite").option("encoding", LATIN1).option("lineSep", "\n")
     .option("writeNonAsciiCharacterAsCodePoint", "true").option("compression", "gzip").json(path))


def read_label_names(spark: SparkSession, path: str) -> DataFrame:
    """``(label_id, name)`` from a latin-1 text file, id = 0-based line number.

    White space at both ends of the file is dropped and lines end with LF, CR LF or CR.  The file is read whole (it
    holds one line per label, bounded by the label count), so line numbers are exact.
    """
    raw = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select(F.decode("content", LATIN1).alias("t"))
    whole = F.regexp_replace("t", r"^\s+|\s+$", "")
    lines = raw.select(F.posexplode(F.split(whole, "\r\n|\n|\r")).alias("label_id", "name"))
    return lines.select(F.col("label_id").cast("int"), "name")


def write_label_names(names: DataFrame, path: str) -> None:
    """One name per line in ``label_id`` order, in latin-1; a name with other characters is an error.

    The rows (one per label) are sorted into a single file, since the line number is the id.
    """
    latin = F.decode(F.encode("name", LATIN1), LATIN1)
    value = F.when(latin.eqNullSafe(F.col("name")), F.col("name")).otherwise(
        F.raise_error(F.concat(F.lit("not a latin-1 label name: "), F.coalesce("name", F.lit("null")))))
    none = "\u0000"
    (names.select("label_id", value.alias("name")).repartition(1).sortWithinPartitions("label_id").select("name")
     .write.mode("overwrite").option("encoding", LATIN1).option("lineSep", "\n").option("sep", none).option("quote", none)
     .option("escape", none).option("emptyValue", "").option("ignoreLeadingWhiteSpace", "false")
     .option("ignoreTrailingWhiteSpace", "false").csv(path))
