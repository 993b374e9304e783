"""FASTA in and out as DataFrames."""

from __future__ import annotations

import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S
from ..runtime import numbered


def read(spark: SparkSession, path: str, ordered: bool = True) -> DataFrame:
    """(rec_no, header, seq) of the records of a FASTA file, folder or glob; "-" reads standard input once.

    The file is split at line starts that begin with ">", so it is read in parallel. The header is
    the whole line without any ">"; sequences are upper case with A, C, G and T only. Empty records
    are kept, but not one at the end of its file. A sequence before the first header is an error.
    Without ordered, rec_no is left out and so is the sort that makes it.
    """
    if path == "-":
        with tempfile.NamedTemporaryFile("w", suffix=".fasta", delete=False) as spool:
            spool.write(sys.stdin.read())
        path = f"file://{spool.name}"
    raw = spark.read.option("lineSep", "\n>").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    line = F.substring_index(F.col("value"), "\n", 1)
    header = F.regexp_replace(line, r"[>\r]", "")
    sequence = F.when(F.instr("value", "\n") > 0, S.sanitize(F.expr("substr(value, instr(value, '\n') + 1)"))).otherwise("")
    ends = raw.groupBy("file").agg(F.min(F.struct("block", "at")).alias("head"), F.max(F.struct("block", "at")).alias("tail"))
    here = F.struct("block", "at")
    rows = raw.join(F.broadcast(ends), "file")  # a row for each file
    lead = (here == F.col("head")) & ~F.col("value").startswith(">")
    stray = lead & (S.sanitize(F.col("value")) != "") & (here != F.col("tail"))
    is_record = F.when(stray, F.raise_error(F.lit("a sequence comes before the first header")).cast("boolean")).otherwise(~lead)
    rows = rows.where(is_record).select("file", "block", "at", header.alias("header"), sequence.alias("seq"), (here == F.col("tail")).alias("last"))
    rows = rows.where((F.col("seq") != "") | ~F.col("last")).drop("last")
    return numbered(rows, "file", "block", "at").select("rec_no", "header", "seq") if ordered else rows.select("header", "seq")


def write(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes (header, seq) records as FASTA text files."""
    records.select(F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("value")).write.mode(mode).text(path)
