"""Record files as a stream: each file of a folder is whole records, decoded as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decoders import Reading
from ..layout import Layout
from ..operators import extract


def stream_records(spark: SparkSession, folder: str, record_length: int) -> DataFrame:
    """(path, rec_no, rec) of fixed-length files as they appear. A file is one task, so files should be of moderate size."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    numbers = F.expr(f"sequence(0L, length div {record_length} - 1, 1L)")
    whole = F.when(F.col("length") % record_length == 0, numbers).otherwise(F.raise_error(F.concat(F.lit("not whole records: "), F.col("path"))).cast("array<long>"))
    rows = files.where("length > 0").select("path", "content", F.explode(whole).alias("rec_no"))
    return rows.select("path", "rec_no", F.expr(f"substring(content, cast(rec_no * {record_length} + 1 as int), {record_length})").alias("rec"))


def stream_decoded(spark: SparkSession, folder: str, layout: Layout, reading: Reading = Reading()) -> DataFrame:
    return extract.decode(stream_records(spark, folder, layout.record_length()), layout, reading, keep=("path", "rec_no"))
