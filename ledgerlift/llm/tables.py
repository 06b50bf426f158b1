"""Reading the driver's tables, bounded samples, and cutting lineage in a folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bytes of an Arrow batch of texts, on either side of a Python worker.
BATCH_BYTES = 4 << 20


def _bound(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _bound(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names. Only a local session without one gets a temporary folder."""
    _bound(spark)
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that all of them see")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp())
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder: smaller than a checkpoint, and later reads are pruned."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sample(docs: DataFrame, keys: DataFrame, most: int, most_bytes: int, *columns: str) -> list:
    """Rows (text, *columns) of ``docs`` for the ``most`` of ``keys`` (doc_id) with the least hash, in its order: the same for every partitioning.

    One row of each doc_id, the least. Texts are whole; the one that reaches ``most_bytes`` in all is the last one.
    """
    order = F.xxhash64("doc_id"), F.col("doc_id")
    kept = keys.where("doc_id is not null").select("doc_id").distinct().orderBy(*order).limit(most)
    one = docs.where("text is not null").join(F.broadcast(kept), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", *columns)).alias("x"))
    before = F.sum(F.octet_length("x.text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))  # over at most ``most`` rows
    return one.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < most_bytes).orderBy(*order).select("x.*").collect()
