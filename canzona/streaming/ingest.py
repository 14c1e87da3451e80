"""Incremental ingestion: works that arrive as a stream are indexed once, whatever is delivered again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canzona.functions import encode as E
from canzona.operators import index as I


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def add_batch(batch: DataFrame, batch_id: int, target: str, lengths=E.LENGTHS, encodings=E.INDEXED) -> None:
    """Appends the new works of a batch and their postings under target, each batch in a folder of its own.

    A batch that is run again after a failure overwrites its own folder and nothing else.
    """
    spark = batch.sparkSession
    known = _stored(spark, f"{target}/works", "stratum string, ext_id string, doc_id bigint, batch bigint").filter(F.col("batch") != batch_id)
    fresh = I.add_works(known, batch)
    fresh.select("stratum", "ext_id", "doc_id").write.mode("overwrite").parquet(f"{target}/works/batch={batch_id}")
    I.postings(fresh, lengths, encodings).write.mode("overwrite").parquet(f"{target}/postings/batch={batch_id}")


def start(stream: DataFrame, target: str, checkpoint: str, **how):
    """The running query; figures are recounted from all postings when asked for."""
    return stream.writeStream.foreachBatch(lambda b, i: add_batch(b, i, target, **how)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def figures(spark: SparkSession, target: str) -> DataFrame:
    return I.figures(spark.read.parquet(f"{target}/postings"))
