"""Session helpers shared by the operators: lineage cuts, size-checked broadcasts and salts for hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that one task may hold; a key with more is spread over several salts.
HOT_ROWS = 50_000
#: Rows up to which a counted table may be broadcast; beyond it the same join runs as a shuffle.
BROADCAST_ROWS = 20_000


_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only on one machine, as in tests, a temporary one stands in where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        to = spark.conf.get("spark.checkpoint.dir", None)
        if to is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        if to is None:
            to = tempfile.mkdtemp(prefix="canzona-")
        sc.setCheckpointDir(to)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written as a table to the shared folder and read back, so that later steps neither repeat nor lose it."""
    spark = df.sparkSession
    to = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(to)
    df.write.parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def release(spark: SparkSession) -> int:
    """Removes the tables that `cut` has written in this application, once the results that read them are written; how many it were."""
    made = _made.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for to in made:
        path = jvm.org.apache.hadoop.fs.Path(to)
        path.getFileSystem(conf).delete(path, True)
    return len(made)


def few(df: DataFrame, column: str, most: int = 10_000) -> list:
    """The distinct values of a column that is a list of names by its nature, in order; more than `most` are refused, not cut."""
    found = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} values of {column}")
    return found


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted size is within the limit, else df as it is (a shuffle join follows)."""
    return F.broadcast(df) if rows <= limit else df


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """key, salts: the keys with more than hot_rows rows; there are at most count / hot_rows of them."""
    return (
        df.groupBy(key).count().filter(F.col("count") > hot_rows)
        .select(key, F.ceil(F.col("count") / hot_rows).cast("int").alias("salts"))
    )


def salted(df: DataFrame, hot: DataFrame, key: str, spread: Column) -> DataFrame:
    """df with `salt`: 0 for ordinary keys, hash(spread) modulo salts for hot ones."""
    return (
        df.join(hot, key, "left")
        .withColumn("salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("salts")).cast("int")))
        .drop("salts")
    )


def replicated(df: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """df with one row per salt of its key: the other side of a salted join."""
    return (
        df.join(hot, key, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)))
        .drop("salts")
    )
