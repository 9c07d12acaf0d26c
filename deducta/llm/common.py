"""Shared plumbing: the cluster's shared folder, durable stage tables, text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    short_batches(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="deducta-"))
    return context.getCheckpointDir().rstrip("/")


def short_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of so many rows at most: the session's 10,000 whole texts take a worker hundreds of megabytes."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(setting, str(rows))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back (columnar, prunable, durable)."""
    spark = df.sparkSession
    path = path or fresh(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def appended(frames: Iterator[DataFrame], name: str, schema: str) -> DataFrame:
    """The rows of all frames, written one frame after another into one stored table."""
    path = spark = None
    for df in frames:
        spark = df.sparkSession
        path = path or fresh(spark, name)
        df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def utf8(column: str | Column) -> Column:
    """The text's UTF-8 bytes; null counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit("")).cast("binary")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The checkpointed rows, to be broadcast if they are no more than ``most``, and how many they are.

    Beyond that, joins with them shuffle both sides.
    """
    rows = checkpoint(df)
    n = rows.count()
    return (F.broadcast(rows) if n <= most else rows), n


def join_counted(rows: DataFrame, counted: DataFrame, key: str | list[str], least: int = 10_000, most: int = 100_000) -> DataFrame:
    """``rows`` left-joined to ``counted`` (key, n, ...), which has one row a key and how many rows hold it.

    Of the keys of over ``least`` rows, the ``most`` most frequent are sent to every executor, so that no task
    gets all rows of a hot key; the others meet in a shuffle.
    """
    keys = [key] if isinstance(key, str) else key
    ranked = counted.where(F.col("n") > least).orderBy(F.desc("n"), *keys).limit(most)
    hot = checkpoint(ranked.drop("n").withColumn("_hot", F.lit(True)))
    if hot.isEmpty():
        return rows.join(counted.drop("n"), keys, "left")
    met = rows.join(F.broadcast(hot), keys, "left")
    cold = met.where("_hot IS NULL").select(*rows.columns).join(counted.drop("n"), keys, "left")
    return met.where("_hot").drop("_hot").unionByName(cold)


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """``df`` as a stored table in buckets of the keys: joins on all of them do not shuffle it again."""
    spark = df.sparkSession
    n = min(partitions(spark), 100_000)
    table = f"{name}_{uuid.uuid4().hex}"
    rows = df.repartition(n, *keys).write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}")
    rows.bucketBy(n, *keys).saveAsTable(table)
    return spark.table(table)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where a file of the installed public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
