"""What the operators of this subpackage share: tables, staging, scratch column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of every scratch column, so that a caller's own columns never clash.
P = "__sl_"

#: Words are runs of anything but these six ASCII white-space characters.
ASCII_SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (read by Spark, so any store will do)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset in local mode (tests), a temporary folder is set once per session; on a
    cluster it is an error, as other machines wouldn't see such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='scenelake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the existing ``path`` deleted when the driver ends, as its readers then have ended too."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut and the rows,
    with any partition ids or row ids among them, are fixed for all later readers."""
    spark = df.sparkSession
    path = own_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    delete_at_end(spark, path)
    return kept


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a table that :func:`staged` wrote and that no plan needs any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/staged/" in path:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def total_chars(docs: DataFrame, text_col: str) -> int:
    """Characters in all texts; one row reaches the driver."""
    return docs.agg(F.coalesce(F.sum(F.length(text_col).cast("long")), F.lit(0))).first()[0]
