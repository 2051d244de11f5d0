"""Tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset, a temporary
    folder does on a single machine (as in tests); a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    found = tempfile.mkdtemp(prefix="inventra-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: it cuts
    the lineage, and any executor can read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Removes a stored table that nothing will read any more."""
    spark = table.sparkSession
    jvm = spark.sparkContext._jvm
    for file in table.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
