"""Tables in the folder that all executors share.

A plan that is read more than once, or that a loop makes longer, is written
there and read back, so a lost executor costs its own tasks only.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a local session gets a folder of its own, as in
    tests; a cluster session gets an error, for a machine-local folder would
    not be seen by other executors.
    """
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError(f"{SETTING} must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set(SETTING, folder)
    return folder


def settle(df: DataFrame, name: str, thin: bool = False) -> DataFrame:
    """Write the rows once to the shared folder and read them from there.

    ``thin`` tables have a few numbers for some of the rows (links, pairs, labels);
    an eighth of the usual number of tasks and files is enough for them.
    """
    spark = df.sparkSession
    if thin:
        df = df.coalesce(max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a settled table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
