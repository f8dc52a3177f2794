"""What a session needs before Python code of this package runs on executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches stay small, so that Python workers need little memory whatever a row's size.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


#: Marks a session whose batch sizes are set.
MARK = "spark.linkloom.batches"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a SparkContext, and set batch sizes, once a session."""
    if spark.conf.get(MARK, None) is None:
        for key, value in BATCH.items():
            spark.conf.set(key, value)
        spark.conf.set(MARK, "set")
    sc = spark.sparkContext
    if getattr(sc, "_linkloom_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "linkloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("linkloom", os.path.relpath(full, top)))
    sc.addPyFile(path)
    sc._linkloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session on one machine has none (tests), a local one is made, set and deleted
    when Python ends; a cluster without the setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        own = tempfile.mkdtemp(prefix="linkloom-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it is read from fewer files than there are cores.

    A file of one row group is one task's work whatever its size. Tables of many files, that is
    all large ones, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage: what follows survives lost executors by re-reading the files. The folder gets
    no _SUCCESS marker: nobody looks for it, and on a local file system the driver starts helper
    processes for each file it makes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._linkloom_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_linkloom_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
