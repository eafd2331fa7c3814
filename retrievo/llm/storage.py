"""Tables and files that outlive a stage, in the folder that all executors share.

The folder is the cluster's ``spark.checkpoint.dir``; a path without a scheme is one of the default
file system.  Where the setting is missing, a session of this machine only (master ``local``) has a
folder of its own, which goes with the process; any other session is refused, as its executors
would each write to a disk of their own.  A written table cuts lineage: executors lost later cost no
recomputation, and unlike ``checkpoint()`` the plan above it runs once.
"""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="retrievo-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return _own_folder()
    if "://" not in path:
        named = spark._jvm.org.apache.hadoop.fs.Path(path)
        path = named.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(named).toString()
        path = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    return path.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Texts have any length: fewer rows go to Python at once than Spark's default of 10,000."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
