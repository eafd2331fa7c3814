"""Tables written in the middle of a job: read by several later steps, and safe from lost executors.

They go to the folder that the cluster names in ``spark.checkpoint.dir``; only a session of one machine
(master ``local``) without that setting has a folder of its own, which goes with the process.
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


def folder(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back with the same schema."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its input is so small that the scan gives fewer tasks than there are (one file, say)."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks, unit = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.files.maxPartitionBytes", "128m").lower().rstrip("b")
    bytes_ = int(unit[:-1]) << {"k": 10, "m": 20, "g": 30}[unit[-1]] if unit[-1] in "kmg" else int(unit)
    return df.repartition(tasks) if size < tasks * bytes_ else df


_KEPT: dict[tuple, tuple] = {}


def once(key: DataFrame, what: tuple, make):
    """``make()``, or what it returned for the same plan over the same files in this session.

    ``make`` returns a tuple of DataFrames over written tables.  Files are told by name and total size.
    """
    spark = key.sparkSession
    # the plan's own hash leaves attribute ids out; file names change when a table is written again
    size = str(key._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    found = (spark.sparkContext.applicationId, key.semanticHash(), hash(tuple(sorted(key.inputFiles()))), size, what)
    if not key.inputFiles():  # not from files: nothing says that it is the same again
        return make()
    if found not in _KEPT:
        _KEPT[found] = make()
    return _KEPT[found]
