"""Cut lineage by writing an intermediate table to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Temporary folders of local sessions without the setting, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one only on a local master (tests)."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return _LOCAL[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing was written to yet."""
    return f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    The result has no lineage beyond the files, so it survives lost executors
    and is computed once however often it is read.  ``instead_of``: the stashed
    table of the round before, whose files go once the new ones are written; no
    other table that is still to be computed may read it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if instead_of is not None:
        old = spark._jvm.org.apache.hadoop.fs.Path(instead_of.stashed_at)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def resumed(spark: SparkSession, run: str, step: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a named step of a named run: made and written once, only read if it was finished before.

    A step that was cut off left no mark of success and is made again, so a run that
    is started anew under its name goes on after its last finished step.
    """
    path = f"{shared_dir(spark)}/graphloom/runs/{run}/{step}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
