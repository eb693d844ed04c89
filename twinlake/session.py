"""Session helpers: tables by name, and lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Rows up to which a lookup table may be broadcast after it was counted.
SMALL_ROWS = 50_000


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session: they may run where it isn't installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="twinlake-package-"), "twinlake.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in sorted(os.walk(here)):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(here)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder as a DataFrame."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in ``spark.checkpoint.dir``; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="twinlake-checkpoint-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a ``cut`` that nothing reads any more; other frames are left alone."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRDD" or not plan.rdd().getCheckpointFile().isDefined():
        return
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(plan.rdd().getCheckpointFile().get())
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; at most one row more is looked at."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint where its counted size allows; else as it is, for a shuffled join."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if is_small(df, rows) else df
