"""Session settings.  On a cluster the caller's session is used as it is."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "webplan", cores: str = "8") -> SparkSession:
    """A session for tests and local benchmarks only."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for files all executors see; in local tests a scratch one.

    Executors of a cluster do not see each other's disks, so without a shared folder it is an error there."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master or ""
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-files-", dir="/tmp")


def checkpoint_ready(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, in the shared folder unless the session has set another."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))


def ship_package(spark: SparkSession) -> None:
    """Give every executor this package, once per session, for the functions that run in Python there."""
    sc = spark.sparkContext
    if not any("webplan_package" in f for f in sc.listFiles):
        here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.join(tempfile.mkdtemp(prefix="webplan-"), "webplan_package")
        sc.addPyFile(shutil.make_archive(name, "zip", here, "webplan"))


def settle(df: DataFrame) -> DataFrame:
    """Compute a table once that several later branches read, and cut its lineage.

    Without it every branch would plan and run the whole extraction again.  The rows go to the
    checkpoint folder, so losing an executor does not lose them."""
    if getattr(df, "_settled", False):
        return df
    checkpoint_ready(df.sparkSession)
    done = df.checkpoint()
    done._settled = True
    return done
