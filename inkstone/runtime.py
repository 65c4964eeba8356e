"""Session-level helpers: table access, the shared folder, and lineage cuts.

Intermediate tables that are read more than once are written as Parquet to the
folder that the cluster names in ``spark.checkpoint.dir``.  All executors share
that folder, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables.

    ``spark.checkpoint.dir`` of the session wins.  Only a local session without
    that setting (tests, notebooks) gets a temporary folder; on a cluster the
    missing setting is an error, for a machine-local folder would not survive
    the loss of its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; name a folder that all executors share")
    if not _LOCAL_DIRS:
        _LOCAL_DIRS.append(tempfile.mkdtemp(prefix="inkstone-"))
        atexit.register(shutil.rmtree, _LOCAL_DIRS[0], True)
    return _LOCAL_DIRS[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkstone-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Delete every intermediate table that this application wrote."""
    root = f"{shared_dir(spark)}/inkstone-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staging() -> str:
    """Folder from which the driver serves files to the executors as long as it lives."""
    if not _STAGING:
        _STAGING.append(tempfile.mkdtemp(prefix="inkstone-files-"))
        atexit.register(shutil.rmtree, _STAGING[0], True)
    return _STAGING[0]


_STAGING: list[str] = []
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, unless they inherit a path to it."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    if sc.applicationId in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(staging(), "inkstone.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((root / "inkstone").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fit_parallelism(df: DataFrame, least: int | None = None) -> DataFrame:
    """Split a scan that arrives in fewer partitions than the cluster has cores.

    One small file gives one scan task; work in Python behind it would then use
    one core.  The move is by round robin, so no key can make it uneven.  Only
    for plain scans: behind a shuffle the question alone would run the shuffle.
    """
    want = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
