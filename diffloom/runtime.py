"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder shared by all executors that spark.checkpoint.dir names.

    Only where the cluster names none and the master is local (tests) a folder of
    this machine is taken.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="diffloom-checkpoint-")
        sc.setCheckpointDir(named)
    return named


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_FOLDERS: dict[str, str] = {}


def _run_folder(spark: SparkSession) -> str:
    """A folder of this application, removed with all tables in it when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = folder = f"{_shared_folder(spark)}/diffloom-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, folder)
    return _FOLDERS[app]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df as a table into the shared folder and read it back: it survives a lost executor.

    A written table also has known sizes, so that the optimizer can choose joins by them,
    and is read by columns. It is dropped when the application ends.
    """
    spark = df.sparkSession
    path = f"{_run_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows of keys or numbers that are broadcast.
BROADCAST_ROWS = 200_000


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most so many rows; it is read only so far."""
    return df.limit(rows + 1).count() <= rows


def semi_join(df: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose keys occur in keys_of, which is broadcast only if counted to be small."""
    wanted = keys_of.select(*keys)
    return df.join(F.broadcast(wanted) if few(wanted) else wanted, keys, "left_semi")
