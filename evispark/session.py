"""Session helpers: a local session for tests and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evispark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder (spark.checkpoint.dir). Where it is unset, a local session gets an own one; a cluster, whose tasks can't share this machine's folders, an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif is_local(sc.master):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="evispark-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def is_local(master: str) -> bool:
    """Driver and tasks run in one process."""
    return master.startswith("local") and not master.startswith("local-cluster")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and read it from there; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, unless their path holds it already."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    on_path = str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    beside = is_local(sc.master) and Path.cwd() == root
    if on_path or beside or getattr(sc, "_evispark_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="evispark-package-")) / "evispark.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "evispark").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(target))
    sc._evispark_shipped = True
