"""Session factory with the settings the engine expects."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[8]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session with ANSI mode, adaptive execution and UTC; a cluster overrides what it needs."""
    conf = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, so that workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_inkstone_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()  # the driver serves the file as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, "inkstone.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._inkstone_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one stands in for it only where all run on one machine.

    Raises RuntimeError on a cluster whose session names no ``spark.checkpoint.dir``.
    """
    conf = spark.sparkContext.getConf()
    if named := conf.get("spark.checkpoint.dir", ""):
        return named
    if not conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "/tmp/checkpoints"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder; Spark removes it with the last reference."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
