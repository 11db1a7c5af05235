"""Session factory and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "palaver", cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with adaptive execution, UTC timestamps and Arrow transfer."""
    b = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PALAVER_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for reliable checkpoints, which all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset and the
    master is local is a temporary folder made, which goes with the process; elsewhere an unset
    folder is an error, as a machine-local one would be lost with its executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if named is None:
            named = tempfile.mkdtemp(prefix="palaver-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts the lineage of ``df`` with a reliable checkpoint, see :func:`checkpoint_folder`."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=eager)
