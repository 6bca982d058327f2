"""Session settings the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(app: str = "rillstat", cores: int | None = None, **conf: str) -> SparkSession:
    """A session for tests, benches and notebooks: the running one as it is, else a new one with the defaults and ``conf``."""
    running = SparkSession.getActiveSession()
    if running is not None:
        return running
    builder = SparkSession.builder.appName(app)
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores))
    for k, v in {**_DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``, set for the session if it isn't yet.

    Where the setting is missing, a local master (tests) gets a temporary folder;
    on a cluster that is an error, as executors don't share one.
    """
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if not now.isEmpty():
        return now.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "rillstat-checkpoints")
    sc.setCheckpointDir(folder)
    return folder
