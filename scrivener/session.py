"""Session helpers.

On a cluster the session is created by the platform; we only read its
settings.  ``get_session`` is for tests, benches and local runs: it sets
defaults only where nothing is configured yet.
"""

from __future__ import annotations

import os
import shlex
import tempfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

# Defaults for a local session.  A cluster session keeps its own values.
LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def _given() -> set[str]:
    """Settings the user gave already: under spark-submit those of the running
    JVM, otherwise those of PYSPARK_SUBMIT_ARGS."""
    if "PYSPARK_GATEWAY_PORT" in os.environ:
        SparkContext._ensure_initialized()
        return {k for k, _ in SparkConf().getAll()}
    args = shlex.split(os.environ.get("PYSPARK_SUBMIT_ARGS", ""))
    named = {"--master": "spark.master", "--driver-memory": "spark.driver.memory"}
    keys = {args[i + 1].split("=", 1)[0] for i, a in enumerate(args[:-1]) if a in ("--conf", "-c")}
    return keys | {named[a] for a in args if a in named}


def get_session(master: str | None = None, app: str = "scrivener", **conf: str) -> SparkSession:
    """The active session, or a new one: ``conf`` and ``master`` as asked for,
    the local defaults only where the user set nothing."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    given = _given()
    for key, value in {**{k: v for k, v in LOCAL_DEFAULTS.items() if k not in given}, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; we use it as is.  Only when the
    setting is missing in a local session do we make a scratch folder; on a
    cluster the executors would each write to a disk of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="scrivener-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    try:
        spark.sparkContext.setCheckpointDir(path)
    except Exception:  # noqa: BLE001 - no SparkContext on a Spark Connect session
        pass
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name) if "://" not in base else base.rstrip("/") + "/" + name
