"""Session factory: ANSI arithmetic, UTC, adaptive execution."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults. On a cluster leave master unset and size shuffles there."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh URI in the folder that driver and executors share, spark.checkpoint.dir; a local one only for local sessions."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="quern-"))
            atexit.register(shutil.rmtree, _own[0].removeprefix("file://"), ignore_errors=True)
        base = _own[0]
    if "://" not in base and base.startswith("/"):
        base = "file://" + base
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
