"""Spark session with the settings the engine is written for."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "vicinal", master: str | None = None, **conf: str) -> SparkSession:
    """The active session, or a new one. ``conf`` keys may use ``__`` for dots; a running session keeps its own settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the session's Python workers, once, so that they can import it wherever they start."""
    sc = spark.sparkContext
    if not getattr(sc, "_vicinal_shipped", False):
        body, package = io.BytesIO(), Path(__file__).parent
        with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(package.rglob("*.py")):
                z.writestr(zipfile.ZipInfo(f"{package.name}/{path.relative_to(package)}"), path.read_bytes())
        name = f"vicinal-{hashlib.sha256(body.getvalue()).hexdigest()[:16]}.zip"
        local = os.path.join(tempfile.gettempdir(), name)  # the driver's copy, from which Spark serves every executor
        if not os.path.exists(local):
            Path(f"{local}.{os.getpid()}").write_bytes(body.getvalue())
            os.replace(f"{local}.{os.getpid()}", local)
        sc.addPyFile(local)
        sc._vicinal_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; in local mode without it, a temporary one."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_vicinal_folder", None)
    if not shared:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = sc._vicinal_folder = tempfile.mkdtemp(prefix="vicinal-")
    return shared.rstrip("/")
