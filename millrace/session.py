"""Session helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for an application, so that it need not be installed there."""
    _bound_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(target := f"{folder}/millrace_package.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(target)


def _bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches to Python workers hold at most 8 MB: 10,000 long texts at once would fill an executor's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now <= 0 or now > most:
        spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); a temporary one only where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.gettempdir()
    return f"{at.rstrip('/')}/millrace-{name}-{uuid.uuid4().hex}"


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the package's plans assume: adaptive execution, UTC, Arrow."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
