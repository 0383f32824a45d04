"""Session helpers: a local session for tests and benches, and shipping of the package to Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: dict[str, str] = {}


def local_session(cores: int | str = 8, shuffle: int = 8, app: str = "weftmill") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("WEFTMILL_DRIVER_MEMORY", "6g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors once a context, so that workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"{root.name}/{p.relative_to(root).as_posix()}"), p.read_bytes())
    folder = tempfile.mkdtemp(prefix="weftmill-ship-")
    target = os.path.join(folder, "weftmill.zip")
    with open(target, "wb") as f:
        f.write(buffer.getvalue())
    spark.sparkContext.addPyFile(target)
    _SHIPPED[app] = target
