"""A session with the settings the operators assume, and the package on its executors."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(app: str = "tapeweave", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` adds settings."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once per application.

    Operators with Python steps need it on every executor, also on those that
    start later.  The driver serves the archive from its own file folder, so
    neither an installation nor a shared path is needed.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = Path(SparkFiles.getRootDirectory()) / "packed"
    os.makedirs(folder, exist_ok=True)
    archive = folder / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
