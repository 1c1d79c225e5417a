"""Making the package known to Python workers on machines that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import lru_cache, wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _archive() -> str:
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="triagelake-code-"), "triagelake_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    return path


_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        spark.sparkContext.addPyFile(_archive())
        _sent.add(app)


def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run
