"""Sends the package to the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application, so that functions of this package can run on executors that don't have it."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).parent
    to = Path(tempfile.mkdtemp(prefix="gridloom-code-")) / "gridloom.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(to))
    _sent.add(app)


def shipped(query):
    """The query, with the package sent first."""

    @wraps(query)
    def run(spark, *args):
        ship(spark)
        return query(spark, *args)

    return run
