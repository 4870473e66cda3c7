"""Sends this package to the executors, which need not have it installed."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import folio

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the session's Python files, once an application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(folio.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="folio-")) / "folio.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, str(source.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(target))
    _sent.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
