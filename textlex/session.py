"""Sending this package to a session's executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Once for each application: Python workers then find this package wherever they run. The driver serves the archive."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        root = Path(__file__).parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/textlex", "zip", root.parent, root.name)
        context.addPyFile(archive)
        _sent.add(context.applicationId)
