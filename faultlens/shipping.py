"""Bring this package to workers that do not have it on their path."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


@functools.cache
def _archive() -> str:
    """The package as a zip file, which goes when the process ends."""
    folder = tempfile.TemporaryDirectory(prefix="faultlens-package-")
    path = os.path.join(folder.name, "faultlens.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for top, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    _archive.folder = folder
    return path


@functools.cache
def _shipped(application: str) -> list:
    return []


def ship_package(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once; call it before using a Python function."""
    done = _shipped(spark.sparkContext.applicationId)
    if not done:
        spark.sparkContext.addPyFile(_archive())
        done.append(True)
