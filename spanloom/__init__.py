"""Spark-native interval, sequence and text dataflow engine."""

from __future__ import annotations

import os
import tempfile
import zipfile

_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(home):  # a package that was itself shipped is on every worker's path already
        path = os.path.join(tempfile.mkdtemp(prefix="spanloom-"), "spanloom.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(home):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("spanloom", os.path.relpath(full, home)))
        sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
