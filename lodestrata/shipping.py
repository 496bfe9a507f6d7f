"""The package on executors that have no copy of it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package as a zip, once for each application; workers
    that have a copy on their path do as well with it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = Path(__file__).parent
    packed = Path(tempfile.mkdtemp(prefix="lodestrata-")) / "lodestrata.zip"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, f"{here.name}/{p.relative_to(here)}")
    sc.addPyFile(str(packed))
