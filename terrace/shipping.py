"""Prepares a session: the package importable in Python workers, and generated code that the JVM compiles."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of generated code beyond which Spark splits a stage's expressions into methods of their own, and Spark's own setting.
#: The JVM never compiles a method of more than 8000 bytes; such a stage is interpreted and many times slower.
METHOD_LIMIT, METHOD_LIMIT_UNSET = "8000", "65535"


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the executors once per application, so that tasks can import it wherever the driver was started."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == METHOD_LIMIT_UNSET:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", METHOD_LIMIT)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="terrace-")) / f"{root.name}.zip"
    with zipfile.ZipFile(bundle, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(bundle))
    _shipped.add(context.applicationId)
