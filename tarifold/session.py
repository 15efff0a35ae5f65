"""The package's way to the Python workers."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def _archive() -> bytes:
    root = os.path.dirname(os.path.abspath(__file__))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for at, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    archive.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), os.path.dirname(root)))
    return out.getvalue()


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder of spark.checkpoint.dir; a temporary one, removed at exit, only where that is unset on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tarifold-")
        atexit.register(shutil.rmtree, shared, True)
    return f"{shared.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application.

    Functions that run in Python workers are pickled by reference, so the
    workers must be able to import the package wherever the driver was started.
    The archive lies in the shared folder of spark.checkpoint.dir.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    target = context._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark, 'code')}/tarifold.zip")
    stream = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
    stream.write(_archive())
    stream.close()
    context.addPyFile(target.toString())
    _shipped.add(context.applicationId)
