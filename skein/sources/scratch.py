"""The shared folder for tables and files that a run writes: ``spark.checkpoint.dir``, or on one machine a folder of this process."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see; an error on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return f"file://{_own['dir']}"


def hadoop(spark: SparkSession, path: str) -> tuple:
    """File system and path object of ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fresh(spark: SparkSession, tag: str) -> str:
    """A path that does not exist yet; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/skein/{tag}-{uuid.uuid4().hex}"
    files, p = hadoop(spark, path)
    files.deleteOnExit(p)
    return path
