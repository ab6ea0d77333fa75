"""Lineage cuts that survive the loss of an executor.

Intermediate results go to the folder the cluster names in ``spark.checkpoint.dir``.
Where that is unset (tests, a laptop), a folder of this process takes its place.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else one made for this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="vellum-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return f"file://{_own['dir']}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Columnar, compressed and prunable, unlike ``checkpoint()``. The table is
    dropped when the interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vellum/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone already
        if path.startswith("file:"):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder of files) of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
