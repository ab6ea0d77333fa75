"""A versioned chunk table on plain Parquet: each change is a new version, published at once."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Versions of one table below a folder; the file CURRENT names the one that holds.

    Readers see one version throughout. A version is written and checked before the pointer moves; a failure
    leaves the old one in place.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def current(self) -> str | None:
        """The folder of the version that holds; None before the first."""
        fs, p = self._fs(f"{self.root}/CURRENT")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()

    def open(self) -> DataFrame:
        """[SRC5] The table as it is; an error that says what to do where there is none."""
        at = self.current()
        if at is None:
            raise FileNotFoundError(f"no table below {self.root}: build the index first")
        return self.spark.read.parquet(f"{self.root}/{at}")

    def publish(self, df: DataFrame, checks: dict[str, F.Column] | None = None) -> int:
        """[SRC4, IDX2] Write ``df`` as the next version, check it and let it hold; gives its number of rows.

        ``checks``: a condition that no row may meet, by name. An empty table is refused.
        """
        name = f"version-{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        new = self.spark.read.parquet(path)
        counts = new.agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"c{i}") for i, c in enumerate((checks or {}).values())]).first()
        failed = [k for i, k in enumerate(checks or {}) if counts[f"c{i}"]]
        if not counts["n"] or failed:
            fs, p = self._fs(path)
            fs.delete(p, True)
            raise ValueError("refused: " + ("no rows" if not counts["n"] else ", ".join(failed)))
        self._point(name)
        return counts["n"]

    def _point(self, name: str) -> None:
        fs, tmp = self._fs(f"{self.root}/.CURRENT-{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(name.encode()))
        out.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        array = self.spark.sparkContext._gateway.new_array(options, 1)
        array[0] = options.OVERWRITE
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(tmp, self._fs(f"{self.root}/CURRENT")[1], array)

    def append(self, rows: DataFrame) -> int:
        """[SRC7] A version with ``rows`` added; no rows are refused."""
        if rows.isEmpty():
            raise ValueError("refused: no rows")
        return self.publish(self.open().unionByName(rows))

    def replace(self, rows: DataFrame, scope: DataFrame) -> int:
        """[SRC8] A version in which ``rows`` take the place of all rows of the paths in ``scope``."""
        return self.publish(merged(self.open(), rows, scope))

    def remove(self, scope: DataFrame) -> int:
        """[SRC9] A version without the rows of the paths in ``scope``."""
        return self.publish(without_paths(self.open(), scope))

    def compact(self, files: int) -> str | None:
        """[SRC10] Rewrite the table in ``files`` files; a failure is told, not raised."""
        try:
            self.publish(self.open().repartition(files))
        except Exception as e:  # an index that isn't compact still serves
            return str(e)
        return None


def merged(target: DataFrame, rows: DataFrame, scope: DataFrame, path: str = "source_path", key: str = "chunk_id") -> DataFrame:
    """[SRC8] MERGE on plain tables: rows of ``rows`` replace those of their key, are added where there is none; other rows of the scope go.

    ``scope`` (column ``path``): null paths are in no scope. Rows outside of it whose key comes anew are replaced too.
    """
    kept = target.join(scope.select(path).distinct(), path, "left_anti").join(rows.select(key), key, "left_anti")
    return kept.select(target.columns).unionByName(rows.select(target.columns))


def without_paths(target: DataFrame, scope: DataFrame, path: str = "source_path") -> DataFrame:
    """[SRC9] Rows whose path isn't in ``scope``; rows without path stay."""
    return target.join(scope.select(path).distinct(), path, "left_anti").select(target.columns)


def write_json_atomically(value: dict, path: str) -> None:
    """[SRC16] A small JSON file on the driver's disk, replaced at once."""
    tmp = f"{path}.{uuid.uuid4().hex}"
    try:
        with open(tmp, "w", encoding="utf-8") as f:
            json.dump(value, f, indent=2, sort_keys=True, ensure_ascii=False)
        os.replace(tmp, path)
    finally:
        if os.path.exists(tmp):
            os.unlink(tmp)
