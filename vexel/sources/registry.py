"""Catalog of indexes: one folder an index, with its tables and a one-row table of facts about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession

from vexel.plans.options import IndexError_

META = (
    "catalog_name string, schema_name string, index_name string, table_name string, column_name string, key_name string, metric string,"
    " num_dimensions bigint, quantization string, n_probe bigint, seed bigint, is_normalized boolean, rotate boolean, row_group_size bigint,"
    " row_groups bigint, clusters bigint, bytes bigint, created bigint, fingerprint string"
)
INFO = (
    "catalog_name string, schema_name string, index_name string, table_name string, metric string, num_dimensions bigint, quantization string,"
    " n_probe bigint, seed bigint, is_normalized boolean, approx_lower_bound_memory_usage_bytes bigint"
)


class Registry:
    """Indexes under one folder, which may lie in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.entries: dict[str, Row] = {}
        self.load()

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def load(self) -> None:
        """Reads what earlier sessions have left."""
        fs, pattern = self._fs(f"{self.root}/*/meta")
        found = fs.globStatus(pattern)
        paths = [s.getPath().toString() for s in found or ()]
        for row in sorted((self.spark.read.schema(META).parquet(p).first() for p in paths), key=lambda r: (r["created"], r["index_name"])):
            self.entries[row["index_name"].lower()] = row

    def path(self, index: str) -> str:
        return f"{self.root}/{index.lower()}"

    def add(self, meta: dict) -> None:
        row = self.spark.createDataFrame([tuple(meta[f.split()[0]] for f in META.split(", ") for f in [f.strip()])], META)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path(meta['index_name'])}/meta")
        self.entries[meta["index_name"].lower()] = row.first()

    def drop(self, index: str, if_exists: bool = False) -> bool:
        if index.lower() not in self.entries:
            if if_exists:
                return False
            raise IndexError_(f"there is no index '{index}'")
        self.clear(index)
        del self.entries[index.lower()]
        return True

    def clear(self, index: str) -> None:
        fs, place = self._fs(self.path(index))
        fs.delete(place, True)

    def find(self, table: str, column: str, metric: str) -> Row | None:
        """The first made index of the table's column for the metric."""
        for row in self.entries.values():
            if (row["table_name"], row["column_name"].lower(), row["metric"]) == (table.lower(), column.lower(), metric):
                return row
        return None

    def info(self) -> DataFrame:
        names = [f.split()[0] for f in INFO.split(", ")]
        rows = [tuple(r["bytes"] if n.startswith("approx") else r[n] for n in names) for r in self.entries.values()]
        return self.spark.createDataFrame(rows, INFO)
