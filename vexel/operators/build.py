"""Building a clustered index with Spark and Arrow.

Tables of an index: ``row_groups`` (row_group_id, n, clusters, q_base, q_scale), ``centroids`` (row_group_id, cluster_id,
n, centroid) and ``codes`` (row_group_id, cluster_id, row_id, q_base, q_scale, code), sorted by row group and cluster so
that Parquet statistics prune by both. Base rows are never copied.

A pass takes counts and ranges by row group; a bounded sample of each row group trains its centroids; a streaming pass
assigns and encodes all rows, holding one row group's centroids and one batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.operators import kernels
from vexel.plans.options import MAX_DIMENSIONS, IndexError_, IndexOptions, cluster_count

#: Share of a row group's rows that train its centroids, rows from which only this share is used, and bytes at most.
SAMPLE, ALL_BELOW, SAMPLE_BYTES = 0.3, 30_720, 512 << 20
#: Rows of a Parquet page of codes, so that readers skip the pages of clusters that aren't probed.
PAGE_ROWS = 512
#: Columns of the table of codes; given to readers, it saves them a look at the files.
CODES = "row_group_id long, cluster_id int, row_id long, q_base double, q_scale double, code binary"


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(np.float32, copy=False)


def facts(base: DataFrame) -> dict:
    """Facts of base (row_id, vec): n rows with a vector, low and high length, first and last key; checks lengths and keys."""
    size = F.size("vec")
    row = base.where("vec IS NOT NULL").agg(
        F.count(F.lit(1)).alias("n"), F.min(size).alias("low"), F.max(size).alias("high"), F.max(F.exists("vec", lambda x: x.isNull())).alias("holes"),
        F.min("row_id").alias("first"), F.max("row_id").alias("last"), F.count("row_id").alias("keys"),
    ).first()
    if not row["n"]:
        raise IndexError_("an index can't be made on an empty table")
    if row["keys"] < row["n"] or row["first"] < 0:
        raise IndexError_("keys must be neither NULL nor negative")
    if row["low"] != row["high"]:
        raise IndexError_(f"vectors differ in length: {row['low']} to {row['high']}")
    if row["holes"]:
        raise IndexError_("vectors must not hold NULL components")
    if row["high"] > MAX_DIMENSIONS:
        raise IndexError_(f"the length of indexed vectors must be at most {MAX_DIMENSIONS}, got {row['high']}")
    if row["high"] == 0:
        raise IndexError_("indexed vectors must not be empty")
    if not base.where("vec IS NOT NULL").groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise IndexError_("keys must be unique")
    return row.asDict()


def row_group(found: dict, size: int) -> Column:
    """Row group of a key: ranges of keys where these are dense; where they leave gaps, groups of about ``size`` rows by hash."""
    groups = -(-found["n"] // size)
    if found["last"] // size - found["first"] // size + 1 <= 2 * groups + 1:
        return F.expr(f"row_id div {size}")
    return F.pmod(F.xxhash64("row_id"), F.lit(groups)).cast("long")


def row_group_facts(rows: DataFrame, options: IndexOptions) -> DataFrame:
    """row_groups from rows (row_group_id, row_id, vec)."""
    metric, seed, rotate = options.metric.value, options.seed, options.rotate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("row_group_id").to_numpy()
            x = kernels.prepared(matrix(batch.column("vec")), metric, seed, rotate)
            names, at = np.unique(group, return_inverse=True)
            low, high = np.full(len(names), np.inf), np.full(len(names), -np.inf)
            np.minimum.at(low, at, x.min(1))
            np.maximum.at(high, at, x.max(1))
            first = np.full(len(names), np.iinfo(np.int64).max)
            np.minimum.at(first, at, batch.column("row_id").to_numpy())
            columns = [pa.array(c) for c in (names, np.bincount(at).astype(np.int64), low, high, first)]
            yield pa.RecordBatch.from_arrays(columns, names=["row_group_id", "n", "low", "high", "first"])

    parts = rows.mapInArrow(run, "row_group_id long, n long, low double, high double, first long")
    found = parts.groupBy("row_group_id").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"))
    rule = F.when(F.col("n") < 2048, 1).when(F.col("n") < 30_720, cluster_count(2048)).otherwise(cluster_count(30_720))
    wanted = rule if options.clusters_per_row_group is None else F.least(F.lit(options.clusters_per_row_group).cast("long"), F.col("n"))
    u8 = options.quantization.value == "u8"
    base = F.col("low") if u8 else F.lit(0.0)
    scale = F.when(F.col("high") > F.col("low"), F.lit(float(kernels.MAX_CODE)) / (F.col("high") - F.col("low"))).otherwise(F.lit(1.0)) if u8 else F.lit(1.0)
    return found.select("row_group_id", "n", "first", wanted.cast("int").alias("clusters"), base.alias("q_base"), scale.alias("q_scale"))


def train(rows: DataFrame, groups: DataFrame, dimensions: int, options: IndexOptions) -> DataFrame:
    """row_group_id, cluster_id, centroid (prepared vectors)."""
    metric, seed, rotate = options.metric.value, options.seed, options.rotate
    most = max(1, SAMPLE_BYTES // (4 * dimensions))
    place = F.pmod(F.xxhash64(F.lit(seed), "row_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.least(F.when(F.col("n") < ALL_BELOW, F.lit(1.0)).otherwise(F.lit(SAMPLE)), F.lit(float(most)) / F.col("n"))
    # one vector suffices where there is one cluster
    share = F.when(F.col("clusters") == 1, F.least(F.lit(1.0), F.lit(64.0) / F.col("n"))).otherwise(share)
    sample = rows.join(groups.select("row_group_id", "n", "first", "clusters"), "row_group_id").where((place < share) | (F.col("row_id") == F.col("first")))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("row_id")
        clusters, group = table.column("clusters")[0].as_py(), table.column("row_group_id")[0].as_py()
        x = kernels.prepared(matrix(table.column("vec").combine_chunks()), metric, seed, rotate)
        centroids = kernels.kmeans(x, clusters, seed + group, metric == "cosine")
        return pa.table({
            "row_group_id": pa.array(np.full(len(centroids), group), pa.int64()),
            "cluster_id": pa.array(np.arange(len(centroids)), pa.int32()),
            "centroid": pa.array(list(centroids), pa.list_(pa.float32())),
        })

    return sample.groupBy("row_group_id").applyInArrow(run, "row_group_id long, cluster_id int, centroid array<float>")


def assign(rows: DataFrame, groups: DataFrame, centroids: DataFrame, options: IndexOptions) -> DataFrame:
    """codes: a row group's centroids come first in its partition, then its rows batch by batch."""
    metric, seed, rotate, u8 = options.metric.value, options.seed, options.rotate, options.quantization.value == "u8"
    heads = centroids.join(groups, "row_group_id").select("row_group_id", F.lit(0).alias("kind"), F.col("cluster_id").cast("long").alias("row_id"), F.col("centroid").alias("vec"), "q_base", "q_scale")
    body = rows.select("row_group_id", F.lit(1).alias("kind"), "row_id", "vec", F.lit(None).cast("double").alias("q_base"), F.lit(None).cast("double").alias("q_scale"))
    stream = heads.unionByName(body).repartition("row_group_id").sortWithinPartitions("row_group_id", "kind", "row_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads, fixed, base, scale = None, [], None, 0.0, 1.0
        for batch in batches:
            group, kind = batch.column("row_group_id").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(group) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip(np.append(0, edges), np.append(edges, len(group))):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if group[a] != now:
                    now, heads, fixed = group[a], [], None
                if kind[a] == 0:
                    heads.append(matrix(part.column("vec")))
                    base, scale = part.column("q_base")[0].as_py(), part.column("q_scale")[0].as_py()
                    continue
                fixed = np.concatenate(heads) if fixed is None else fixed
                x = kernels.prepared(matrix(part.column("vec")), metric, seed, rotate)
                own = kernels.nearest_centroid(x, fixed)
                code = kernels.quantized(x, base, scale) if u8 else np.ascontiguousarray(x, "<f4")
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_group_id"), pa.array(own), part.column("row_id"), pa.array(np.full(len(own), base)), pa.array(np.full(len(own), scale)), pa.array([r.tobytes() for r in code], pa.binary())],
                    names=["row_group_id", "cluster_id", "row_id", "q_base", "q_scale", "code"],
                )

    return stream.mapInArrow(run, CODES)


def build(base: DataFrame, path: str, options: IndexOptions) -> dict:
    """Writes the index of base (row_id, vec) under path; gives its facts."""
    spark = base.sparkSession
    found = facts(base)
    n, dimensions = found["n"], found["high"]
    rows = base.where("vec IS NOT NULL").select(row_group(found, options.row_group_size).alias("row_group_id"), "row_id", "vec")
    row_group_facts(rows, options).write.mode("overwrite").parquet(f"{path}/row_groups")
    groups = spark.read.parquet(f"{path}/row_groups")
    train(rows, groups, dimensions, options).write.mode("overwrite").parquet(f"{path}/trained")
    trained = spark.read.parquet(f"{path}/trained")
    assign(rows, groups, trained, options).sortWithinPartitions("row_group_id", "cluster_id", "row_id").write.mode("overwrite").option("parquet.block.size", 8 << 20).option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{path}/codes")
    sizes = spark.read.parquet(f"{path}/codes").groupBy("row_group_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    counted = trained.join(sizes, ["row_group_id", "cluster_id"], "left").select("row_group_id", "cluster_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "centroid")
    counted.sortWithinPartitions("row_group_id", "cluster_id").write.mode("overwrite").parquet(f"{path}/centroids")
    total = groups.agg(F.count(F.lit(1)).alias("row_groups"), F.sum("clusters").alias("clusters")).first()
    element = 1 if options.quantization.value == "u8" else 4
    held = n * (dimensions * element + 8) + total["clusters"] * dimensions * 4
    return {"num_dimensions": dimensions, "row_groups": total["row_groups"], "clusters": total["clusters"], "bytes": held}
