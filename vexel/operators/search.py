"""Top-k search: exact, over an index, and over an index with a filter.

Unfiltered: the nearest ``n_probe`` clusters of every row group are read, each partition keeps its k best, and a global
limit merges them. Filtered: the first round probes ``n_probe`` clusters of every row group, which mostly meets k rows that
pass, and then nothing else is read. Where it doesn't, each further round probes five more; the round in which k rows are
met follows from counts of the remaining clusters, so that one more job counts and one more searches. Where few rows pass,
their ids are taken first, and only their codes and the centroids of their row groups are read. The ids found, k and
the offset at most, go to the table's scan as a filter, and its rows are ordered by exact distance.

Vectors that are NULL or hold NULL components are never found.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from vexel.functions.codec import constant
from vexel.functions.distance import BY_METRIC
from vexel.operators import kernels
from vexel.operators.build import CODES, matrix
from vexel.plans.options import MOST_CLUSTERS, ROUND

#: Inputs below this many bytes are scanned by JVM expressions, larger ones by Arrow batches.
ARROW_FROM = 64 << 20
#: Clusters up to this many are ranked on the driver; beyond, by a window over the centroids.
RANKED_ON_DRIVER = 50_000
#: Pairs of row group and cluster, and ids, up to this many are pushed to a scan one by one; beyond, as sets.
PUSHED = 1000
#: Values that Parquet readers compare one by one in a list; of longer lists they take the range only.
LIST = 10
#: Ids up to this many are collected, and ids of passing rows up to this many are broadcast (8 bytes each).
COLLECTED = 5000
BROADCAST_IDS = 1_000_000


@dataclass
class SearchPlan:
    """What a search does; made by the planner, run by ``execute``."""

    table: DataFrame  # with the key column
    key: str
    vector: str
    metric: str
    query: np.ndarray
    k: int
    offset: int = 0
    predicate: Column | None = None
    index: Row | None = None
    path: str | None = None
    n_probe: int = 0
    blob: bool = False
    table_name: str = ""
    notes: list[str] = field(default_factory=list)

    def explain(self) -> str:
        if self.index is None:
            return f"EXACT_SCAN\n  Table: {self.table_name}\n  Metric: {self.metric}\n  Limit: {self.k}"
        name = "VECTOR_INDEX_SCAN" if self.predicate is None else "VECTOR_INDEX_FILTERED_SCAN"
        return (
            f"{name}\n  Table: {self.table_name}\n  Index: {self.index['index_name']}\n  Total Clusters: {self.index['clusters']}\n"
            f"  Row Groups: {self.index['row_groups']}\n  Index Size: {readable(self.index['bytes'])}"
        )


def readable(size: int) -> str:
    for unit, name in ((10**12, "TB"), (10**9, "GB"), (10**6, "MB"), (10**3, "kB")):
        if size >= unit:
            return f"{size / unit:.2f} {name}"
    return f"{size} bytes"


def size_in_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _empty(plan: SearchPlan) -> DataFrame:
    return plan.table.limit(0).withColumn("distance", F.lit(0.0))


def exact(plan: SearchPlan) -> DataFrame:
    """Scan of all passing rows: columns of the table and ``distance``, in order."""
    rows = plan.table if plan.predicate is None else plan.table.where(plan.predicate)
    rows = rows.where(F.col(plan.vector).isNotNull())
    order = ("distance", plan.key)
    if size_in_bytes(rows.select(plan.key, plan.vector)) < ARROW_FROM:
        query = plan.query.astype(np.float32)
        q = F.array(*(F.lit(float(x)) for x in query))
        measured = rows.withColumn("distance", BY_METRIC[plan.metric](F.col(plan.vector), q))
        if plan.blob and plan.metric == "cosine":
            measured = measured.withColumn("distance", F.when(F.isnan("distance"), F.lit(2.0)).otherwise(F.col("distance")))
        measured = measured.where(F.col("distance").isNotNull())  # a NULL component
        return measured.orderBy(*order).limit(plan.k + plan.offset).offset(plan.offset) if plan.offset else measured.orderBy(*order).limit(plan.k)
    found = rows.select(F.col(plan.key).alias("row_id"), F.col(plan.vector).alias("vec")).mapInArrow(exact_top(plan.metric, plan.query, plan.k + plan.offset, plan.blob), "row_id long, distance double")
    best = found.orderBy("distance", "row_id").limit(plan.k + plan.offset)
    if plan.k + plan.offset <= COLLECTED:
        return fetched(plan, [r["row_id"] for r in best.collect()])
    return measured_rows(plan, plan.table.join(best.select(F.col("row_id").alias(plan.key)), plan.key, "left_semi"))


def exact_top(metric: str, query: np.ndarray, k: int, blob: bool):
    """Each partition's k best by exact distance, batch by batch."""
    q = query.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d, best_i = np.zeros(0), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = whole(batch, "vec")
            if not batch.num_rows:
                continue
            d = distances(metric, matrix(batch.column("vec")).astype(np.float64), q, blob)
            d, i = np.append(best_d, d), np.append(best_i, batch.column("row_id").to_numpy())
            at = kernels.top(d, i, k)
            best_d, best_i = d[at], i[at]
        yield pa.RecordBatch.from_arrays([pa.array(best_i), pa.array(best_d)], names=["row_id", "distance"])

    return run


def whole(batch: pa.RecordBatch, name: str) -> pa.RecordBatch:
    """The rows whose list holds no NULL."""
    column = batch.column(name)
    flat = column.flatten()
    if not flat.null_count:
        return batch
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    bad = np.zeros(len(column), bool)
    bad[np.repeat(np.arange(len(column)), lengths)[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    return batch.filter(pa.array(~bad))


def distances(metric: str, x: np.ndarray, q: np.ndarray, blob: bool = False) -> np.ndarray:
    """Exact distance of each row of x to q."""
    if metric == "l2sq":
        return np.sqrt(((x - q) ** 2).sum(1))
    if metric == "ip":
        return -(x @ q)
    norm = np.sqrt((x * x).sum(1) * (q @ q))
    return np.where(norm == 0, 2.0 if blob else np.nan, 1 - np.clip((x @ q) / np.where(norm == 0, 1, norm), -1, 1))


def among(name: str, values: list[int]) -> Column:
    """Whether the column has one of the values, as lists short enough for Parquet statistics; long lists as one set."""
    values = sorted(values)
    if len(values) > PUSHED:
        return F.col(name).isin(values)
    return _any([F.col(name).isin(values[i : i + LIST]) for i in range(0, len(values), LIST)])


def _any(terms: list[Column]) -> Column:
    """The terms joined by OR, as a balanced tree."""
    if not terms:
        return F.lit(False)
    half = len(terms) // 2
    return terms[0] if len(terms) == 1 else _any(terms[:half]) | _any(terms[half:])


def fetched(plan: SearchPlan, ids: list[int]) -> DataFrame:
    """Rows of the table with these ids, which go to its scan, by exact distance, less the offset."""
    return measured_rows(plan, plan.table.where(among(plan.key, ids))) if ids else _empty(plan)


def measured_rows(plan: SearchPlan, rows: DataFrame) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in plan.query.astype(np.float32)))
    ordered = rows.withColumn("distance", BY_METRIC[plan.metric](F.col(plan.vector), q)).orderBy("distance", plan.key)
    return ordered.offset(plan.offset) if plan.offset else ordered


@lru_cache(maxsize=8)
def driver_centroids(spark: SparkSession, path: str, created: int):
    """Row groups, clusters and centroids of an index that has RANKED_ON_DRIVER clusters at most; indexes never change."""
    rows = spark.read.parquet(f"{path}/centroids").select("row_group_id", "cluster_id", "centroid").toPandas()
    return rows["row_group_id"].to_numpy(), rows["cluster_id"].to_numpy(), np.stack(rows["centroid"])


def ranked_on_driver(spark: SparkSession, plan: SearchPlan, query: np.ndarray) -> pd.DataFrame:
    """row_group_id, cluster_id, rank from 0: clusters of each row group by distance of their centroid."""
    group, cluster, centroids = driver_centroids(spark, plan.path, plan.index["created"])
    rows = pd.DataFrame({"row_group_id": group, "cluster_id": cluster, "d": kernels.squared(centroids, query)})
    rows = rows.sort_values(["row_group_id", "d", "cluster_id"])
    rows["rank"] = rows.groupby("row_group_id").cumcount()
    return rows[["row_group_id", "cluster_id", "rank"]]


def ranked(spark: SparkSession, plan: SearchPlan, query: np.ndarray, groups: list[int] | None = None) -> DataFrame:
    """The same as a distributed window, for indexes of any size; of these row groups alone if they are given."""
    q = F.array(*(F.lit(float(x)) for x in query))
    centroids = spark.read.parquet(f"{plan.path}/centroids")
    centroids = centroids if groups is None else centroids.where(among("row_group_id", groups))
    measured = centroids.withColumn("d", BY_METRIC["l2sq"](F.col("centroid"), q))
    order = Window.partitionBy("row_group_id").orderBy("d", "cluster_id")
    return measured.select("row_group_id", "cluster_id", (F.row_number().over(order) - 1).cast("long").alias("rank"))


def with_ranks(spark: SparkSession, plan: SearchPlan, query: np.ndarray, codes: DataFrame, low: int, high: int | None, named: bool = False) -> DataFrame:
    """codes of clusters of rank ``low`` up to, not including, ``high``; with their rank if it is to be ``named``.

    Clusters ranked on the driver are few (RANKED_ON_DRIVER), so their table is broadcast; row groups and clusters go to the
    scan as pairs where they are few, else the clusters alone.
    """
    if plan.index["clusters"] > RANKED_ON_DRIVER:
        ranks = ranked(spark, plan, query).where(F.col("rank") >= low)
        return codes.join(ranks if high is None else ranks.where(F.col("rank") < high), ["row_group_id", "cluster_id"])
    ranks = ranked_on_driver(spark, plan, query)
    ranks = ranks[(ranks["rank"] >= low) & (ranks["rank"] < (MOST_CLUSTERS if high is None else high))]
    if len(ranks) < plan.index["clusters"]:
        if len(ranks) <= PUSHED:
            groups = ranks.groupby("row_group_id")["cluster_id"]
            codes = codes.where(_any([(F.col("row_group_id") == int(g)) & among("cluster_id", own.tolist()) for g, own in groups]))
            if not named:
                return codes
        else:
            codes = codes.where(among("cluster_id", sorted(set(ranks["cluster_id"].tolist()))))
    return codes.join(F.broadcast(spark.createDataFrame(ranks, "row_group_id long, cluster_id int, rank long")), ["row_group_id", "cluster_id"])


def code_top(query: np.ndarray, u8: bool, k: int):
    """Each partition's k best by the index's distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d, best_i = np.zeros(0), np.zeros(0, np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if u8:
                width = len(query)
                raw = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, width)
                base, scale = batch.column("q_base").to_numpy(), batch.column("q_scale").to_numpy()
                d = np.empty(n)
                pairs, at = np.unique(np.stack([base, scale], 1), axis=0, return_inverse=True)
                for j, (b, s) in enumerate(pairs):
                    own = np.flatnonzero(at.ravel() == j)
                    diff = raw[own].astype(np.int32) - kernels.quantized(query[None], b, s)[0].astype(np.int32)
                    d[own] = np.einsum("ij,ij->i", diff, diff, dtype=np.int64) / (s * s)
            else:
                raw = np.frombuffer(b"".join(batch.column("code").to_pylist()), "<f4").reshape(n, -1)
                d = kernels.squared(raw, query)
            d, i = np.append(best_d, d), np.append(best_i, batch.column("row_id").to_numpy())
            keep = kernels.top(d, i, k)
            best_d, best_i = d[keep], i[keep]
        yield pa.RecordBatch.from_arrays([pa.array(best_i), pa.array(best_d)], names=["row_id", "distance"])

    return run


def last_round(counts: list[tuple[int, int]], k: int) -> int | None:
    """The first round by whose end k rows have been met; None if all are needed."""
    met = 0
    for number, n in sorted(counts):
        met += n
        if met >= k:
            return number
    return None


def ranks_of(spark: SparkSession, plan: SearchPlan, query: np.ndarray, codes: DataFrame, ids: list[int]) -> list[tuple[int, int]]:
    """(id, rank of its cluster in its row group) of a few indexed rows; no other row group's centroids are ranked."""
    held = codes.where(among("row_id", ids)).select("row_group_id", "cluster_id", "row_id")
    places = [(r["row_group_id"], r["cluster_id"], r["row_id"]) for r in held.collect()]
    groups = sorted({g for g, _, _ in places})
    if plan.index["clusters"] > RANKED_ON_DRIVER:
        pairs = F.broadcast(spark.createDataFrame(sorted({(g, c) for g, c, _ in places}), "row_group_id long, cluster_id int"))
        rows = ranked(spark, plan, query, groups).join(pairs, ["row_group_id", "cluster_id"], "left_semi").collect() if places else []
        ranks = {(r["row_group_id"], r["cluster_id"]): r["rank"] for r in rows}
    else:
        rows = ranked_on_driver(spark, plan, query)
        rows = rows[rows["row_group_id"].isin(groups)]
        ranks = dict(zip(zip(rows["row_group_id"].tolist(), rows["cluster_id"].tolist()), rows["rank"].tolist()))
    return [(i, ranks[g, c]) for g, c, i in places]


def indexed(plan: SearchPlan) -> DataFrame:
    spark = plan.table.sparkSession
    meta = plan.index
    query = kernels.prepared(plan.query[None], meta["metric"], meta["seed"], meta["rotate"])[0]
    codes = spark.read.schema(CODES).parquet(f"{plan.path}/codes")
    k = plan.k + plan.offset
    first = MOST_CLUSTERS if plan.n_probe == 0 or plan.n_probe > MOST_CLUSTERS else plan.n_probe
    every = plan.n_probe == 0
    u8 = meta["quantization"] == "u8"

    def best(found: DataFrame) -> list[Row]:
        top = found.select("row_id", "q_base", "q_scale", "code").mapInArrow(code_top(query, u8, k), "row_id long, distance double")
        return top.orderBy("distance", "row_id").limit(k).collect()

    def probed() -> DataFrame:
        return codes if every else with_ranks(spark, plan, query, codes, 0, first)

    if plan.predicate is None:
        return fetched(plan, [r["row_id"] for r in best(probed())])
    passing = plan.table.where(plan.predicate).where(F.col(plan.vector).isNotNull()).select(F.col(plan.key).cast("long").alias("row_id"))
    # in one job, where collect() would try one partition, then four more, and so on
    ids = passing.limit(COLLECTED + 1).agg(F.collect_list("row_id").alias("ids")).first()["ids"]
    if len(ids) <= COLLECTED:
        # rounds go on until k rows are met, so where no more pass, all are
        if len(ids) > k or not every and first >= MOST_CLUSTERS:
            ranks = ranks_of(spark, plan, query, codes, ids)
            if not every:
                counts = Counter(max(0, 1 + (rank - first) // ROUND) for _, rank in ranks)
                stop = 0 if first >= MOST_CLUSTERS else last_round(list(counts.items()), k)
                ranks = ranks if stop is None else [(i, rank) for i, rank in ranks if rank < first + ROUND * stop]
            ids = [i for i, _ in ranks]
        return fetched(plan, ids if len(ids) <= k else [r["row_id"] for r in best(codes.where(among("row_id", ids)))])
    if passing.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        passing = F.broadcast(passing)
    met = best(probed().join(passing, "row_id", "left_semi"))
    if len(met) < k and not every and first < MOST_CLUSTERS:
        rest = with_ranks(spark, plan, query, codes, first, None, named=True).withColumn("round", 1 + F.floor((F.col("rank") - first) / ROUND))
        counts = rest.select("row_id", "round").join(passing, "row_id", "left_semi").groupBy("round").agg(F.count(F.lit(1)).alias("n")).collect()
        stop = last_round([(0, len(met)), *((r["round"], r["n"]) for r in counts)], k)
        more = with_ranks(spark, plan, query, codes, first, None if stop is None else first + ROUND * stop)
        met = sorted([*met, *best(more.join(passing, "row_id", "left_semi"))], key=lambda r: (r["distance"], r["row_id"]))[:k]
    return fetched(plan, [r["row_id"] for r in met])


def execute(plan: SearchPlan) -> DataFrame:
    if plan.k == 0:
        return _empty(plan)
    return exact(plan) if plan.index is None else indexed(plan)


#: Bytes of vectors in a part of a batch search, and cells of a block of distances.
PART_BYTES, CELLS = 32 << 20, 4 << 20
UNKNOWN = 1 << 60


def nearest_of(metric: str, x: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int):
    """For each query, (places, distances) of its k nearest rows: a matrix product chooses, exact distances decide."""
    squares = (x * x).sum(1)
    step = max(1, CELLS // max(1, len(x)))
    for at in range(0, len(queries), step):
        part = queries[at : at + step]
        products = part @ x.T
        for q, dots in zip(part, products):
            size = q @ q
            if metric == "l2sq":
                rough, slack = squares + size - 2 * dots, 1e-9 * (squares.max() + size)
            elif metric == "ip":
                rough, slack = -dots, 1e-9 * (np.sqrt(squares.max() * size) + 1)
            else:
                norm = np.sqrt(squares * size)
                rough, slack = np.where(norm == 0, np.inf, 1 - dots / np.where(norm == 0, 1, norm)), 1e-9
            near = np.flatnonzero(rough <= np.partition(rough, k - 1)[k - 1] + slack) if k < len(rough) else np.arange(len(rough))
            d = distances(metric, x[near], q)
            best = kernels.top(d, own[near], k)
            yield near[best], d[best]


def batch_exact(table: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, metric: str, k: int) -> DataFrame:
    """query_id, row_id, distance, rank: the k nearest rows of each query.

    The table is dealt into parts of some PART_BYTES by a hash of its key; every query goes to every part, whose task holds
    the part and computes blocks of distances; each part keeps k rows a query.
    """
    rows = table.where(F.col(vector).isNotNull()).select(F.col(key).alias("row_id"), F.col(vector).alias("vec"))
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_key).alias("query_id"), F.col(query_vector).alias("q"))
    size = size_in_bytes(rows)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # tables that are no files have no known size
    parts = cores if size > UNKNOWN else max(1, -(-size // PART_BYTES), min(cores, size >> 20))
    blocks = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    left = rows.withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(parts)).cast("int")).select("part", F.lit(0).alias("kind"), F.col("row_id").alias("id"), F.col("vec").alias("v"))
    both = left.unionByName(blocks.select("part", F.lit(1).alias("kind"), F.col("query_id").alias("id"), F.col("q").alias("v"))).repartition(parts, "part").sortWithinPartitions("part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, xs, held = None, [], [], None
        for batch in batches:
            batch = whole(batch, "v")
            part, kind = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip(np.append(0, edges), np.append(edges, len(part))):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if part[a] != now:
                    now, ids, xs, held = part[a], [], [], None
                v, i = matrix(piece.column("v")).astype(np.float64), piece.column("id").to_numpy()
                if kind[a] == 0:
                    ids.append(i)
                    xs.append(v)
                    continue
                if not xs:
                    continue
                held = (np.concatenate(ids), np.concatenate(xs)) if held is None else held
                own, x = held
                found = list(nearest_of(metric, x, own, v, k))
                columns = (np.repeat(i, [len(at) for at, _ in found]), np.concatenate([own[at] for at, _ in found]), np.concatenate([d for _, d in found]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "row_id", "distance"])

    found = both.mapInArrow(run, "query_id long, row_id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def as_query(value) -> tuple[np.ndarray, bool]:
    return constant(value), isinstance(value, (bytes, bytearray))
