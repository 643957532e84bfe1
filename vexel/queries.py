"""Queries of the engine over the table ``embeddings``, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.engine import Engine
from vexel.functions import codec, distance
from vexel.plans.options import cluster_count

#: Small row groups and several clusters, so that small tables too have clusters to prune.
SMALL = {"row_group_size": 128, "clusters_per_row_group": 10, "seed": 1}


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def engine(spark: SparkSession, sf_dir: str) -> tuple[Engine, list[float]]:
    """An engine that has the table, and the vector of row 0."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    e = Engine(spark, f"{shared}/vexel-{uuid.uuid4().hex}" if shared else None)
    df = e.register_table("embeddings_indexed", table(spark, sf_dir), "vec_id")
    return e, df.where("vec_id = 0").first()["embedding"]


def shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("vec_id", *more, F.round("distance", 6).alias("distance"))


def top(metric: str, k: int, offset: int = 0, where: str | None = None, **index) -> Callable[[SparkSession, str], DataFrame]:
    """A top-k query to row 0; with index options, over an index of which every cluster is probed."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, q = engine(spark, sf_dir)
        if index:
            e.create_index("idx", "embeddings_indexed", "embedding", metric=metric, **index)
        return shown(e.search("embeddings_indexed", "embedding", q, k, metric, where=where, offset=offset, n_probe=0 if index else None))

    return run


#: DuckDB's spelling of the metrics; the query is row 0.
SQL_METRIC = {
    "l2sq": "list_distance(CAST(embedding AS DOUBLE[]), q)",
    "cosine": "list_cosine_distance(CAST(embedding AS DOUBLE[]), q)",
    "ip": "list_negative_inner_product(CAST(embedding AS DOUBLE[]), q)",
}


def top_sql(metric: str, k: int, offset: int = 0, where: str | None = None) -> str:
    return (
        f"SELECT vec_id, round({SQL_METRIC[metric]}, 6) AS distance FROM embeddings, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
        f"{f' WHERE {where}' if where else ''} ORDER BY {SQL_METRIC[metric]}, vec_id LIMIT {k} OFFSET {offset}"
    )


#: name: (metric, k, offset, predicate, index options)
TOPS: dict[str, tuple] = {
    "exact_l2_topk": ("l2sq", 10, 0, None, {}),
    "exact_cosine_topk": ("cosine", 10, 0, None, {}),
    "exact_neg_ip_topk": ("ip", 10, 0, None, {}),
    "topk_offset": ("l2sq", 5, 3, None, {}),
    "topk_k1": ("l2sq", 1, 0, None, {}),
    "topk_limit0": ("l2sq", 0, 0, None, {}),
    "ann_f32_full_l2": ("l2sq", 10, 0, None, {"quantization": "f32", "seed": 1}),
    "ann_f32_full_cosine": ("cosine", 10, 0, None, {"quantization": "f32", "seed": 1}),
    "ann_multi_cluster_full": ("l2sq", 50, 0, None, {"quantization": "f32", **SMALL}),
    "ann_multi_cluster_offset": ("cosine", 10, 5, None, {"quantization": "f32", **SMALL}),
    "ann_rotated_full": ("l2sq", 20, 0, None, {"quantization": "f32", "rotate": True, **SMALL}),
    "filtered_gt": ("l2sq", 10, 0, "vec_id > 100", {"quantization": "f32", **SMALL}),
    "filtered_eq_single_row": ("cosine", 10, 0, "vec_id = 25", {"quantization": "u8", **SMALL}),
    "filtered_k_gt_passing": ("l2sq", 50, 0, "vec_id < 25", {"quantization": "u8", **SMALL}),
    "filtered_or_composite": ("l2sq", 10, 0, "(label = 3 AND vec_id > 50) OR vec_id % 7 = 2", {"quantization": "f32", **SMALL}),
    "filtered_empty": ("l2sq", 10, 0, "vec_id < 0", {"quantization": "f32", **SMALL}),
}


def filtered_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered searches probe on until k rows are found: rows found for several numbers of passing rows."""
    e, q = engine(spark, sf_dir)
    e.create_index("idx", "embeddings_indexed", "embedding", n_probe=1, **SMALL)
    counts = None
    for limit in (0, 1, 5, 25, 49, 50, 51, 100, 400):
        found = e.search("embeddings_indexed", "embedding", q, 50, where=f"vec_id < {limit}")
        row = found.agg(F.lit(limit).cast("long").alias("passing"), F.count(F.lit(1)).alias("found"))
        counts = row if counts is None else counts.union(row)
    return counts


def filtered_rowid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without key: rows are numbered, and the number can be filtered by."""
    e, q = engine(spark, sf_dir)
    e.register_table("numbered", table(spark, sf_dir).coalesce(1).sortWithinPartitions("vec_id"))
    e.create_index("idx", "numbered", "embedding", quantization="f32", n_probe=0, **SMALL)
    literal = ", ".join(str(x) for x in q)
    found = e.sql(f"SELECT vec_id, rowid AS row_id, array_distance(embedding, [{literal}]::FLOAT[64]) AS distance FROM numbered WHERE rowid > 200 ORDER BY array_distance(embedding, [{literal}]::FLOAT[64]) LIMIT 10")
    return found.select("vec_id", F.col("row_id").cast("long"), F.round("distance", 6).alias("distance"))


def sql_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL front end: index statement, setting, operator, filter, limit."""
    e, q = engine(spark, sf_dir)
    e.sql("CREATE INDEX IF NOT EXISTS idx ON embeddings_indexed USING ivf (embedding) WITH (metric = 'cosine', quantization = 'f32', seed = 0)")
    e.sql("SET vexel_n_probe = 0")
    literal = ", ".join(str(x) for x in q)
    try:
        found = e.sql(f"SELECT vec_id, label, embedding <=> [{literal}]::FLOAT[64] AS distance FROM embeddings_indexed WHERE label < 5 ORDER BY embedding <=> [{literal}]::FLOAT[64] LIMIT 7")
    finally:
        e.sql("RESET vexel_n_probe")
    return shown(found, "label")


def blob_encode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir).select("vec_id", F.lower(F.hex(codec.encode_blob(F.col("embedding")))).alias("words"))


def blob_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = codec.decode_blob(codec.encode_blob(F.col("embedding")))
    return table(spark, sf_dir).select("vec_id", F.posexplode(back).alias("dim", "x")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("x").cast("double"), 6).alias("x"))


def blob_roundtrip_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding is off by half a step of the scale at most: at most 0.00005 below 0.8."""
    back = codec.decode_blob(codec.encode_blob(F.col("embedding")))
    off = F.array_max(F.zip_with("embedding", back, lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    return table(spark, sf_dir).agg((F.max(off) < 0.01).alias("small"), F.count(F.lit(1)).alias("n"))


def base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    blob = codec.encode_blob(F.col("embedding"))
    text = codec.blob_to_base64(blob)
    return table(spark, sf_dir).select("vec_id", text.alias("text"), (codec.base64_to_blob(text) == blob).alias("same"))


def blob_distance(metric: str, left: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir)
        blob = codec.encode(df.where("vec_id = 0").first()["embedding"])
        args = (blob, F.col("embedding")) if left else (F.col("embedding"), blob)
        return df.select("vec_id", F.round(distance.BY_METRIC[metric](*args), 5).alias("distance"))

    return run


def row_group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row groups of an index and their rows."""
    e, _ = engine(spark, sf_dir)
    e.create_index("idx", "embeddings_indexed", "embedding", **SMALL)
    return spark.read.parquet(f"{e.registry.path('idx')}/codes").groupBy("row_group_id").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))


def u8_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = engine(spark, sf_dir)
    e.create_index("idx", "embeddings_indexed", "embedding", quantization="u8", **SMALL)
    groups = spark.read.parquet(f"{e.registry.path('idx')}/row_groups")
    return groups.select("row_group_id", "n", F.round("q_base", 6).alias("q_base"), F.round("q_scale", 4).alias("q_scale"))


def u8_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the codes of each row."""
    e, _ = engine(spark, sf_dir)
    e.create_index("idx", "embeddings_indexed", "embedding", quantization="u8", **SMALL)
    codes = spark.read.parquet(f"{e.registry.path('idx')}/codes")
    values = F.transform(F.regexp_extract_all(F.hex("code"), F.lit("([0-9A-F]{2})"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))
    return codes.select(F.col("row_id").alias("vec_id"), F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(values).cast("long").alias("n"))


#: Times the table's rows, for the rule of clusters.
FACTORS = (1, 4, 5, 61, 62, 240, 250)


def cluster_count_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of row groups of several times the table's rows."""
    rows = table(spark, sf_dir).count()
    return spark.createDataFrame([(rows * f, cluster_count(rows * f)) for f in FACTORS], "n long, clusters long")


def recall_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall over a growing n_probe: never falls, and is 1 when all clusters are probed."""
    e, q = engine(spark, sf_dir)
    e.create_index("idx", "embeddings_indexed", "embedding", quantization="f32", **SMALL)
    truth = {r["vec_id"] for r in e.search("embeddings_indexed", "embedding", q, 50, use_index=False).select("vec_id").collect()}
    recalls = []
    for n in (1, 2, 3, 5, 10):
        found = {r["vec_id"] for r in e.search("embeddings_indexed", "embedding", q, 50, n_probe=n).select("vec_id").collect()}
        recalls.append(len(found & truth) / len(truth))
    rises = all(a <= b for a, b in zip(recalls, recalls[1:]))
    return spark.createDataFrame([(rises, recalls[0] < 1.0, recalls[-1] == 1.0)], "rises boolean, pruned boolean, complete boolean")


def recall_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clusters probed, 8-bit codes: at least 0.95 of the 50 nearest rows are found for every metric."""
    e, q = engine(spark, sf_dir)
    rows = []
    for metric in ("l2sq", "cosine"):
        e.create_index(f"idx_{metric}", "embeddings_indexed", "embedding", metric=metric, **SMALL)
        truth = {r["vec_id"] for r in e.search("embeddings_indexed", "embedding", q, 50, metric, use_index=False).select("vec_id").collect()}
        found = {r["vec_id"] for r in e.search("embeddings_indexed", "embedding", q, 50, metric, n_probe=0).select("vec_id").collect()}
        rows.append((metric, len(found & truth) >= 0.95 * len(truth)))
    return spark.createDataFrame(rows, "metric string, good boolean")


def index_info_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = engine(spark, sf_dir)
    e.create_index("idx", "embeddings_indexed", "embedding", metric="cosine", n_probe=7, seed=-5)
    return e.sql("CALL vexel_index_info()").withColumnRenamed("approx_lower_bound_memory_usage_bytes", "size")


def index_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indexes, listed, with the size of their elements by quantization."""
    e, _ = engine(spark, sf_dir)
    for name, quantization in (("narrow", "u8"), ("plain", "f32")):
        e.create_index(name, "embeddings_indexed", "embedding", quantization=quantization, **SMALL)
    sizes = e.index_info().select("index_name", F.col("approx_lower_bound_memory_usage_bytes").alias("size"))
    return e.sql("FROM vexel_indexes()").join(sizes, "index_name")


def index_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What EXPLAIN says of an indexed, a filtered and an exact search: kind of scan, clusters, row groups."""
    e, q = engine(spark, sf_dir)
    e.create_index("idx", "embeddings_indexed", "embedding", **SMALL)
    literal = ", ".join(str(x) for x in q)
    texts = {"indexed": f"embedding <-> [{literal}]", "exact": f"embedding <=> [{literal}]"}
    plans = None
    for case, where in (("indexed", ""), ("indexed", "WHERE label < 3 "), ("exact", "")):
        plan = e.sql(f"EXPLAIN SELECT vec_id FROM embeddings_indexed {where}ORDER BY {texts[case]} LIMIT 5")
        plans = plan if plans is None else plans.union(plan)
    number = lambda name: F.regexp_extract("plan", rf"{name}: (\d+)", 1).try_cast("long")
    return plans.select(F.substring_index("plan", "\n", 1).alias("scan"), number("Total Clusters").alias("clusters"), number("Row Groups").alias("row_groups"))


def ann_pruned(metric: str, n_probe: int, k: int, where: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """Few clusters probed, over vectors that lie apart by label: the neighbours of row 0 are in the clusters probed."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, _ = engine(spark, sf_dir)
        apart = F.concat("embedding", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(F.col("label") == i, 20.0).otherwise(0.0).cast("float")))
        df = e.register_table("apart", table(spark, sf_dir).select("vec_id", "label", apart.alias("embedding")), "vec_id")
        q = df.where("vec_id = 0").first()["embedding"]
        e.create_index("idx", "apart", "embedding", metric=metric, quantization="f32", row_group_size=1000, clusters_per_row_group=20, seed=1)
        return shown(e.search("apart", "embedding", q, k, metric, where=where, n_probe=n_probe))

    return run


#: name: (metric, n_probe, k, predicate); k is below the rows that have row 0's label.
PRUNED: dict[str, tuple] = {
    "ann_pruned_l2": ("l2sq", 5, 15, None),
    "ann_pruned_cosine": ("cosine", 4, 15, None),
    "ann_pruned_filtered": ("l2sq", 5, 10, "vec_id % 2 = 0"),
}


def pruned_sql(metric: str, n_probe: int, k: int, where: str | None = None) -> str:
    labels = ", ".join(f"CASE WHEN label = {i} THEN 20 ELSE 0 END" for i in range(10))
    apart = f"list_concat(CAST(embedding AS DOUBLE[]), CAST([{labels}] AS DOUBLE[]))"
    return top_sql(metric, k, 0, where).replace("FROM embeddings", f"FROM (SELECT vec_id, label, {apart} AS embedding FROM embeddings)")


def null_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vector is NULL are neither indexed nor found."""
    e, q = engine(spark, sf_dir)
    e.register_table("holes", table(spark, sf_dir).select("vec_id", F.when(F.col("vec_id") % 3 != 1, F.col("embedding")).alias("embedding")), "vec_id")
    e.create_index("idx", "holes", "embedding", quantization="f32", **SMALL)
    return shown(e.search("holes", "embedding", q, 12, n_probe=0))


def null_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vector holds a NULL component are not found."""
    e, q = engine(spark, sf_dir)
    holed = F.transform("embedding", lambda x, i: F.when((i == 5) & (F.col("vec_id") % 4 == 2), None).otherwise(x))
    e.register_table("holed", table(spark, sf_dir).select("vec_id", holed.alias("embedding")), "vec_id")
    return shown(e.search("holed", "embedding", q, 12, "cosine"))


def high_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit beyond the indexed ones: exact, whatever the index probes."""
    e, q = engine(spark, sf_dir)
    e.create_index("idx", "embeddings_indexed", "embedding", n_probe=1, **SMALL)
    return shown(e.search("embeddings_indexed", "embedding", q, 6000))


def changed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another table under an indexed name: the search goes without the stale index."""
    e, q = engine(spark, sf_dir)
    e.create_index("idx", "embeddings_indexed", "embedding", n_probe=1, **SMALL)
    e.register_table("embeddings_indexed", table(spark, sf_dir).where("vec_id >= 40"), "vec_id")
    return shown(e.search("embeddings_indexed", "embedding", q, 10))


def sparse_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys a million apart: still few row groups, and all rows are found."""
    e, q = engine(spark, sf_dir)
    e.register_table("sparse", table(spark, sf_dir).withColumn("vec_id", F.col("vec_id") * 1_000_003), "vec_id")
    e.create_index("idx", "sparse", "embedding", quantization="f32", **SMALL)
    groups = e.registry.entries["idx"]["row_groups"]
    return shown(e.search("sparse", "embedding", q, 10, n_probe=0).withColumn("row_groups", F.lit(groups)), "row_groups")


def sql_order(order: str, operator: str = "<->") -> Callable[[SparkSession, str], DataFrame]:
    """Orders that no index serves, and the operator that one does."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, q = engine(spark, sf_dir)
        call = f"embedding {operator} [{', '.join(str(x) for x in q)}]"
        found = e.sql(f"SELECT vec_id, label, {call} AS distance FROM embeddings_indexed ORDER BY {order.format(call)} LIMIT 9")
        # the SQL functions give single precision
        return found.select("vec_id", "label", F.round(F.col("distance").cast("double"), 4).alias("distance"))

    return run


#: name: (order, the order in DuckDB's SQL)
ORDERS = {
    "sql_operator_l2": ("{}", "d, vec_id"),
    "sql_descending": ("{} DESC, vec_id", "d DESC, vec_id"),
    "sql_label_first": ("label, {}, vec_id", "label, d, vec_id"),
}


def index_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes before and after DROP INDEX; dropping again IF EXISTS does nothing."""
    e, _ = engine(spark, sf_dir)
    e.create_index("idx", "embeddings_indexed", "embedding", seed=1)
    before = e.index_info().count()
    e.sql("DROP INDEX idx")
    e.sql("DROP INDEX IF EXISTS idx")
    return spark.createDataFrame([(before, e.index_info().count())], "before long, after long")


def knn_label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = engine(spark, sf_dir)
    return e.search("embeddings_indexed", "embedding", q, 25).groupBy(F.col("label").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("votes"))


def knn_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nearest rows of every 50th row, itself included."""
    e, _ = engine(spark, sf_dir)
    asked = table(spark, sf_dir).where("vec_id % 50 = 0")
    found = e.search_batch("embeddings_indexed", "embedding", asked, "vec_id", "embedding", 3)
    return found.select("query_id", F.col("row_id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


NAMED = (
    filtered_rounds, filtered_rowid, sql_topk, blob_encode_words, blob_decode, blob_roundtrip_error, base64_roundtrip, row_group_ids, u8_params, u8_codes,
    cluster_count_rule, recall_monotonic, recall_u8, index_info_static, index_listing, index_explain, index_drop, null_vectors, null_components, high_limit,
    changed_table, sparse_keys, knn_label_vote, knn_self_join,
)
BLOBS = {"blob_distance_left": ("l2sq", True), "blob_distance_right": ("l2sq", False), "blob_cosine": ("cosine", True), "blob_negative_inner_product": ("ip", False)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: top(metric, k, offset, where, **index) for name, (metric, k, offset, where, index) in TOPS.items()}
    out |= {f.__name__: f for f in NAMED}
    out |= {name: ann_pruned(*args) for name, args in PRUNED.items()}
    out |= {name: sql_order(order) for name, (order, _) in ORDERS.items()}
    return out | {name: blob_distance(*args) for name, args in BLOBS.items()}


# The word of a component in SQL: float32 products, rounded half away from zero.
_Q = "round(CAST(x AS FLOAT) * CAST({} AS FLOAT))"
_WORD = "CASE " + " ".join(f"WHEN {_Q.format(s)} BETWEEN -8192 AND 8191 THEN CAST({_Q.format(s)} AS INT) * 4 + {i}" for i, s in enumerate((100000, 10000, 1000))) + f" ELSE CAST(greatest(-8192, least(8191, {_Q.format(100)})) AS INT) * 4 + 3 END"
_WORDS = f"SELECT vec_id, dim - 1 AS dim, {_WORD} AS w FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings)"
_HEX = f"SELECT vec_id, string_agg(printf('%02x%02x', (w + 65536) % 256, ((w + 65536) // 256) % 256), '' ORDER BY dim) AS words FROM ({_WORDS}) GROUP BY vec_id"
_VALUE = "CAST(CAST(w >> 2 AS FLOAT) * CAST(CASE (w + 65536) % 4 WHEN 0 THEN 0.00001 WHEN 1 THEN 0.0001 WHEN 2 THEN 0.001 ELSE 0.01 END AS FLOAT) AS DOUBLE)"
_BLOB_Q = f"SELECT list({_VALUE} ORDER BY dim) AS q FROM ({_WORDS}) WHERE vec_id = 0"
_GROUPS = "SELECT vec_id // 128 AS row_group_id, count(DISTINCT vec_id) AS n, min(x) AS low, max(x) AS high FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY 1"


def oracle_sql() -> dict[str, str]:
    out = {name: top_sql(metric, k, offset, where) for name, (metric, k, offset, where, _) in TOPS.items()}
    out |= {name: f"SELECT vec_id, round({SQL_METRIC[metric]}, 5) AS distance FROM embeddings, ({_BLOB_Q})" for name, (metric, _) in BLOBS.items()}
    out |= {name: pruned_sql(*args) for name, args in PRUNED.items()}
    l2 = "SELECT vec_id, label, list_distance(CAST(embedding AS DOUBLE[]), q) AS d FROM embeddings, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
    out |= {name: f"SELECT vec_id, label, round(d, 4) AS distance FROM ({l2}) ORDER BY {order} LIMIT 9" for name, (_, order) in ORDERS.items()}
    clusters = "CASE WHEN count(*) < 2048 THEN 1 WHEN count(*) < 30720 THEN 120 ELSE 480 END"
    small = "SELECT count(*) AS row_groups, CAST(sum(least(10, n)) AS BIGINT) AS clusters, CAST(sum(n) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM embeddings GROUP BY vec_id // 128)"
    return out | {
        "null_vectors": top_sql("l2sq", 12, 0, "vec_id % 3 <> 1"),
        "null_components": top_sql("cosine", 12, 0, "vec_id % 4 <> 2"),
        "high_limit": top_sql("l2sq", 6000),
        "changed_table": top_sql("l2sq", 10, 0, "vec_id >= 40"),
        "sparse_keys": f"SELECT vec_id * 1000003 AS vec_id, distance, (SELECT CAST(ceil(count(*) / 128) AS BIGINT) FROM embeddings) AS row_groups FROM ({top_sql('l2sq', 10)})",
        "index_listing": f"SELECT 'spark_catalog' AS catalog_name, 'default' AS schema_name, name AS index_name, 'embeddings_indexed' AS table_name, n * (64 * element + 8) + clusters * 64 * 4 AS size FROM ({small}), (VALUES ('narrow', 1), ('plain', 4)) AS t(name, element)",
        "index_explain": f"SELECT scan, CASE WHEN scan <> 'EXACT_SCAN' THEN clusters END AS clusters, CASE WHEN scan <> 'EXACT_SCAN' THEN row_groups END AS row_groups FROM ({small}), (VALUES ('VECTOR_INDEX_SCAN'), ('VECTOR_INDEX_FILTERED_SCAN'), ('EXACT_SCAN')) AS t(scan)",
        "filtered_rounds": "SELECT CAST(p AS BIGINT) AS passing, least(50, count(*) FILTER (vec_id < p)) AS found FROM embeddings, (VALUES (0), (1), (5), (25), (49), (50), (51), (100), (400)) AS t(p) GROUP BY p",
        "filtered_rowid": f"SELECT vec_id, vec_id AS row_id, distance FROM ({top_sql('l2sq', 10, 0, 'vec_id > 200')})",
        "sql_topk": f"SELECT e.vec_id, label, distance FROM ({top_sql('cosine', 7, 0, 'label < 5')}) t JOIN embeddings e ON e.vec_id = t.vec_id",
        "blob_encode_words": _HEX,
        "blob_decode": f"SELECT vec_id, dim, round({_VALUE}, 6) AS x FROM ({_WORDS})",
        "blob_roundtrip_error": "SELECT true AS small, count(*) AS n FROM embeddings",
        "base64_roundtrip": f"SELECT vec_id, base64(unhex(words)) AS text, true AS same FROM ({_HEX})",
        "row_group_ids": "SELECT vec_id // 128 AS row_group_id, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM embeddings GROUP BY 1",
        "u8_params": f"SELECT row_group_id, n, round(low, 6) AS q_base, round(255 / (high - low), 4) AS q_scale FROM ({_GROUPS})",
        "u8_codes": f"SELECT vec_id, CAST(sum(least(255, greatest(0, round((x - low) * (255 / (high - low)))))) AS BIGINT) AS total, count(*) AS n FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) e JOIN ({_GROUPS}) g ON e.vec_id // 128 = g.row_group_id GROUP BY vec_id",
        "cluster_count_rule": f"SELECT n, CAST(CASE WHEN n < 2048 THEN 1 WHEN n < 30720 THEN 120 ELSE 480 END AS BIGINT) AS clusters FROM (SELECT count(*) * f AS n FROM embeddings, (VALUES {', '.join(f'({f})' for f in FACTORS)}) AS t(f) GROUP BY f)",
        "recall_monotonic": "SELECT true AS rises, true AS pruned, true AS complete",
        "recall_u8": "SELECT 'l2sq' AS metric, true AS good UNION ALL SELECT 'cosine', true",
        "index_info_static": "SELECT 'spark_catalog' AS catalog_name, 'default' AS schema_name, 'idx' AS index_name, 'embeddings_indexed' AS table_name, 'cosine' AS metric, CAST(64 AS BIGINT) AS num_dimensions, 'u8' AS quantization, CAST(7 AS BIGINT) AS n_probe, CAST(-5 AS BIGINT) AS seed, true AS is_normalized, count(*) * 72 + " + clusters + " * 256 AS size FROM embeddings",
        "index_drop": "SELECT CAST(1 AS BIGINT) AS before, CAST(0 AS BIGINT) AS after",
        "knn_label_vote": f"SELECT CAST(label AS BIGINT) AS label, count(*) AS votes FROM ({top_sql('l2sq', 25)}) t JOIN embeddings e ON e.vec_id = t.vec_id GROUP BY 1",
        "knn_self_join": "SELECT query_id, vec_id, rank, distance FROM (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS rank, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rank <= 3",
    }
