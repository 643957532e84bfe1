"""The engine's queries against their SQL in DuckDB, on a small table made here."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from vexel import queries

#: Building indexes takes seconds each; these cover every kind of query.
CHECKED = [
    "exact_l2_topk", "exact_cosine_topk", "exact_neg_ip_topk", "topk_offset", "topk_limit0", "ann_multi_cluster_full", "ann_multi_cluster_offset", "filtered_or_composite",
    "filtered_k_gt_passing", "filtered_rowid", "sql_topk", "blob_encode_words", "blob_decode", "base64_roundtrip", "blob_distance_left", "blob_cosine", "row_group_ids", "u8_params", "u8_codes",
    "knn_label_vote", "knn_self_join", "ann_pruned_l2", "ann_pruned_cosine", "ann_pruned_filtered", "null_vectors", "null_components", "high_limit", "changed_table", "sparse_keys",
    "sql_operator_l2", "sql_descending", "sql_label_first", "index_listing", "index_explain", "index_info_static", "filtered_rounds", "cluster_count_rule",
]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(450, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, x[i].tolist(), int(rng.integers(0, 10))) for i in range(len(x))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(path / "embeddings.parquet"))
    return str(path)


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, sf_dir, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet/*.parquet'")
    want = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = sorted(tuple(str(v) for v in r) for r in want.fetchall())
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(str(r[c]) for c in columns) for r in got.collect()) == rows


def test_names():
    assert set(queries.queries()) == set(queries.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
