"""The engine: distances, codec, options, indexes, searches, SQL."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vexel.engine import Engine
from vexel.functions import codec, distance
from vexel.operators import kernels, search
from vexel.operators.search import last_round, readable
from vexel.plans import frontend, options
from vexel.plans.options import IndexError_, cluster_count

SMALL = {"row_group_size": 400, "clusters_per_row_group": 12, "seed": 3}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24)) * 2
    return (centres[np.arange(1200) % 12] + rng.normal(size=(1200, 24))).astype(np.float32)


@pytest.fixture(scope="module")
def engine(spark, vectors):
    e = Engine(spark)
    rows = [(i, vectors[i].tolist(), i % 7) for i in range(len(vectors))] + [(5000, None, 1)]
    e.register_table("t", spark.createDataFrame(rows, "id long, emb array<float>, grp int").repartition(3), "id")
    return e


def truth(x, q, k, mask=None, metric="l2sq"):
    x, q = x.astype(np.float64), np.asarray(q, np.float64)
    d = ((x - q) ** 2).sum(1) if metric == "l2sq" else 1 - (x @ q) / np.linalg.norm(x, axis=1) / np.linalg.norm(q) if metric == "cosine" else -(x @ q)
    at = np.arange(len(x)) if mask is None else np.flatnonzero(mask)
    return at[np.argsort(d[at], kind="stable")][:k].tolist()


def ids(df):
    return [r["id"] for r in df.collect()]


# codec and distances


@given(st.lists(st.floats(-81.875, 81.875, width=32, allow_subnormal=False), max_size=40))
@settings(max_examples=200, deadline=None)
def test_codec_error(values):
    back = codec.decode(codec.encode(values))
    assert len(back) == len(values)
    assert all(abs(a - b) <= 0.0051 for a, b in zip(values, back))


def test_codec_words():
    assert codec.encode([0.0, 1.0, -1.0, 81.91, 200.0, -200.0]) == np.array([0, 1000 << 2 | 2, (-1000) << 2 | 2, 8191 << 2 | 3, 8191 << 2 | 3, (-8192) << 2 | 3], "<i2").tobytes()
    assert codec.decode(b"\x00\x00\xff").tolist() == [0.0]
    for bad in (math.nan, math.inf):
        with pytest.raises(ValueError):
            codec.encode([bad])


def test_codec_in_expressions(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=9) * 10.0 ** rng.integers(-4, 3)).astype(np.float32).tolist()) for i in range(200)] + [(500, None), (501, [])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = df.select("id", codec.encode_blob(F.col("v")).alias("b")).withColumn("back", codec.decode_blob(F.col("b"))).withColumn("same", codec.base64_to_blob(codec.blob_to_base64(F.col("b"))) == F.col("b")).collect()
    for (i, v), r in zip(rows, sorted(got, key=lambda r: r["id"])):
        if v is None:
            assert r["b"] is None and r["back"] is None
        else:
            assert bytes(r["b"]) == codec.encode(v) and np.array(r["back"], np.float32).tolist() == codec.decode(codec.encode(v)).tolist() and r["same"]
    with pytest.raises(Exception, match="NaN"):
        spark.createDataFrame([([float("nan")],)], "v array<float>").select(codec.encode_blob(F.col("v"))).collect()
    with pytest.raises(Exception):
        spark.createDataFrame([("no base64!",)], "s string").select(codec.base64_to_blob(F.col("s"))).collect()


def test_distances(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None)], "id long, v array<float>")
    q = [1.0, 0.0, 0.0]
    for given_q in (q, np.array(q), codec.encode(q)):
        got = df.select("id", distance.l2_distance(F.col("v"), given_q).alias("l"), distance.cosine_distance(given_q, F.col("v")).alias("c"), distance.negative_inner_product(F.col("v"), given_q).alias("p")).orderBy("id").collect()
        assert [round(r["l"], 2) for r in got[:3]] == [0, 1.41, 1] and [round(r["c"], 4) for r in got[:2]] == [0, 1] and [r["p"] for r in got[:3]] == [-1, 0, 0]
        assert (got[2]["c"] == 2.0) if isinstance(given_q, bytes) else math.isnan(got[2]["c"])
        assert got[3]["l"] is None and got[3]["c"] is None and got[3]["p"] is None
    with pytest.raises(Exception, match="differ in length"):
        df.select(distance.l2_distance(F.col("v"), [1.0])).collect()


def test_sql_functions(engine):
    got = engine.sql("SELECT round(array_distance(encode_blob([1.0, 0.0]), [0.0, 1.0]::FLOAT[2]), 2) a, round(x_encode_blob([1.0, 0.0]) <=> [0.0, 1.0], 2) b, [1.0, 2.0] <-> [1.0, 2.0] c, [1.0] <#> [3.0] d, 1 <=> 1 e, base64_to_blob(blob_to_base64(encode_blob([0.5]))) = encode_blob([0.5]) f").first()
    assert [round(x, 2) if isinstance(x, float) else x for x in got] == [1.41, 1.0, 0.0, -3.0, True, True]


# options and statements


@pytest.mark.parametrize("bad, message", [
    ({"metric": 1}, "name in quotes"), ({"metric": "test"}, "'l2sq' and 'cosine'"), ({"quantization": 1}, "name in quotes"), ({"quantization": "test"}, "'u8' and 'f32'"),
    ({"n_probe": "test"}, "whole number"), ({"n_probe": -1}, "negative"), ({"n_probe": -7}, "negative"), ({"seed": "test"}, "from -2147483647"), ({"seed": 2147483648}, "from -2147483647"),
    ({"seed": -2147483648}, "from -2147483647"), ({"other": 1}, "no option"),
])
def test_bad_options(bad, message):
    with pytest.raises(IndexError_, match=message):
        options.parse(bad)


def test_good_options():
    for good in ({"metric": "l2sq", "quantization": "f32", "n_probe": 128, "seed": 0}, {"METRIC": "cosine"}, {"n_probe": 0}, {"n_probe": 31337}, {"seed": -2147483647}, {"seed": 2147483647}):
        options.parse(good)
    assert [cluster_count(n) for n in (1, 2047, 2048, 30719, 30720, 122880)] == [1, 1, 120, 120, 480, 480]
    assert [readable(n) for n in (999, 1000, 1_500_000, 2 * 10**9, 3 * 10**12)] == ["999 bytes", "1.00 kB", "1.50 MB", "2.00 GB", "3.00 TB"]


def test_columns(spark):
    e = Engine(spark)
    df = spark.createDataFrame([(1, [1.0], 2.0, [1.0])], "id long, d array<double>, f float, v array<float>")
    e.register_table("bad", df, "id")
    for column, message in (("d", "must be FLOAT"), ("f", "arrays of FLOAT"), (["v", "d"], "single column"), ("nope", "no column")):
        with pytest.raises(IndexError_, match=message):
            e.create_index("i", "bad", column)
    e.register_table("none", df.limit(0), "id")
    with pytest.raises(IndexError_, match="empty"):
        e.create_index("i", "none", "v")
    e.register_table("uneven", spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<float>"), "id")
    with pytest.raises(IndexError_, match="differ in length"):
        e.create_index("i", "uneven", "v")
    e.register_table("wide", spark.range(2).select("id", F.array_repeat(F.lit(1.0).cast("float"), 16385).alias("v")), "id")
    with pytest.raises(IndexError_, match="at most 16384"):
        e.create_index("i", "wide", "v")
    with pytest.raises(IndexError_, match="no table"):
        e.create_index("i", "nowhere", "v")
    with pytest.raises(IndexError_, match="unique"):
        e.sql("CREATE UNIQUE INDEX i ON bad USING ivf (v)")


def test_statements(engine):
    engine.sql("CREATE INDEX a1 ON t USING ivf (emb) WITH (metric = 'cosine', quantization = 'f32', n_probe = 128, seed = 0)")
    with pytest.raises(IndexError_, match="already"):
        engine.sql("CREATE INDEX a1 ON t USING ivf (emb)")
    engine.sql("CREATE INDEX IF NOT EXISTS a1 ON t USING ivf (emb)")
    row = engine.sql("CALL my_index_info()").first()
    assert (row["index_name"], row["metric"], row["num_dimensions"], row["n_probe"], row["seed"], row["is_normalized"]) == ("a1", "cosine", 24, 128, 0, True)
    assert row["approx_lower_bound_memory_usage_bytes"] >= 1200 * 24 * 4
    assert engine.sql("FROM all_indexes()").count() == 1
    # a later session finds the index
    assert Engine(engine.spark, engine.registry.root).registry.find("t", "emb", "cosine")["index_name"] == "a1"
    engine.sql("DROP INDEX a1")
    engine.sql("DROP INDEX IF EXISTS a1")
    with pytest.raises(IndexError_):
        engine.sql("DROP INDEX a1")
    with pytest.raises(IndexError_):
        engine.sql("CREATE INDEX b ON t USING ivf (emb) WITH (metric = 1)")


def test_front_end_pieces():
    assert frontend.options("metric = 'l2sq', n_probe=-1, seed = 0") == {"metric": "l2sq", "n_probe": -1, "seed": 0}
    assert frontend.split_top("a, f(b, [c, d]), 'x, y'") == ["a", " f(b, [c, d])", " 'x, y'"]
    assert frontend.distance_call("emb <-> [1, 2]") == ("array_distance", "emb", "[1, 2]")
    assert frontend.distance_call("id") is None


# searches


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_exact(engine, vectors, metric):
    q = vectors[5] + 0.1
    assert ids(engine.search("t", "emb", q, 10, metric, use_index=False)) == truth(vectors, q, 10, metric=metric)
    assert ids(engine.search("t", "emb", q, 5, metric, use_index=False, offset=3)) == truth(vectors, q, 8, metric=metric)[3:]
    assert engine.search("t", "emb", q, 0, metric).count() == 0
    with pytest.raises(IndexError_):
        engine.search("t", "emb", q, -1, metric)


def test_exact_by_arrow(engine, vectors, monkeypatch):
    monkeypatch.setattr("vexel.operators.search.ARROW_FROM", 0)
    for metric in ("l2sq", "cosine", "ip"):
        assert ids(engine.search("t", "emb", vectors[9], 10, metric, use_index=False, where="grp = 3", offset=2)) == truth(vectors, vectors[9], 12, np.arange(1200) % 7 == 3, metric)[2:]


@pytest.mark.parametrize("quantization", ["f32", "u8"])
@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_index(engine, vectors, metric, quantization):
    engine.create_index("i", "t", "emb", metric=metric, quantization=quantization, n_probe=2, **SMALL)
    try:
        q = (vectors[5] + vectors[6] + vectors[7]) / 3
        want = truth(vectors, q, 50, metric=metric)
        recalls = []
        for n in (1, 2, 4, 8, 12, 0):
            found = ids(engine.search("t", "emb", q, 50, metric, n_probe=n))
            assert 0 < len(found) <= 50
            recalls.append(len(set(found) & set(want)) / 50)
        assert recalls == sorted(recalls) or quantization == "u8"
        assert recalls[0] < 1 and recalls[-1] >= (1 if quantization == "f32" else 0.9)
        for limit in (0, 1, 2, 17, 50, 63):
            found = ids(engine.search("t", "emb", q, 50, metric, where=f"id < {limit}", n_probe=1))
            assert len(found) == min(50, limit) and all(i < limit for i in found)
        for one in (0, 25, 1199):
            assert ids(engine.search("t", "emb", q, 50, metric, where=f"id = {one}")) == [one]
        assert len(ids(engine.search("t", "emb", q, 50, metric, where="id > 1190", n_probe=1))) == 9
        mixed = ids(engine.search("t", "emb", q, 10, metric, where=(F.col("grp") == 2) | (F.col("id") % 11 == 4), n_probe=0))
        best = truth(vectors, q, 10, (np.arange(1200) % 7 == 2) | (np.arange(1200) % 11 == 4), metric)
        assert mixed == best if quantization == "f32" else len(set(mixed) & set(best)) >= 8
        assert "Total Clusters: 36\n  Row Groups: 3" in engine.plan("t", "emb", q, 5, metric).explain()
        assert engine.plan("t", "emb", q, 6000, metric).index is None
        with pytest.raises(IndexError_, match="dimensions"):
            engine.search("t", "emb", [1.0], 5, metric)
    finally:
        engine.drop_index("i")


def test_window_ranks_as_driver(engine, vectors, monkeypatch):
    engine.create_index("i", "t", "emb", quantization="f32", n_probe=2, **SMALL)
    try:
        want = ids(engine.search("t", "emb", vectors[8], 20)), ids(engine.search("t", "emb", vectors[8], 20, where="grp = 1"))
        monkeypatch.setattr("vexel.operators.search.RANKED_ON_DRIVER", 0)
        assert (ids(engine.search("t", "emb", vectors[8], 20)), ids(engine.search("t", "emb", vectors[8], 20, where="grp = 1"))) == want
    finally:
        engine.drop_index("i")


@pytest.mark.parametrize("ranked_on_driver", [50_000, 0])
def test_few_passing_rows_go_without_a_scan_of_all_ranks(engine, vectors, monkeypatch, ranked_on_driver):
    """Few passing rows: the rows found are those of the rounds, and no other row group's clusters are ranked."""
    engine.create_index("i", "t", "emb", quantization="f32", n_probe=1, **SMALL)
    monkeypatch.setattr("vexel.operators.search.RANKED_ON_DRIVER", ranked_on_driver)
    cases = [(where, k, n, offset) for where in ("id < 3", "id < 60", "grp = 1 AND id > 300") for k, n, offset in ((20, 1, 0), (5, 3, 2), (500, 1, 0), (20, 0, 0))] + [("grp = 1", 20, 480, 0), ("id < 0", 3, 1, 0)]

    def found():
        return [ids(engine.search("t", "emb", vectors[8], k, where=where, n_probe=n, offset=offset)) for where, k, n, offset in cases]

    try:
        with monkeypatch.context() as m:
            m.setattr("vexel.operators.search.COLLECTED", -1)
            want = found()
        monkeypatch.setattr("vexel.operators.search.with_ranks", None)
        assert found() == want and any(want)
    finally:
        engine.drop_index("i")


def test_sql_search(engine, vectors):
    engine.create_index("i", "t", "emb", quantization="f32", n_probe=1, **SMALL)
    try:
        q = ", ".join(str(float(x)) for x in vectors[3])
        engine.sql("SET any_n_probe = 0")
        text = f"SELECT id, emb <-> [{q}] AS d FROM t WHERE grp < 4 OR id = 3 ORDER BY array_distance([{q}]::FLOAT[24], emb) LIMIT 10 OFFSET 2"
        assert ids(engine.sql(text)) == truth(vectors, vectors[3], 12, (np.arange(1200) % 7 < 4) | (np.arange(1200) == 3))[2:]
        assert "VECTOR_INDEX_FILTERED_SCAN" in engine.sql(f"EXPLAIN {text}").first()[0]
        assert engine.sql(f"SELECT * FROM t ORDER BY emb <-> [{q}] LIMIT 3").columns == ["id", "emb", "grp"]
        assert "VECTOR_INDEX_SCAN" in engine.sql(f"EXPLAIN SELECT id FROM t ORDER BY emb <-> encode_blob([{q}]) LIMIT 3").first()[0]
        assert "EXACT_SCAN" in engine.sql(f"EXPLAIN SELECT id FROM t ORDER BY emb <=> [{q}] LIMIT 3").first()[0]
        # not a single ascending distance: Spark's own plan
        assert ids(engine.sql(f"SELECT id FROM t WHERE emb IS NOT NULL ORDER BY array_distance(emb, cast(array({q}) AS array<float>)) DESC, id LIMIT 1")) == [int(np.argmax(((vectors - vectors[3]) ** 2).sum(1)))]
        with pytest.warns(UserWarning):
            engine.sql("SET any_n_probe = -3")
            assert engine.plan("t", "emb", vectors[3], 5).n_probe == 1
    finally:
        engine.sql("RESET any_n_probe")
        engine.drop_index("i")


def test_equal_and_toy_vectors(spark):
    e = Engine(spark)
    e.register_table("zeros", spark.range(3000).select("id", F.array_repeat(F.lit(0.0).cast("float"), 29).alias("v")), "id")
    e.register_table("toy", spark.range(50).select("id", F.array_repeat(F.col("id").cast("float"), 29).alias("v")), "id")
    for metric in ("l2sq", "cosine"):
        e.create_index(f"z_{metric}", "zeros", "v", metric=metric, seed=1)
        assert e.search("zeros", "v", [0.0] * 29, 50, metric).count() == 50
    for quantization in ("f32", "u8"):
        e.create_index("toy_i", "toy", "v", quantization=quantization, seed=1)
        assert sorted(ids(e.search("toy", "v", [7.2] * 29, 50))) == list(range(50))
        assert ids(e.search("toy", "v", [7.2] * 29, 1)) == [7]
        e.drop_index("toy_i")


def test_numbered_rows(spark):
    e = Engine(spark)
    df = e.register_table("n", spark.range(100).repartition(3).select(F.array(F.col("id").cast("float")).alias("v"), "id"))
    assert sorted(r["row_id"] for r in df.collect()) == list(range(100))
    got = e.sql("SELECT id, rowid FROM n WHERE rowid > 10 ORDER BY v <-> [50.0] LIMIT 3").collect()
    assert all(r["rowid"] > 10 for r in got) and len(got) == 3


@pytest.mark.parametrize("arrow_from", [64 << 20, 0])
def test_null_components(spark, monkeypatch, arrow_from):
    """Small and large tables give the same rows: those with NULL components are never found."""
    monkeypatch.setattr("vexel.operators.search.ARROW_FROM", arrow_from)
    e = Engine(spark)
    e.register_table("holes", spark.createDataFrame([(1, [1.0, 0.0]), (2, [None, 0.0]), (3, [5.0, 5.0]), (4, None)], "id long, v array<float>"), "id")
    for metric in ("l2sq", "cosine", "ip"):
        assert sorted(ids(e.search("holes", "v", [1.0, 0.0], 4, metric))) == [1, 3]
    got = e.search_batch("holes", "v", spark.createDataFrame([(9, [1.0, 0.0])], "q long, w array<float>"), "q", "w", 4).collect()
    assert sorted(r["row_id"] for r in got) == [1, 3]
    with pytest.raises(IndexError_, match="NULL components"):
        e.create_index("i", "holes", "v")


def test_changed_tables_go_without_their_index(engine, vectors, spark):
    e = Engine(spark)
    first, second = (spark.createDataFrame([(i, vectors[i].tolist()) for i in part], "id long, emb array<float>") for part in (range(100), range(100, 200)))
    e.register_table("c", first, "id")
    e.create_index("i", "c", "emb", seed=1)
    assert e.plan("c", "emb", vectors[0], 3).index is not None
    e.register_table("c", second, "id")
    with pytest.warns(UserWarning, match="changed"):
        assert ids(e.search("c", "emb", vectors[150], 5))[0] == 150
    e.register_table("c", first, "id")
    assert e.plan("c", "emb", vectors[0], 3).index is not None


def test_keys(spark):
    """Sparse keys make as few row groups as dense ones; keys that repeat or are negative are errors."""
    e = Engine(spark)
    v = F.array((F.col("id") % 50).cast("float"), F.col("id").cast("float"))
    e.register_table("sparse", spark.range(200).select((F.col("id") * 1_000_000).alias("id"), v.alias("v")), "id")
    e.create_index("i", "sparse", "v", quantization="f32", row_group_size=80, clusters_per_row_group=4, seed=1)
    assert e.registry.entries["i"]["row_groups"] == 3
    assert ids(e.search("sparse", "v", [3.0, 3.0], 3, n_probe=0)) == [3_000_000, 2_000_000, 4_000_000]
    for name, key in (("twice", F.col("id") % 3), ("negative", F.col("id") - 1), ("none", F.when(F.col("id") > 0, F.col("id")))):
        e.register_table(name, spark.range(9).select(key.alias("id"), v.alias("v")), "id")
        with pytest.raises(IndexError_, match="keys must"):
            e.create_index("j", name, "v")


def test_scans_get_ids_and_clusters(engine, vectors, spark, tmp_path):
    """Plans push the ids found to the table, and pairs of row group and cluster to the codes."""
    e = Engine(spark, str(tmp_path / "indexes"))
    engine.table("t")[0].sort("id").write.parquet(str(tmp_path / "t"))
    e.register_table("t", spark.read.parquet(str(tmp_path / "t")), "id")
    e.create_index("i", "t", "emb", quantization="f32", n_probe=2, **SMALL)
    plan = e.search("t", "emb", vectors[5], 4)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(id, [" in plan
    codes = spark.read.schema(search.CODES).parquet(f"{e.registry.path('i')}/codes")
    text = search.with_ranks(spark, e.plan("t", "emb", vectors[5], 4), vectors[5], codes, 0, 2)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(row_group_id" in text and "In(cluster_id" in text or "EqualTo(cluster_id" in text


@pytest.mark.parametrize("dimensions", [1, 3, 31, 64, 129, 500, 4096])
def test_dimensions(spark, dimensions):
    rng = np.random.default_rng(dimensions)
    n = 600 if dimensions < 1000 else 60
    x = (rng.normal(size=(n, dimensions)) * 5 + (np.arange(n) % 48)[:, None]).astype(np.float32)
    e = Engine(spark)
    e.register_table("d", spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "id long, v array<float>"), "id")
    for quantization, least in (("f32", 1.0), ("u8", 0.8)):
        e.create_index("i", "d", "v", quantization=quantization, row_group_size=300, clusters_per_row_group=6, seed=0)
        found = ids(e.search("d", "v", x[7], 20, n_probe=0))
        assert len(set(found) & set(truth(x, x[7], 20))) >= least * 20
        e.drop_index("i")


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_recall_over_random_vectors(spark, metric):
    x = np.random.default_rng(9).random((10_000, 128)).astype(np.float32)
    e = Engine(spark)
    e.register_table("r", spark.createDataFrame(list(enumerate(x.tolist())), "id long, v array<float>").repartition(4), "id")
    e.create_index("i", "r", "v", metric=metric, seed=0)
    found = ids(e.search("r", "v", x[3], 50, metric, n_probe=0))
    assert len(set(found) & set(truth(x, x[3], 50, metric=metric))) >= 0.95 * 50


def test_batch(engine, vectors, spark):
    asked = spark.createDataFrame([(i, vectors[i].tolist()) for i in (0, 7, 500)], "qid long, q array<float>")
    got = engine.search_batch("t", "emb", asked, "qid", "q", 4).collect()
    for i in (0, 7, 500):
        assert [r["row_id"] for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])] == truth(vectors, vectors[i], 4)


# kernels


def test_kernels():
    x = np.random.default_rng(2).normal(size=(500, 16)).astype(np.float32)
    r = kernels.rotation(16, 5)
    assert np.allclose(r @ r.T, np.eye(16), atol=1e-5)
    assert np.allclose(np.linalg.norm(kernels.normalized(np.vstack([x, np.zeros((1, 16))])), axis=1), [1] * 500 + [0], atol=1e-6)
    base, scale = kernels.quantizer(float(x.min()), float(x.max()))
    codes = kernels.quantized(x, base, scale)
    assert codes.min() == 0 and codes.max() == 255 and np.abs(codes / scale + base - x).max() <= 0.51 / scale
    assert kernels.quantizer(1.0, 1.0) == (1.0, 1.0)
    c = kernels.kmeans(x, 20, 1, False)
    assert c.shape == (20, 16) and len(set(kernels.nearest_centroid(x, c))) > 10
    d = np.array([3.0, 1.0, np.nan, 1.0, 2.0] * 10)
    assert kernels.top(d, np.arange(50), 4).tolist() == [1, 3, 6, 8]
    assert last_round([(2, 5), (0, 3), (1, 0)], 3) == 0 and last_round([(2, 5), (0, 3)], 4) == 2 and last_round([(0, 3)], 4) is None
