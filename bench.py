"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vexel.engine import Engine


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    e = Engine(spark)
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e.register_table("emb", df, "vec_id")
    n = df.count()

    def many(name: str, copies: int) -> None:
        """The same vectors shifted a little, many times over: enough rows for full row groups and the default clusters."""
        each = df.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        moved = F.transform("embedding", lambda x, i: (x + (F.pmod(F.xxhash64("vec_id", "id", i), F.lit(1000)) / 5000.0)).cast("float"))
        path = f"{e.registry.root}/{name}"
        each.select((F.col("vec_id") + F.col("id") * n).alias("vec_id"), moved.alias("embedding")).repartitionByRange(int(cpus), "vec_id").sortWithinPartitions("vec_id").write.parquet(path)
        e.register_table(name, spark.read.parquet(path), "vec_id")

    many("wide", 60)
    many("million", -(-1_000_000 // n))
    q = np.asarray(df.where("vec_id = 0").first()["embedding"], np.float32)
    seconds: dict[str, float] = {}

    def timed(name: str, run, repeat: int = 3) -> None:
        run()
        best = min(_seconds(run) for _ in range(repeat))
        seconds[name] = round(best, 3)

    timed("exact_l2_top10", lambda: e.search("emb", "embedding", q, 10).collect())
    timed("exact_cosine_top10", lambda: e.search("emb", "embedding", q, 10, "cosine").collect())
    timed("wide_exact_l2_top10", lambda: e.search("wide", "embedding", q, 10, use_index=False).collect())
    seconds["wide_build_u8"] = round(_seconds(lambda: e.create_index("u8", "wide", "embedding", seed=1)), 3)
    timed("wide_ann_u8_top10", lambda: e.search("wide", "embedding", q, 10).collect())
    timed("wide_filtered_u8_top10", lambda: e.search("wide", "embedding", q, 10, where="vec_id % 10 = 3").collect())
    e.drop_index("u8")
    some = "vec_id % 10 = 3"
    timed("million_exact_l2_top10", lambda: e.search("million", "embedding", q, 10, use_index=False).collect())
    timed("million_exact_filtered_top10", lambda: e.search("million", "embedding", q, 10, where=some, use_index=False).collect())
    seconds["million_build_u8"] = round(_seconds(lambda: e.create_index("u8", "million", "embedding", seed=1)), 3)
    timed("million_ann_u8_top10", lambda: e.search("million", "embedding", q, 10).collect())
    timed("million_filtered_u8_top10", lambda: e.search("million", "embedding", q, 10, where=some).collect())
    e.drop_index("u8")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


def _seconds(run) -> float:
    began = time.time()
    run()
    return time.time() - began


if __name__ == "__main__":
    main()
