"""The engine: tables, indexes, searches, SQL."""

from __future__ import annotations

import hashlib
import random
import tempfile
import time
import warnings
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.functions import distance
from vexel.operators import build as building
from vexel.operators.search import SearchPlan, as_query, batch_exact, execute, size_in_bytes
from vexel.plans import frontend, options, planner
from vexel.plans.options import IndexError_
from vexel.sources.registry import Registry


def fingerprint(df: DataFrame) -> str:
    """Tells a table's content from another's without reading rows: its plan, and its files and their size if it has any."""
    files = sorted(df.inputFiles())
    content = [*files, str(size_in_bytes(df))] if files else [str(df.semanticHash())]
    plan = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    return hashlib.sha256("\n".join([df.schema.simpleString(), plan, *content]).encode()).hexdigest()


class Engine:
    """Vector search over DataFrames.

    root: folder of the indexes; on a cluster one that all executors share.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        if root is None and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise IndexError_("the engine needs a folder that all executors share")
        self.registry = Registry(spark, root or tempfile.mkdtemp(prefix="vexel-"))
        self.tables: dict[str, tuple[DataFrame, str]] = {}
        distance.register(spark)

    # tables

    def register_table(self, name: str, df: DataFrame, key: str | None = None) -> DataFrame:
        """Names a table; key: a column of unique, non-negative longs. Without one, rows are numbered and kept as Parquet.

        Row groups are ranges of keys. Numbering counts rows by partition of the kept table and adds offsets, so
        no shuffle moves the rows.
        """
        if key is None:
            path = f"{self.registry.root}/.tables/{name.lower()}"
            df.withColumn("__at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
            kept = self.spark.read.parquet(path)
            part = F.shiftright("__at", 33)
            order = kept.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()
            starts, total = [], 0
            for r in order:  # one row per partition of the input
                starts.append((r["__part"], total))
                total += r["n"]
            offsets = self.spark.createDataFrame(starts or [(0, 0)], "__part long, __start long")
            df = kept.join(F.broadcast(offsets), part == F.col("__part")).withColumn("row_id", F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__start")
            key = "row_id"
        self.tables[name.lower()] = (df, key)
        df.createOrReplaceTempView(name)
        return df

    def table(self, name: str) -> tuple[DataFrame, str]:
        if name.lower() not in self.tables:
            raise IndexError_(f"there is no table '{name}'")
        return self.tables[name.lower()]

    # indexes

    def create_index(self, name: str, table: str, column: str | list[str], if_not_exists: bool = False, unique: bool = False, **given) -> bool:
        """Builds an index; gives whether one was made."""
        parsed = options.parse(given)
        if unique:
            raise IndexError_("indexes can't be unique")
        df, key = self.table(table)
        column = options.check_column(df.schema, [column] if isinstance(column, str) else column)
        if name.lower() in self.registry.entries:
            if if_not_exists:
                return False
            raise IndexError_(f"there is an index '{name}' already")
        parsed = replace(parsed, seed=random.randint(-options.SEEDS, options.SEEDS) if parsed.seed is None else parsed.seed)
        base = df.select(F.col(key).cast("long").alias("row_id"), F.col(column).alias("vec"))
        found = building.build(base, self.registry.path(name), parsed)
        self.registry.add(found | {
            "catalog_name": "spark_catalog", "schema_name": "default", "index_name": name, "table_name": table.lower(), "column_name": column, "key_name": key,
            "metric": parsed.metric.value, "quantization": parsed.quantization.value, "n_probe": parsed.n_probe, "seed": parsed.seed,
            "is_normalized": parsed.metric.value == "cosine", "rotate": parsed.rotate, "row_group_size": parsed.row_group_size, "created": time.time_ns(),
            "fingerprint": fingerprint(df),
        })
        return True

    def drop_index(self, name: str, if_exists: bool = False) -> bool:
        return self.registry.drop(name, if_exists)

    def index_info(self) -> DataFrame:
        return self.registry.info()

    # settings

    def set_n_probe(self, value: int | None) -> None:
        """Overrides the indexes' n_probe; None takes the override back."""
        if value is None:
            self.spark.conf.unset(planner.N_PROBE_KEY)
        else:
            self.spark.conf.set(planner.N_PROBE_KEY, str(int(value)))

    # searches

    def plan(self, table: str, column: str, query, k: int, metric: str = "l2sq", where: Column | str | None = None, offset: int = 0, n_probe: int | None = None, use_index: bool = True) -> SearchPlan:
        df, key = self.table(table)
        vector, blob = as_query(query)
        predicate = F.expr(where) if isinstance(where, str) else where
        index = self.registry.find(table, column, metric) if use_index else None
        if index is not None and index["fingerprint"] != fingerprint(df):
            warnings.warn(f"table '{table}' has changed since index '{index['index_name']}' was made: the search goes without it", stacklevel=2)
            index = None
        return planner.plan_search(
            df, key, column, metric, vector, k, offset, predicate, index, self.registry.path(index["index_name"]) if index else None,
            self.spark.conf.get(planner.N_PROBE_KEY, None), n_probe, blob, table,
        )

    def search(self, *args, **kwargs) -> DataFrame:
        """The table's columns and ``distance`` of the k nearest rows, nearest first."""
        return execute(self.plan(*args, **kwargs))

    def search_batch(self, table: str, column: str, queries: DataFrame, query_key: str, query_column: str, k: int, metric: str = "l2sq") -> DataFrame:
        df, key = self.table(table)
        return batch_exact(df, key, column, queries, query_key, query_column, metric, k)

    # SQL

    def sql(self, text: str) -> DataFrame:
        if m := frontend.CREATE.match(text):
            self.create_index(m[3], m[4], [c.strip() for c in m[6].split(",")], bool(m[2]), bool(m[1]), **frontend.options(m[7]))
            return self._done()
        if m := frontend.DROP.match(text):
            self.drop_index(m[2], bool(m[1]))
            return self._done()
        if m := frontend.SET.match(text):
            self.set_n_probe(None if m[1].upper() == "NULL" else int(m[1]))
            return self._done()
        if frontend.RESET.match(text):
            self.set_n_probe(None)
            return self._done()
        if frontend.INFO.match(text):
            return self.index_info()
        if frontend.LISTING.match(text):
            return self.index_info().select("catalog_name", "schema_name", "index_name", "table_name")
        if m := frontend.EXPLAIN.match(text):
            found = self._top(m[1])
            if found is not None:
                return self.spark.createDataFrame([(found[0].explain(),)], "plan string")
            return self.spark.sql(f"EXPLAIN {self._plain(m[1])}")
        found = self._top(text)
        if found is None:
            return self.spark.sql(self._plain(text))
        plan, select = found
        rows = execute(plan)
        if plan.key == "row_id" and "rowid" not in rows.columns:
            rows = rows.withColumn("rowid", F.col("row_id"))
        if select.strip() == "*":
            return rows.select(*plan.table.columns)
        return rows.select(*(F.expr(self._item(x.strip(), plan)) for x in frontend.split_top(select)))

    def _item(self, item: str, plan: SearchPlan) -> str:
        """A projected expression; the query's own distance comes from the search."""
        m = item.rsplit(" ", 2)
        body, alias = (m[0], m[2]) if len(m) == 3 and m[1].upper() == "AS" else (item, None)
        call = frontend.distance_call(body)
        if call and self._same(call, plan):
            return f"distance AS `{alias or 'distance'}`"
        return self._plain(item)

    def _same(self, call: tuple[str, str, str], plan: SearchPlan) -> bool:
        name, left, right = call
        if distance.NAMES[name] != plan.metric:
            return False
        side = right if left.lower() == plan.vector.lower() else left if right.lower() == plan.vector.lower() else None
        if side is None:
            return False
        value = self._constant(side)
        return value is not None and as_query(value)[0].tolist() == plan.query.tolist()

    def _done(self) -> DataFrame:
        return self.spark.createDataFrame([(True,)], "success boolean")

    def _plain(self, text: str) -> str:
        return frontend.inlined(frontend.operators(frontend.normalized(text), self._is_vector), self._is_blob, distance.inline)

    def _is_blob(self, operand: str) -> bool:
        names = {f.name.lower() for df, _ in self.tables.values() for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)}
        return operand.lower().split(".")[-1] in names or bool(frontend.BLOB.match(operand))

    def _is_vector(self, operand: str) -> bool:
        names = {f.name.lower() for df, _ in self.tables.values() for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.BinaryType))}
        return operand.lower().split(".")[-1] in names or bool(frontend.re.match(r"(cast\(array|encode_blob|base64_to_blob|array)", operand, frontend.re.I))

    def _constant(self, text: str):
        """Value of an expression without columns, or None."""
        try:
            row = self.spark.sql(f"SELECT {frontend.normalized(text)} AS v").first()
        except AnalysisException:  # it has columns, or does not parse: no constant
            return None
        return bytes(row["v"]) if isinstance(row["v"], (bytes, bytearray)) else row["v"] if isinstance(row["v"], list) else None

    def _top(self, text: str) -> tuple[SearchPlan, str] | None:
        """The search that a query stands for, and its select list, if it is a top-k query over a registered table."""
        m = frontend.TOP.match(text)
        if not m or m["table"].lower() not in self.tables:
            return None
        order = frontend.re.sub(r"\s+ASC\s*$", "", m["order"].strip(), flags=frontend.re.I)
        if frontend.re.search(r"\s(DESC|NULLS)\b", order, frontend.re.I) or len(frontend.split_top(order)) > 1:
            return None
        call = frontend.distance_call(order)
        if call is None:
            return None
        name, left, right = call
        df, _ = self.table(m["table"])
        arrays = {f.name.lower(): f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
        column, other = (arrays.get(left.lower()), right) if left.lower() in arrays else (arrays.get(right.lower()), left)
        if column is None:
            return None
        value = self._constant(other)
        if value is None:
            return None
        where = self._plain(m["where"]) if m["where"] else None
        if where and self.table(m["table"])[1] == "row_id":
            where = frontend.re.sub(r"\browid\b", "row_id", where, flags=frontend.re.I)
        return self.plan(m["table"], column, value, int(m["limit"]), distance.NAMES[name], where, int(m["offset"] or 0)), m["select"]
