"""Chooses how a top-k search runs: over an index where one fits, exactly otherwise."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, Row

from vexel.operators.search import SearchPlan
from vexel.plans.options import IndexError_

#: Session key that overrides the indexes' n_probe.
N_PROBE_KEY = "vexel.n_probe"
#: Searches for more rows than this go without an index.
MOST_INDEXED_K = 5000


def effective_n_probe(setting: str | None, index: Row) -> int:
    """Setting, else the index's value; negative settings are ignored."""
    if setting is None or str(setting).upper() == "NULL":
        return index["n_probe"]
    value = int(setting)
    if value < 0:
        warnings.warn(f"{N_PROBE_KEY} is negative and ignored", stacklevel=2)
        return index["n_probe"]
    return value


def plan_search(
    table: DataFrame, key: str, vector: str, metric: str, query: np.ndarray, k: int, offset: int = 0, predicate: Column | None = None,
    index: Row | None = None, path: str | None = None, setting: str | None = None, n_probe: int | None = None, blob: bool = False, table_name: str = "",
) -> SearchPlan:
    if k < 0 or offset < 0:
        raise IndexError_("LIMIT and OFFSET must not be negative")
    if index is not None:
        if len(query) != index["num_dimensions"]:
            raise IndexError_(f"the query has {len(query)} dimensions, the index {index['num_dimensions']}")
        if k + offset > MOST_INDEXED_K or not np.isfinite(query).all():
            index = None
    probes = 0 if index is None else n_probe if n_probe is not None else effective_n_probe(setting, index)
    return SearchPlan(table, key, vector, metric, query, k, offset, predicate, index, path if index is not None else None, probes, blob, table_name)
