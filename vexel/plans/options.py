"""Options of an index and their checks."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

#: Bounds and defaults of the options, rows of a row group, and clusters by rows of a row group.
MAX_DIMENSIONS = 16384
DEFAULT_N_PROBE = 24
ROW_GROUP_SIZE = 122_880
MOST_CLUSTERS = 480
SEEDS = 2147483647
#: Probes added in each further round of a filtered search.
ROUND = 5


class IndexError_(ValueError):
    """A statement on an index that can't be carried out."""


class Metric(str, Enum):
    L2SQ = "l2sq"
    COSINE = "cosine"


class Quantization(str, Enum):
    U8 = "u8"
    F32 = "f32"


def cluster_count(rows: int) -> int:
    if rows < 2048:
        return 1
    return 120 if rows < ROW_GROUP_SIZE * 0.25 else MOST_CLUSTERS


@dataclass(frozen=True)
class IndexOptions:
    metric: Metric = Metric.L2SQ
    quantization: Quantization = Quantization.U8
    n_probe: int = DEFAULT_N_PROBE
    seed: int | None = None
    #: Beyond SQL's options: rows of a row group, clusters of each (None: by rule), and whether vectors are rotated.
    row_group_size: int = ROW_GROUP_SIZE
    clusters_per_row_group: int | None = None
    rotate: bool = False


def is_int(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def parse(given: dict) -> IndexOptions:
    """Checks options by name, whose case does not matter, in the order given."""
    out = {}
    for key, value in given.items():
        name = key.lower()
        if name in ("metric", "quantization"):
            kind = Metric if name == "metric" else Quantization
            if not isinstance(value, str):
                raise IndexError_(f"{name} takes a name in quotes")
            if value not in [m.value for m in kind]:
                raise IndexError_(f"{name} knows only " + " and ".join(f"'{m.value}'" for m in kind))
            out[name] = kind(value)
        elif name == "n_probe":
            if not is_int(value) or abs(value) > SEEDS + 1:
                raise IndexError_("n_probe takes a whole number")
            if value < 0:
                raise IndexError_(f"n_probe counts clusters and can't be negative; without it {DEFAULT_N_PROBE} are probed")
            out[name] = value
        elif name == "seed":
            if not is_int(value) or abs(value) > SEEDS:
                raise IndexError_(f"seed takes a whole number from -{SEEDS} to {SEEDS}")
            out[name] = value
        elif name in ("row_group_size", "clusters_per_row_group"):
            if not is_int(value) or value < 1:
                raise IndexError_(f"{name} takes a whole number from 1 on")
            out[name] = value
        elif name == "rotate":
            out[name] = bool(value)
        else:
            raise IndexError_(f"indexes have no option '{key}'")
    return IndexOptions(**out)


def check_column(schema: T.StructType, columns: list[str]) -> str:
    """The one indexed column, an array of floats."""
    if len(columns) != 1:
        raise IndexError_("an index is made over a single column")
    by_name = {f.name.lower(): f for f in schema.fields}
    field = by_name.get(columns[0].lower())
    if field is None:
        raise IndexError_(f"there is no column '{columns[0]}'")
    if not isinstance(field.dataType, T.ArrayType):
        raise IndexError_("index keys must be arrays of FLOAT")
    if not isinstance(field.dataType.elementType, T.FloatType):
        raise IndexError_("the element type of index keys must be FLOAT")
    return field.name
