"""Exact distances between vectors, as JVM expressions and as SQL functions.

Operands are ARRAY<FLOAT> columns, lists, numpy arrays or blobs; a column of blobs is passed through ``decode_blob``. All
sums are in double. NULL operands give NULL; operands of different length are an error. A zero vector has cosine distance
NaN to others, and 2.0 where an operand is a blob.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from vexel.functions import codec

#: SQL names of the functions, and the operators that stand for them.
NAMES = {"array_distance": "l2sq", "array_cosine_distance": "cosine", "array_negative_inner_product": "ip"}
OPERATORS = {"<->": "array_distance", "<=>": "array_cosine_distance", "<#>": "array_negative_inner_product"}


def operand(value) -> Column:
    if isinstance(value, Column):
        return value.cast("array<double>")
    return F.array(*(F.lit(float(x)) for x in codec.constant(value)))


def _sum(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda acc, x: acc + x)


def _checked(a: Column, b: Column, value: Column) -> Column:
    message = F.concat(F.lit("vectors differ in length: "), F.size(a), F.lit(" and "), F.size(b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) != F.size(b), F.raise_error(message).cast("double")).otherwise(value)


def l2_distance(a, b) -> Column:
    x, y = operand(a), operand(b)
    return _checked(x, y, F.sqrt(_sum(x, y, lambda p, q: (p - q) * (p - q))))


def negative_inner_product(a, b) -> Column:
    x, y = operand(a), operand(b)
    return _checked(x, y, -_sum(x, y, lambda p, q: p * q))


def cosine_distance(a, b) -> Column:
    blob = any(isinstance(v, (bytes, bytearray)) for v in (a, b))
    x, y = operand(a), operand(b)
    norms = F.sqrt(_sum(x, x, lambda p, q: p * q) * _sum(y, y, lambda p, q: p * q))
    cosine = _sum(x, y, lambda p, q: p * q) / norms
    # least and greatest would pass over the NULL that a NULL component makes
    value = F.when(norms == 0, F.lit(2.0 if blob else math.nan)).when(cosine.isNull(), F.lit(None)).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    return _checked(x, y, value)


BY_METRIC = {"l2sq": l2_distance, "cosine": cosine_distance, "ip": negative_inner_product}


#: The distances in SQL, of vectors {a} and {b} of doubles.
_DOT = "aggregate(zip_with({}, {}, (p, q) -> p * q), 0D, (s, x) -> s + x)"
_AA, _BB, _AB = _DOT.format("{a}", "{a}"), _DOT.format("{b}", "{b}"), _DOT.format("{a}", "{b}")
_SQL = {
    "l2sq": "sqrt(aggregate(zip_with({a}, {b}, (p, q) -> (p - q) * (p - q)), 0D, (s, x) -> s + x))",
    "ip": f"-{_AB}",
    "cosine": f"if({_AA} = 0 OR {_BB} = 0, double('NaN'), {_AB} * 0 + 1 - greatest(-1D, least(1D, {_AB} / sqrt({_AA} * {_BB}))))",
}


def body(name: str, a: str, b: str) -> str:
    """The distance of that SQL name between a and b, which are names of array<double>."""
    differ = f"raise_error(concat('vectors differ in length: ', size({a}), ' and ', size({b})))"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN size({a}) <> size({b}) THEN {differ} ELSE float({_SQL[NAMES[name.lower()]].format(a=a, b=b)}) END"


def inline(name: str, a: str, b: str) -> str:
    """The same for any expressions a and b, which are taken once; unlike a function of SQL it may stand in ORDER BY."""
    pair = f"named_struct('a', CAST({a} AS ARRAY<DOUBLE>), 'b', CAST({b} AS ARRAY<DOUBLE>))"
    return f"element_at(transform(array({pair}), t -> {body(name, 't.a', 't.b')}), 1)"


def register(spark: SparkSession) -> None:
    """Registers the SQL functions, all JVM expressions: distances between arrays, and the codec.

    The engine's SQL puts the expressions themselves in place of calls, and takes blobs as operands, which it decodes;
    elsewhere ``decode_blob`` does.
    """

    def create(head: str, kind: str, text: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {text}")

    for name in NAMES:
        create(f"{name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)", "FLOAT", body(name, "a", "b"))
    create("encode_blob(v ARRAY<FLOAT>)", "BINARY", codec.ENCODE_SQL)
    create("decode_blob(v BINARY)", "ARRAY<FLOAT>", codec.DECODE_SQL)
    create("blob_to_base64(v BINARY)", "STRING", r"replace(base64(v), '\r\n', '')")
    create("base64_to_blob(v STRING)", "BINARY", "to_binary(v, 'base64')")
