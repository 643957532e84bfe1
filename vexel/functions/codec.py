"""Compact vectors: 16-bit words in a binary value, little endian, two bytes a component, no header.

The two low bits of a word choose a scale, the other 14 hold a signed number; the value is number times scale. Encoding
takes the smallest scale whose rounded number fits and clamps at the largest. NULL gives NULL, a trailing odd byte is
ignored, and NaN or infinite components are errors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: scales by their number, and their inverses.
SCALES = (0.00001, 0.0001, 0.001, 0.01)
INVERSES = (100000.0, 10000.0, 1000.0, 100.0)
LOWEST, HIGHEST = -8192, 8191


def encode(values: np.ndarray | list) -> bytes:
    """The words of one vector, with float32 arithmetic."""
    v = np.asarray(values, np.float32)
    if not np.isfinite(v).all():
        raise ValueError("vectors with NaN or infinite components can't be encoded")
    words = np.full(len(v), -1, np.int32)
    open_ = np.ones(len(v), bool)
    for i, inverse in enumerate(INVERSES):
        scaled = (v * np.float32(inverse)).astype(np.float64)
        q = np.copysign(np.floor(np.abs(scaled) + 0.5), scaled)
        if i == len(INVERSES) - 1:
            q = np.clip(q, LOWEST, HIGHEST)
        fits = open_ & (q >= LOWEST) & (q <= HIGHEST)
        words[fits] = q[fits].astype(np.int32) << 2 | i
        open_ &= ~fits
    return words.astype("<i2").tobytes()


def decode(blob: bytes) -> np.ndarray:
    w = np.frombuffer(blob, "<i2", len(blob) // 2).astype(np.int32)
    return (w >> 2).astype(np.float32) * np.array(SCALES, np.float32)[w & 3]


def encode_blob(vector: Column) -> Column:
    """ARRAY<FLOAT> to BINARY in JVM expressions."""

    def word(x: Column) -> Column:
        x = x.cast("float")
        bad = F.raise_error(F.lit("vectors with NaN or infinite components can't be encoded")).cast("int")
        q = F.round(x * F.lit(INVERSES[3]).cast("float"))
        out = F.least(F.greatest(q, F.lit(float(LOWEST)).cast("float")), F.lit(float(HIGHEST)).cast("float")).cast("int") * 4 + 3
        for i in (2, 1, 0):
            q = F.round(x * F.lit(INVERSES[i]).cast("float"))
            out = F.when(q.between(LOWEST, HIGHEST), q.cast("int") * 4 + i).otherwise(out)
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), bad).otherwise(out)

    def swapped(w: Column) -> Column:
        bits = w.bitwiseAND(0xFFFF)
        return F.substring(F.hex((F.shiftright(bits, 8) + bits.bitwiseAND(255) * 256 + 65536).cast("long")), 2, 4)

    return F.unhex(F.array_join(F.transform(vector, lambda x: swapped(word(x))), ""))


def decode_blob(blob: Column) -> Column:
    """BINARY to ARRAY<FLOAT> in JVM expressions."""
    scales = F.array(*(F.lit(s).cast("float") for s in SCALES))

    def value(h: Column) -> Column:
        raw = F.conv(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("int")
        w = F.when(raw >= 32768, raw - 65536).otherwise(raw)
        return F.shiftright(w, 2).cast("float") * F.element_at(scales, w.bitwiseAND(3) + 1)

    return F.transform(F.regexp_extract_all(F.hex(blob), F.lit("([0-9A-F]{4})"), F.lit(1)), value)


def blob_to_base64(blob: Column) -> Column:
    """Standard base64 on one line, whatever the session says about chunks."""
    return F.replace(F.base64(blob), F.lit("\r\n"), F.lit(""))


def base64_to_blob(text: Column) -> Column:
    """Strict: malformed input is an error."""
    return F.to_binary(text, F.lit("base64"))


def constant(value) -> np.ndarray:
    """A query vector as float32: from a list, an array, or a blob."""
    if isinstance(value, (bytes, bytearray)):
        return decode(bytes(value))
    return np.asarray(value, np.float32)


def _word_sql(x: str) -> str:
    cases = [f"WHEN round({x} * float({int(inverse)})) BETWEEN {LOWEST} AND {HIGHEST} THEN int(round({x} * float({int(inverse)}))) * 4 + {i}" for i, inverse in enumerate(INVERSES[:-1])]
    bad = f"WHEN isnan({x}) OR abs({x}) = float('inf') THEN raise_error('vectors with NaN or infinite components can''t be encoded')"
    last = f"int(least(greatest(round({x} * float({int(INVERSES[-1])})), {LOWEST}), {HIGHEST})) * 4 + {len(INVERSES) - 1}"
    return f"CASE {bad} {' '.join(cases)} ELSE {last} END"


#: encode_blob and decode_blob of a value v as SQL expressions.
ENCODE_SQL = (
    f"unhex(array_join(transform(transform(v, x -> {_word_sql('x')} & 65535),"
    " w -> substr(hex(bigint(shiftright(w, 8) + (w & 255) * 256 + 65536)), 2, 4)), ''))"
)
DECODE_SQL = (
    "transform(transform(regexp_extract_all(hex(v), '([0-9A-F]{4})', 1), h -> int(conv(concat(substr(h, 3, 2), substr(h, 1, 2)), 16, 10))),"
    f" r -> float(shiftright(if(r >= 32768, r - 65536, r), 2)) * element_at(array({', '.join(f'float({s})' for s in SCALES)}), (r & 3) + 1))"
)
