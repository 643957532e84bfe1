"""Near copies by the Jaccard similarity of word shingles: SimHash with ball hashing gives candidates, MinHash bands those
beyond its radius, the shingles themselves decide.

Texts are candidates whose fingerprints over the same shingles are connected by steps of 3 bits at most, found by
meet-in-the-middle ball hashing (``simhash.py``). That radius meets hardly a pair at a similarity of 0.8, so a text has
``BANDS`` keys beside, each of ``ROWS`` minima; texts that share a key are candidates as well. At a similarity of 0.8 a pair
shares no key once in some 14000 times. Every candidate pair is compared or already in one component: first each key's texts
with its least one, then all pairs that this has not put into one component.

Defined cases: null text counts as empty; texts without words are alike; null doc_ids never name a component unless it has
no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import cut, discard, doc_text, slots, stored, text_chunks
from vexel.llm.graph import connected_components
from vexel.llm.simhash import SEED, components, fingerprints_of, shingles

SIMILARITY = 0.8
BANDS = 24
ROWS = 5
NODE = "struct<k1: bigint, k2: bigint>"


def hashes(text: str, width: int):
    """Different XXH64 of the text's shingles, ascending."""
    import numpy as np
    import xxhash

    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text.encode(), width)], np.uint64))


def band_keys(found):
    """BANDS longs; the minima are taken under XOR with fixed constants."""
    import numpy as np
    import xxhash

    flips = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * ROWS, np.uint64)
    least = np.full(len(flips), (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), 4096):
        least = np.minimum(least, (found[at : at + 4096, None] ^ flips).min(0))
    parts = (least ^ flips).reshape(BANDS, ROWS)  # the shingles that have the minima
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), i) for i, p in enumerate(parts)], np.uint64).view(np.int64)


def signed(texts: DataFrame, width: int) -> DataFrame:
    """node, fp, keys (of the bands) from texts (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in text_chunks(batches):
            found = batch.column("text").to_pylist()
            fps = fingerprints_of([t.encode() for t in found], width).view(np.int64)
            keys = [band_keys(hashes(t, width)).tolist() for t in found]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(fps), pa.array(keys, pa.list_(pa.int64()))], names=["node", "fp", "keys"])

    return texts.select("node", "text").mapInArrow(run, f"node {NODE}, fp bigint, keys array<bigint>")


def balls(signatures: DataFrame) -> DataFrame:
    """key, node from signatures (node, fp): one key for all nodes whose fingerprints ball hashing connects."""
    connected = components(signatures.select(F.col("node").alias("doc_id"), "fp"))
    return signatures.join(connected, "fp").select(F.xxhash64(F.lit(BANDS), "component_id").alias("key"), "node")


def alike(texts: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs u, v whose shingles have the similarity at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                a, b = hashes(x.as_py(), width), hashes(y.as_py(), width)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    x, y = (texts.select(F.col("node").alias(n), F.col("text").alias(t)) for n, t in (("u", "x"), ("v", "y")))
    both = pairs.join(x, "u").join(y, "v").repartition(slots(pairs.sparkSession)).select("u", "v", "x", "y")
    return stored(both.mapInArrow(run, f"u {NODE}, v {NODE}"))


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id: one row per row of docs."""
    node = F.struct(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    rows = doc_text(docs).select("doc_id", node.alias("node"), "text")
    texts = rows.groupBy("node").agg(F.first("text").alias("text"))
    signatures = stored(signed(texts, width))
    keyed = stored(balls(signatures).union(signatures.select(F.explode("keys").alias("key"), "node")))
    discard(signatures)
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low")).where("n > 1").select("key", "low")
    members = stored(keyed.join(groups, "key"))
    star = members.where("node <> low").select(F.col("low").alias("u"), F.col("node").alias("v")).distinct()
    linked = alike(texts, star, width, similarity)
    roots = connected_components(linked)
    placed = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("l"), F.max("root").alias("h")).where("l <> h").select("key")
    placed = stored(placed.join(mixed, "key"))
    sides = [placed.select("key", F.col("node").alias(n), F.col("root").alias(f"root_{n}")) for n in "uv"]
    rest = sides[0].join(sides[1], "key").where("u < v AND root_u <> root_v").select("u", "v").distinct()
    linked = linked.union(alike(texts, rest, width, similarity))
    named = cut(rows.select("doc_id", "node").join(connected_components(linked), "node", "left").select("doc_id", F.coalesce("root", "node").alias("root")))
    ids = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(ids, "root").select("doc_id", "component_id")
