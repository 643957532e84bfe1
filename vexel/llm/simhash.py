"""SimHash near-dedup with meet-in-the-middle ball hashing.

Fingerprints at distance 3 or less meet in a variant: split the differing bits, one side flips one bit at most, the
other two at most. Every fingerprint emits all variants within one flip. For distance 3 the two sides differ in parity
and two of the three bits lie in one half of the word, so only fingerprints with an even number of ones emit two-flip
variants, and only those within a half (992). Variants are shuffled, grouped and verified. Of a group of fingerprints
that meet in one variant, all link to one that is a flip away at most: distances are then 1+2 at most, so no link is
lost to the components and a group never makes pairs.

Defined cases: null text counts as empty; texts without words have fingerprint zero, which links like any other; rows
with equal fingerprints are one component, whatever their texts; ties in a bit (set in just half of the shingles) give 0; a
very long text must fit in a worker with the list of its shingles; null doc_ids never name a component unless it has no other; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import cut, doc_text, slots, text_chunks
from vexel.llm.graph import connected_components

SEED = 42
BITS = 64
#: Fingerprints that a worker expands at once (about 560 variants of 8 bytes each on average).
STEP = 2048
#: Variants in a bucket, about.
BUCKET_ROWS = 1 << 17
#: Bytes of variants that a task puts out, about.
TASK_BYTES = 64 << 20


def shingles(text: bytes, width: int) -> list[bytes]:
    """Word shingles of text, lower-cased in A-Z, repeats included; the whole sequence if it has fewer words."""
    words = text.lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    line, starts, at = b" ".join(words), [], 0
    ends = []
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    return [line[a:b] for a, b in zip(starts, ends[width - 1 :])]


def fingerprints_of(texts: list[bytes], width: int):
    """uint64 fingerprints: a bit is 1 if set in over half of the shingles' XXH64."""
    import numpy as np
    import xxhash

    h = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        hashes = np.array([h(s, SEED) for s in shingles(text, width)], np.uint64)
        n = len(hashes)
        if n:
            ones = np.zeros(BITS, np.int64)
            for at in range(0, n, 1 << 15):
                ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (long: the 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in text_chunks(batches):
            fp = fingerprints_of([t.encode() for t in batch.column("text").to_pylist()], width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return doc_text(docs).mapInArrow(run, "doc_id long, fp long")


def _masks():
    """Flip masks: none, one bit, two bits of one half."""
    import numpy as np

    bit = [1 << i for i in range(BITS)]
    two = [bit[i] | bit[j] for i in range(BITS) for j in range(i) if i // 32 == j // 32]
    return np.array([0, *bit, *two], np.uint64), 1 + BITS


#: Odd multiplier that spreads variants over buckets, and its inverse modulo 2^64.
SPREAD = 0x9E3779B97F4A7C15
GATHER = pow(SPREAD, -1, 1 << 64)
#: Bits of a flip mask's number; a bucket's number takes as many bits of the spread variant at least.
CODE = 11


def expand(bits: int):
    """Variants by bucket, the top ``bits`` bits of the spread variant. An entry packs the other bits and the mask's number
    in 8 bytes; entries are sorted and stored byte by byte, which lets their leading bytes compress."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        masks, near = _masks()
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), STEP):
                fps = every[at : at + STEP]
                even = fps[np.bitwise_count(fps) % 2 == 0]
                variants = np.concatenate([(fps[:, None] ^ masks[:near]).ravel(), (even[:, None] ^ masks[near:]).ravel()])
                codes = np.concatenate([np.tile(np.arange(near, dtype=np.uint64), len(fps)), np.tile(np.arange(near, len(masks), dtype=np.uint64), len(even))])
                variants *= np.uint64(SPREAD)
                order = np.argsort(variants)
                variants, codes = variants[order], codes[order]
                bucket = variants >> np.uint64(64 - bits)
                packed = (variants << np.uint64(bits)) >> np.uint64(bits) << np.uint64(CODE) | codes
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                starts, stops = np.append(0, cuts), np.append(cuts, len(bucket))
                blobs = [packed[a:b].view(np.uint8).reshape(-1, 8).T.tobytes() for a, b in zip(starts, stops)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return run


def meet(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links u, v from rows sorted by bucket: one bucket in memory at a time."""
        held, now = [], None
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
                if bucket != now and held:
                    yield links(now, held, bits)
                    held = []
                now = bucket
                held.append(blob)
        if held:
            yield links(now, held, bits)

    return run


def links(bucket: int, blobs: list[bytes], bits: int) -> pa.RecordBatch:
    """Links between fingerprints that meet in a variant of this bucket."""
    import numpy as np

    masks, near = _masks()
    packed = np.concatenate([np.frombuffer(b, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel() for b in blobs])
    code = (packed & np.uint64((1 << CODE) - 1)).astype(np.int64)
    z = ((packed >> np.uint64(CODE)) | np.uint64(bucket << (64 - bits))) * np.uint64(GATHER)
    order = np.argsort(z, kind="stable")
    z, code = z[order], code[order]
    new = np.r_[True, z[1:] != z[:-1]]
    group = np.cumsum(new) - 1
    shared = (np.bincount(group) > 1)[group]
    z, code, group = z[shared], code[shared], group[shared]
    # the centre of a group: its member with the fewest flips, as codes ascend with the number of flips
    by = np.lexsort((code, group))
    z, code, group = z[by], code[by], group[by]
    first = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
    centre = np.flatnonzero(first)[np.cumsum(first) - 1] if len(group) else np.zeros(0, int)
    fp = z ^ masks[code]
    u, v = fp, fp[centre]
    near_enough = (np.bitwise_count(u ^ v) <= 3) & (u != v) & (code[centre] < near)
    pair = np.unique(np.stack([u[near_enough], v[near_enough]], 1), axis=0).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["u", "v"])


def components(fps: DataFrame) -> DataFrame:
    """fp, component_id for every different fingerprint of fps (doc_id, fp)."""
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    n = distinct.count()
    bits = max(CODE, (n * 560 // BUCKET_ROWS).bit_length())
    # as many tasks as their output asks for, however few bytes go in
    tasks = max(slots(fps.sparkSession), n * 560 * 8 // TASK_BYTES)
    met = distinct.select("fp").repartition(tasks, "fp").mapInArrow(expand(bits), "bucket long, blob binary")
    linked = met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet(bits), "u long, v long")
    roots = connected_components(linked)
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "component_id")


def near_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of docs."""
    fps = cut(fingerprints(docs, width))
    named = fps.join(components(fps), "fp")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
