"""Approximate nearest neighbours with a forest of hash prefixes.

Each tree hashes a vector to a string of sign bits of random projections and keeps the strings in a sorted array. A query
descends to its longest matching prefix in every tree; then all trees ascend together, one bit at a time, until the
ranges that share the query's prefix hold enough candidates. Candidates are ranked by exact cosine.

Rows are dealt into blocks by a hash of vec_id, each block has a forest of its own, and every query asks every block; so a
task holds one block and one block of queries, and the answers of a query are merged by rank (two levels, no gathering).
Random projections and all parameters are fixed, so reruns agree. The share of candidates, ``SHARE``, is set for recall
above 0.9 even where vectors have no structure and neighbours are barely nearer than others; every block has at least
``LEAST`` candidates.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors whose length
differs from the query's are no candidates; a vec_id counts once and is never found for itself, and where its rows differ
the least of its usable vectors stands for it; equal scores go to the smaller vec_id; a score is summed row by row in one
order, so equal vectors score equally wherever they lie; a table without usable rows gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES = 48
BITS = 32
SHARE = 0.35
LEAST = 512
#: Rows of a block and queries of a block, about.
ROWS = 8192
QUERIES = 1024
SEED = 11
#: More than two ways of summing a cosine can differ by.
SLACK = 1e-9


class Forest:
    """Sorted arrays of hash strings over the rows of one block."""

    def __init__(self, vectors) -> None:
        import numpy as np

        self.vectors = vectors
        self.planes = np.random.default_rng(SEED).normal(size=(vectors.shape[1], TREES * BITS))
        codes = self.codes(vectors)
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, 0)

    def codes(self, vectors):
        """One string of BITS bits for each row and tree, first bit highest."""
        import numpy as np

        out = np.empty((len(vectors), TREES), np.uint64)
        weight = (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)).astype(np.float64)
        for at in range(0, len(vectors), 1024):
            bits = (vectors[at : at + 1024] @ self.planes > 0).reshape(-1, TREES, BITS)
            out[at : at + 1024] = (bits @ weight).astype(np.uint64)
        return out

    def ranges(self, codes, depth: int):
        """First and last place, for each query and tree, of the strings that share ``depth`` bits with the query's."""
        import numpy as np

        shift = np.uint64(BITS - depth)
        low = codes >> shift << shift
        high = low + (np.uint64(1) << shift)
        first, last = np.empty(codes.shape, np.int64), np.empty(codes.shape, np.int64)
        for t in range(TREES):
            first[:, t] = np.searchsorted(self.sorted[:, t], low[:, t])
            last[:, t] = np.searchsorted(self.sorted[:, t], high[:, t])
        return first, last

    def candidates(self, queries, wanted: int) -> Iterator:
        """For each query its candidates' places: all that share the longest prefix with which there are enough."""
        import numpy as np

        n = len(self.vectors)
        codes = self.codes(queries)
        depth = np.full(len(queries), -1)
        found = [None] * len(queries)
        open_ = np.arange(len(queries))
        for d in range(BITS, -1, -1):  # the synchronous ascent; queries that have enough stop
            first, last = self.ranges(codes[open_], d)
            enough = np.flatnonzero((last - first).sum(1) >= min(wanted, n))
            for i in enough:
                seen = np.zeros(n, bool)
                for t in range(TREES):
                    seen[self.order[first[i, t] : last[i, t], t]] = True
                if seen.sum() >= min(wanted, n) or d == 0:
                    found[open_[i]] = np.flatnonzero(seen)
                    depth[open_[i]] = d
            open_ = open_[depth[open_] < 0]
            if not len(open_):
                break
        yield from found


def usable(table: DataFrame) -> DataFrame:
    """vec_id, v (array of double): rows that take part, one for each vec_id."""
    v = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine).where(F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def blocked(rows: DataFrame, per_block: int, kind: str) -> tuple[DataFrame, int]:
    """rows dealt by a hash of vec_id into blocks of about per_block rows each, by length of vector."""
    n = rows.count()
    blocks = max(1, -(-n // per_block))
    return rows.withColumn(kind, F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(blocks)).cast("int")), blocks


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by cosine; queries has vec_id and embedding, too."""
    rows, blocks = blocked(usable(table), ROWS, "block")
    asked, query_blocks = blocked(usable(queries), QUERIES, "part")
    # each block of queries goes to each block of rows: a set of queries against all rows, in blocks
    left = rows.select("block", F.lit(None).cast("int").alias("part"), "vec_id", "v")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "part", "vec_id", "v")
    n = max(1, min(blocks * 2, 100_000))
    dealt = left.unionByName(right).repartition(n, "block").sortWithinPartitions("block", F.col("part").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        now, ids, vectors, waiting = None, [], [], []
        forests: dict | None = None

        def build() -> dict:
            by_size: dict[int, list] = {}
            for i, v in zip(ids, vectors):
                by_size.setdefault(len(v), []).append((i, v))
            out = {}
            for size, pairs in by_size.items():
                x = np.array([v for _, v in pairs])
                out[size] = (np.array([i for i, _ in pairs]), x, Forest(x / np.linalg.norm(x, axis=1, keepdims=True)))
            return out

        def answer() -> Iterator[pa.RecordBatch]:
            for size, (own, x, forest) in forests.items():
                mine = [(i, v) for i, v in waiting if len(v) == size]
                if not mine:
                    continue
                q = np.array([v for _, v in mine])
                length = np.sqrt((x * x).sum(1))
                wanted = max(LEAST, int(share * len(own)))
                out = ([], [], [])
                for (i, v), at in zip(mine, forest.candidates(q / np.linalg.norm(q, axis=1, keepdims=True), wanted)):
                    at = at[own[at] != i]
                    size = np.sqrt((v * v).sum())
                    if len(at) > k:  # matrix products round by place: they only choose what is scored exactly
                        rough = x[at] @ v / (length[at] * size)
                        at = at[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - SLACK]
                    score = (x[at] * v).sum(1) / (length[at] * size)
                    best = np.lexsort((own[at], -score))[:k]
                    out[0].extend([i] * len(best))
                    out[1].extend(own[at][best].tolist())
                    out[2].extend(score[best].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for block, part, i, v in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "vec_id", "v"))):
                if block != now or len(waiting) >= QUERIES:
                    if waiting:
                        forests = build() if forests is None else forests
                        yield from answer()
                        waiting = []
                    if block != now:
                        now, ids, vectors, forests = block, [], [], None
                if part is None:
                    ids.append(i)
                    vectors.append(np.array(v))
                else:
                    waiting.append((i, np.array(v)))
        if waiting:
            forests = build() if forests is None else forests
            yield from answer()

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
