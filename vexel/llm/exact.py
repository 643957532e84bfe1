"""Exact dedup with Patricia-trie owners.

Map side, each partition inserts its normalised texts into a compressed radix trie; a terminal node stores the owner
so far (most code points in the original text, then smallest doc_id) and the number of rows, so a hot text leaves a
partition as one row. Those rows are partitioned by length and content hash, sorted within the partition, and inserted
again; here terminals become final owners. When a trie outgrows its budget it spills by subtree, the largest first: on the
map side as partial owners, on the owner side as final ones, as all that came before the present (length, hash) is complete.
A hot text meets its rows again in a sorted join, whose skewed partitions adaptive execution splits.

Defined cases: null text counts as empty; empty texts form one group; a null doc_id is larger than any other; repeated
rows (same doc_id and text) are all members, and each that equals the owner counts as kept; texts that tie in code points go
to the smallest doc_id; a very long text is one path of a trie, and spills alone where it outgrows the budget; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import doc_text, text_chunks

#: The characters that do not count.
BLANKS = b" \t\n\x0b\x0c\r"
#: Label bytes that a trie may hold.
BUDGET = 32 << 20
LAST = (1 << 63) - 1


class PatriciaTrie:
    """Compressed radix trie over byte strings. A node is [label, children by first byte, terminal]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.bytes = 0

    def insert(self, key: bytes, chars: int, doc_id: int, rows: int = 1) -> None:
        """Adds rows of a text; (-chars, doc_id) smallest owns it."""
        node, i, size = self.root, 0, len(key)
        while i < size:
            child = node[1].get(key[i])
            if child is None:
                child = node[1][key[i]] = [key[i:], {}, None]
                self.bytes += size - i + 200
                node, i = child, size
                break
            label = child[0]
            if key.startswith(label, i):
                node, i = child, i + len(label)
                continue
            at = self.common(label, key, i)
            middle = [label[:at], {label[at]: child}, None]
            child[0] = label[at:]
            node[1][key[i]] = middle
            self.bytes += 200
            node, i = middle, i + at
        if node[2] is None:
            node[2] = [-chars, doc_id, rows]
        else:
            own = node[2]
            if (-chars, doc_id) < (own[0], own[1]):
                own[0], own[1] = -chars, doc_id
            own[2] += rows

    @staticmethod
    def common(label: bytes, key: bytes, i: int) -> int:
        """Length of the common prefix of label and key[i:]; they differ somewhere."""
        low, high = 1, min(len(label), len(key) - i)
        while low < high:
            mid = (low + high + 1) // 2
            if key.startswith(label[:mid], i):
                low = mid
            else:
                high = mid - 1
        return low

    def terminals(self, node: list | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, list]]:
        stack = [(node or self.root, prefix)]
        while stack:
            x, path = stack.pop()
            path += x[0]
            if x[2] is not None:
                yield path, x[2]
            stack.extend((c, path) for c in x[1].values())

    def pop_largest(self) -> Iterator[tuple[bytes, list]]:
        """Takes the root's largest subtree out and gives its terminals."""

        def weight(top: list) -> int:
            total, stack = 0, [top]
            while stack:
                x = stack.pop()
                total += len(x[0]) + 200
                stack.extend(x[1].values())
            return total

        sizes = {k: weight(c) for k, c in self.root[1].items()}
        k = max(sizes, key=sizes.get)
        self.bytes -= sizes[k]
        yield from self.terminals(self.root[1].pop(k))


PARTIAL = "len int, hash long, body binary, chars long, id long, n long"
OWNERS = "sha string, keep long, n long"


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def partial_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    schema = pa.schema([("len", pa.int32()), ("hash", pa.int64()), ("body", pa.binary()), ("chars", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])
    trie = PatriciaTrie()

    def out(found: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for body, (chars, doc_id, n) in found:
            h = xxhash.xxh64_intdigest(body)
            rows.append((len(body), h - (1 << 64) if h >> 63 else h, body, -chars, doc_id, n))
            size += len(body)
            if size > 4 << 20:
                yield _rows(schema, rows)
                rows, size = [], 0
        if rows:
            yield _rows(schema, rows)

    for batch in text_chunks(batches):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            trie.insert(text.encode().translate(None, BLANKS), len(text), LAST if doc_id is None else doc_id)
            while trie.bytes > BUDGET:
                yield from out(trie.pop_largest())
    yield from out(trie.terminals())


def final_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input is sorted by (len, hash): what stands before the current pair is complete."""
    schema = pa.schema([("sha", pa.string()), ("keep", pa.int64()), ("n", pa.int64())])
    done: list[tuple] = []
    trie, now = PatriciaTrie(), None

    def final(found: Iterator[tuple[bytes, list]]) -> None:
        done.extend((hashlib.sha256(body).hexdigest(), own[1], own[2]) for body, own in found if own[2] > 1)

    for batch in batches:
        for key, body, chars, doc_id, n in zip(zip(*(batch.column(c).to_pylist() for c in ("len", "hash"))), *(batch.column(c).to_pylist() for c in ("body", "chars", "id", "n"))):
            while key != now and trie.bytes > BUDGET:
                final(trie.pop_largest())
            now = key
            trie.insert(body, chars, doc_id, n)
        if len(done) > 10_000:
            yield _rows(schema, done)
            done = []
    final(trie.terminals())
    if done:
        yield _rows(schema, done)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches):
        shas = [hashlib.sha256(t.encode().translate(None, BLANKS)).hexdigest() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shas, pa.string())], names=["doc_id", "text_sha256"])


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs."""
    texts = doc_text(docs)
    partial = texts.mapInArrow(partial_owners, PARTIAL)
    owners = partial.repartition("len", "hash").sortWithinPartitions("len", "hash").mapInArrow(final_owners, OWNERS)
    rows = texts.mapInArrow(digests, "doc_id long, text_sha256 string")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.nullif("keep", F.lit(LAST)))
    joined = rows.join(owners, rows.text_sha256 == owners.sha, "left")
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
