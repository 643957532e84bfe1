"""Repeated passages by prefix-free parsing.

Goal: every byte covered by a ``LENGTH``-byte string that also starts earlier in the corpus (documents by doc_id).

1. Triggers. A rolling hash runs over every document; each window of LENGTH bytes is triggered by the smallest hash of
   its ``GRAM``-byte grams (rightmost of equals), so equal windows have equal triggers at equal places. Consecutive
   windows with one trigger make a phrase: the bytes that they cover, which overlap the next phrase's, so that none is
   a prefix of another with the same trigger but by its own content.
2. Parse. Phrases become (hash of trigger, hash of phrase, place), dealt by the trigger in packed blocks. Phrases whose
   trigger is unique are done: nothing in them repeats. Of equal phrases the first in corpus order owns all windows, all
   others are covered entirely. What remains is the dictionary: different phrases that share a trigger.
3. Dictionary. Their bytes are fetched; the dictionary's suffixes are ordered by prefix doubling up to LENGTH bytes,
   suffixes that are equal so far form a class, and of each class the first in corpus order stays.

Every window of LENGTH bytes lies in one phrase whole, so the order of suffixes up to that length follows from the dictionary
alone, and the corpus order of equal windows from the phrases' places; the parse needs no suffix array of its own, which
would order what reaches over phrases. Hashes of phrases have 64 bits beside the 40 of the trigger; windows of the
dictionary are compared by their bytes.

Defined cases: null text counts as empty; texts under LENGTH bytes lose nothing; of equal windows the first in corpus order
stays, there are no other ties; a very long text is parsed in blocks, and must fit in a worker with its phrases; a null
doc_id comes last; rows that
repeat doc_id and text are one document and share their fate, rows that repeat a doc_id with another text follow in order
of the text's hash; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import column_buffers, spread, stored, text_chunks

LENGTH = 100
GRAM = 32
WINDOWS = LENGTH - GRAM + 1
#: Windows whose triggers are found at once, and bits of a place within them.
BLOCK = 1 << 20
PLACE = 24
#: Bytes of dictionary that are ordered at once, unless one trigger alone has more.
DICTIONARY = 4 << 20
#: Buckets of triggers for each partition, which is resolved bucket by bucket, and bytes of packed phrases that go to Python at once.
BUCKETS, PACKED = 2, 4 << 20
LAST = (1 << 63) - 1


class Parser:
    """Triggers and phrases of concatenated texts."""

    def __init__(self) -> None:
        import numpy as np

        rng = np.random.default_rng(20240611)
        odd = lambda n: rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.letters, self.others = odd(256), odd(256)
        self.steps, self.final = odd(8), odd(1)[0]
        base = int(odd(1)[0])
        inverse = pow(base, -1, 1 << 64)
        n = BLOCK + 2 * LENGTH
        self.powers, self.inverses = self.series(base, n), self.series(inverse, n)

    @staticmethod
    def series(base: int, n: int):
        """Powers of base modulo 2^64."""
        import numpy as np

        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
        return out[:n]

    def block(self, raw, valid):
        """(first window, windows, trigger's place, trigger's hash, phrase's hash) of each phrase.

        raw: bytes; valid: whether a window starts at each of raw's first len(raw) - LENGTH + 1 places.
        """
        import numpy as np

        x, width = self.letters[raw], 1
        for step in self.steps[: GRAM.bit_length() - 1]:
            x = x[:-width] * step + x[width:]
            width *= 2
        x = (x ^ (x >> np.uint64(29))) * self.final
        mask = np.uint64((1 << PLACE) - 1)
        # smaller for places further right, so that the rightmost of equal hashes wins
        least = (x & ~mask) | (mask - np.arange(len(x), dtype=np.uint64))
        width = 1
        while width * 2 <= WINDOWS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < WINDOWS:
            rest = WINDOWS - width
            least = np.minimum(least[:-rest], least[rest:])
        at = np.flatnonzero(valid)
        least = least[at]
        new = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1))[: len(at)])
        lo, count = at[new], np.diff(np.append(new, len(at)))
        trigger = (mask - (least[new] & mask)).astype(np.int64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.others[raw] * self.powers[: len(raw)], dtype=np.uint64)])
        phrase = (sums[lo + count - 1 + LENGTH] - sums[lo]) * self.inverses[lo]
        phrase ^= phrase >> np.uint64(31)
        return lo, count, trigger, least[new] >> np.uint64(PLACE), phrase

    def phrases(self, raw, offsets):
        """The same over texts on end (offsets), places counted in raw."""
        import numpy as np

        n = len(raw) - LENGTH + 1
        if n <= 0:
            return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
        valid = np.ones(n, bool)
        # no window reaches over a text's end
        for back in range(1, LENGTH):
            ends = offsets[1:] - back
            valid[ends[(ends >= 0) & (ends < n)]] = False
        out = []
        for at in range(0, n, BLOCK):
            stop = min(at + BLOCK, n)
            lo, count, trigger, gram, phrase = self.block(raw[at : stop + LENGTH - 1], valid[at:stop])
            out.append((lo + at, count, trigger + at, gram, phrase))
        return [np.concatenate(c) for c in zip(*out)]


ENTRY = [("gram", "<u4"), ("phrase", "<u8"), ("lo", "<u4"), ("count", "u1"), ("before", "u1"), ("doc", "<u4")]


def parse(buckets: int):
    """Packed phrases by bucket of their trigger: bucket, docs (doc, th), rows (ENTRY, column by column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        parser = Parser()
        for batch in text_chunks(batches):
            docs, th = (batch.column(c).to_numpy() for c in ("doc", "th"))
            raw, offsets = column_buffers(batch.column("text"))
            lo, count, trigger, gram, phrase = parser.phrases(raw, offsets)
            if not len(lo):
                continue
            doc = np.searchsorted(offsets, lo, side="right") - 1
            bucket = (gram % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
            cells = np.empty(len(lo), ENTRY)
            cells["gram"], cells["phrase"], cells["lo"] = (gram // np.uint64(buckets)) & np.uint64(0xFFFFFFFF), phrase, lo - offsets[doc]
            cells["count"], cells["before"], cells["doc"] = count, trigger - lo, doc
            cells, bucket = cells[order], bucket[order]
            edges = np.flatnonzero(np.diff(bucket)) + 1
            names, own, packed = [], [], []
            for a, b in zip(np.append(0, edges), np.append(edges, len(bucket))):
                part = cells[a:b]
                used, at = np.unique(part["doc"], return_inverse=True)
                names.append(int(bucket[a]))
                own.append(docs[used].tobytes() + th[used].tobytes())
                part["doc"] = at
                packed.append(b"".join(np.ascontiguousarray(part[n]).tobytes() for n, _ in ENTRY))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(own, pa.binary()), pa.array(packed, pa.binary())], names=["bucket", "docs", "rows"])

    return run


def unpack(blocks: list[tuple[bytes, bytes]]):
    """Columns of ENTRY, and doc and th by entry."""
    import numpy as np

    size = sum(np.dtype(k).itemsize for _, k in ENTRY)
    columns: dict[str, list] = {n: [] for n, _ in ENTRY}
    docs, ths = [], []
    for own, packed in blocks:
        n, at = len(packed) // size, 0
        for name, kind in ENTRY:
            columns[name].append(np.frombuffer(packed, kind, n, at))
            at += n * np.dtype(kind).itemsize
        table = np.frombuffer(own, np.int64).reshape(2, -1)
        docs.append(table[0][columns["doc"][-1]])
        ths.append(table[1][columns["doc"][-1]])
    return {n: np.concatenate(c) for n, c in columns.items()}, np.concatenate(docs), np.concatenate(ths)


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packed phrases, sorted by bucket: kind 0, covered phrases; kind 1, phrases of the dictionary."""
    import numpy as np

    def bucket_rows(bucket: int, blocks: list) -> pa.RecordBatch:
        cells, doc, th = unpack(blocks)
        order = np.argsort(cells["gram"], kind="stable")
        gram = cells["gram"][order]
        edge = np.append(True, gram[1:] != gram[:-1])
        repeated = (np.diff(np.append(np.flatnonzero(edge), len(gram))) > 1)[np.cumsum(edge) - 1]
        order = order[repeated]
        gram, phrase, lo, count, before = (cells[n][order] for n in ("gram", "phrase", "lo", "count", "before"))
        doc, th = doc[order], th[order]
        by = np.lexsort((lo, th, doc, before, count, phrase, gram))
        gram, phrase, lo, count, before, doc, th = (c[by] for c in (gram, phrase, lo, count, before, doc, th))
        if not len(gram):
            first = other = np.zeros(0, bool)
        else:
            same = lambda *cs: np.append(False, np.logical_and.reduce([c[1:] == c[:-1] for c in cs]))
            first = ~same(gram, phrase, count, before)
            owner = np.flatnonzero(first)[np.cumsum(first) - 1]
            # the same place twice: a row that is repeated
            other = ~((doc == doc[owner]) & (th == th[owner]) & (lo == lo[owner]))
            groups = np.cumsum(~same(gram)) - 1
            several = np.bincount(groups, weights=first)[groups] > 1
            first = first & several
        take = np.append(np.flatnonzero(other), np.flatnonzero(first))
        kind = np.append(np.zeros(int(other.sum()), np.int32), np.ones(int(first.sum()), np.int32))
        key = np.int64(bucket) << 32 | gram.astype(np.int64)
        columns = [kind, *(c[take] for c in (key, doc, th, lo.astype(np.int32), count.astype(np.int32)))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "key", "doc", "th", "lo", "count"])

    held, now = [], None
    for batch in batches:
        for bucket, own, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "docs", "rows"))):
            if bucket != now and held:
                yield bucket_rows(now, held)
                held = []
            now = bucket
            held.append((own, packed))
    if held:
        yield bucket_rows(now, held)


def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the dictionary's phrases, from texts and lists of phrases."""
    for batch in text_chunks(batches):
        rows: list[tuple] = []
        for doc, th, text, phrases in zip(*(batch.column(c).to_pylist() for c in ("doc", "th", "text", "phrases"))):
            raw = text.encode()
            rows += [(p["key"], doc, th, p["lo"], p["count"], raw[p["lo"] : p["lo"] + p["count"] - 1 + LENGTH]) for p in phrases]
        for at in range(0, len(rows), 20_000):
            part = list(zip(*rows[at : at + 20_000]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds)], names=["key", "doc", "th", "lo", "count", "bytes"])


def suffix_classes(raw, starts):
    """Rank of the LENGTH-byte suffix at each of starts among all of raw's suffixes, by prefix doubling; equal: same class."""
    import numpy as np

    padded = np.append(raw, np.zeros(8, np.uint8))
    word = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(raw), 8), (1, 1))
    rank = np.unique(np.ascontiguousarray(word).view(">u8").ravel().astype(np.uint64), return_inverse=True)[1].astype(np.uint64)
    width = 8
    while width * 2 <= LENGTH:
        nxt = np.append(rank[width:], np.zeros(width, np.uint64))
        rank = np.unique(rank << np.uint64(32) | nxt, return_inverse=True)[1].astype(np.uint64)
        width *= 2
    pair = rank[starts] << np.uint64(32) | rank[starts + LENGTH - width]
    return np.unique(pair, return_inverse=True)[1]


def order_dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered windows (doc, th, lo, count) of phrases that come sorted by key."""
    import numpy as np

    def covered(rows: list[tuple]) -> pa.RecordBatch:
        _, doc, th, lo, count, texts = zip(*rows)
        doc, th, lo, count = (np.array(c, np.int64) for c in (doc, th, lo, count))
        raw = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.cumsum([0, *map(len, texts[:-1])])
        of = np.repeat(np.arange(len(count)), count)
        within = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        rank = suffix_classes(raw, begin[of] + within)
        place = lo[of] + within
        by = np.lexsort((place, th[of], doc[of], rank))
        r, d, t, p = rank[by], doc[of][by], th[of][by], place[by]
        first = np.append(True, r[1:] != r[:-1])
        owner = np.flatnonzero(first)[np.cumsum(first) - 1]
        gone = np.zeros(len(of), bool)
        gone[by] = ~((d == d[owner]) & (t == t[owner]) & (p == p[owner]))
        at = np.flatnonzero(gone)
        new = np.append(True, (at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]]))[: len(at)]
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(at)))
        at = at[starts]
        columns = [doc[of[at]], th[of[at]], place[at].astype(np.int32), size.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "th", "lo", "count"])

    rows, size, now = [], 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "th", "lo", "count", "bytes"))):
            if row[0] != now and size > DICTIONARY:
                yield covered(rows)
                rows, size = [], 0
            now = row[0]
            rows.append(row)
            size += len(row[5])
    if rows:
        yield covered(rows)


def spans_of(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes (start, stop) covered by windows (first, number)."""
    out: list[list[int]] = []
    for lo, count in sorted(windows):
        stop = lo + count - 1 + LENGTH
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([lo, stop])
    return [(a, b) for a, b in out]


def covered_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts: doc_id, doc, th, text; windows: doc, th, lo, count), the windows that also start earlier."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumns({"doc": F.coalesce("doc_id", F.lit(LAST)), "th": F.xxhash64("text")})
    # by the table's size, so that neither a bucket nor a partition grows with it
    partitions = spread(docs)
    buckets = BUCKETS * partitions
    packed = texts.where(F.octet_length("text") >= LENGTH).select("doc", "th", "text").mapInArrow(parse(buckets), "bucket long, docs binary, rows binary")
    phrases = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(resolve, "kind int, key long, doc long, th long, lo int, count int")
    phrases = stored(phrases, batch_bytes=PACKED)
    wanted = phrases.where("kind = 1").groupBy("doc", "th").agg(F.collect_set(F.struct("key", "lo", "count")).alias("phrases"))
    once = texts.select("doc", "th", "text").join(wanted, ["doc", "th"])
    dictionary = once.mapInArrow(fetch, "key long, doc long, th long, lo int, count int, bytes binary")
    ordered = dictionary.repartition("key").sortWithinPartitions("key").mapInArrow(order_dictionary, "doc long, th long, lo int, count int")
    return texts, phrases.where("kind = 0").select("doc", "th", "lo", "count").union(ordered)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, text, spans (start and stop in bytes of what repeats): one row per row of docs; null text is empty."""
    texts, windows = covered_windows(docs)
    gone = windows.groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "count")).alias("windows"))
    return texts.join(gone, ["doc", "th"], "left").select("doc_id", "text", "windows")


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            rows = []
            for doc, text, windows in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "windows"))):
                raw = text.encode()
                spans = spans_of([(w["lo"], w["count"]) for w in windows or ()])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                rows.append((doc, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            kinds = (*[pa.int64()] * 4, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated_passages(docs).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
