"""Quality by importance resampling.

Two generative models of hashed n-grams, one of target text and one of raw text, give each document its importance: the mean
of its n-grams' log ratios, times ``LENGTH``, as if every document were an excerpt of that many n-grams. (Plain sums grow with
length: what the bounded sample of target text happens not to hold then outweighs quality, and long good documents fall
below short bad ones.) A sample is taken by Gumbel top-k: the k documents with the largest sum of log importance and
Gumbel noise, which draws without replacement in proportion to importance. N-grams are byte trigrams, words and pairs of
words, each kind hashed into a table of its own; pairs of equal words are one n-gram whatever the word, as the count of such
a pair is mostly the document's own.

The raw model counts every document. The rest is fitted on a bounded sample of labelled rows, about ``SAMPLE`` of good and as
many of bad quality: one half of the good ones makes the target model, the other half and the bad ones place a cut, whose
rows the model has not seen. k is the number of documents in the whole corpus whose log importance reaches the cut. Noise
is seeded by a hash of doc_id and text.

Defined cases: a null or empty text has log importance 0; documents that tie with the k-th stay; repeated rows share their
fate; very long texts weigh by all of their n-grams, and must fit in a worker as they do in a row; without labelled rows of
both kinds everything stays; an empty table gives an empty result; other columns pass through ``keep`` untouched, a column
named like one of its own included.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import column_buffers, cut, fresh, stored, text_chunks

#: Cells of each kind of n-gram: byte trigrams, words, pairs of words; the last but one cell is for pairs of equal words.
CELLS = 1 << 16
EQUAL = 3 * CELLS
NONE = EQUAL + 1
#: Labelled rows of each kind in the sample, about.
SAMPLE = 4000
#: Bytes of text that are taken apart at once.
CHUNK = 2 << 20
#: Steps of the perturbed weight that count as different.
GRAIN = float(1 << 20)
#: Share of the target's counts that is added to them from the raw model.
PRIOR = 0.05
SEED = 20240615
#: N-grams of the excerpt whose importance is taken.
LENGTH = 100.0


def ngrams(column: pa.Array) -> list[tuple]:
    """(cells, offsets of texts) for each kind of n-gram; NONE stands where no n-gram starts."""
    import numpy as np

    raw, offsets = column_buffers(column)
    n = len(raw)
    filled = offsets[1:] > offsets[:-1]
    firsts, lasts = offsets[:-1][filled], offsets[1:][filled] - 1
    three = np.full(n, NONE, np.int32)
    if n >= 3:
        b = raw.astype(np.uint32)
        three[:-2] = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(16)
    for back in (0, 1):
        three[np.maximum(lasts - back, firsts)] = NONE

    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    solid = ~blank[raw]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    begins[firsts], ends[lasts] = solid[firsts], solid[lasts]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    word = _hashes(raw, start, stop)
    words = (CELLS + (word >> np.uint64(48)).astype(np.int64)).astype(np.int32)
    of = np.searchsorted(start, offsets)
    pairs = np.full(len(word), NONE, np.int32)
    if len(word) > 1:
        both = word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]
        both = (both ^ (both >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        pairs[:-1] = np.where(word[1:] == word[:-1], EQUAL, 2 * CELLS + (both >> np.uint64(48)).astype(np.int64))
    pairs[of[1:][of[1:] > of[:-1]] - 1] = NONE
    return [(three, offsets), (words, of), (pairs, of)]


def _hashes(raw, start, stop):
    """Polynomial hashes of raw[start:stop] modulo 2^64, by running sums."""
    import numpy as np

    base = 0xD1342543DE82EF95
    letters = np.random.default_rng(SEED).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    powers = np.cumprod(np.full(len(raw) + 1, base, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters[raw] * powers[1:], dtype=np.uint64)])
    # the power of a word's place is taken away by the powers' inverses
    h = (sums[stop] - sums[start]) * np.cumprod(np.full(len(raw) + 1, pow(base, -1, 1 << 64), np.uint64))[start]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def counts(docs: DataFrame):
    """Counts of all cells over docs (text), as an array on the driver; its size is fixed."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(NONE + 1, np.int64)
        for batch in text_chunks(batches, CHUNK):
            for cells, _ in ngrams(batch.column("text")):
                total += np.bincount(cells, minlength=NONE + 1)
        at = np.flatnonzero(total[:NONE])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    out = np.zeros(NONE, np.float64)
    summed = docs.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out[summed["cell"]] = summed["n"]
    return out


def log_ratios(target, raw):
    """Log of the models' ratio for each cell.

    The target model's counts are filled up from the raw model by ``PRIOR`` of their own number, so that a cell that the
    sample happens not to hold says little.
    """
    import numpy as np

    out = []
    for a, b in ((0, CELLS), (CELLS, 2 * CELLS), (2 * CELLS, NONE)):
        whole = raw[a:b] + 0.5
        whole = whole / whole.sum()
        own = target[a:b]
        filled = own + max(1.0, PRIOR * own.sum()) * whole
        out.append(np.log(filled / filled.sum()) - np.log(whole))
    return np.concatenate(out)


def weighted(docs: DataFrame, ratios, name: str = "__weight") -> DataFrame:
    """docs with the text's log importance in a column of that name on end."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.append(ratios, 0.0)
        for batch in text_chunks(batches, CHUNK):
            weight, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for cells, offsets in ngrams(batch.column("text")):
                sums = np.append(0.0, np.cumsum(table[cells]))
                real = np.append(0, np.cumsum(cells != NONE))
                weight += sums[offsets[1:]] - sums[offsets[:-1]]
                n += real[offsets[1:]] - real[offsets[:-1]]
            weight *= LENGTH / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight)], names=[*batch.schema.names, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{name}` double"])
    return docs.mapInArrow(run, schema)


def best_cut(pairs: list[tuple[float, int]]) -> float:
    """The cut with the best balanced accuracy, in the middle of its gap."""
    pairs = sorted(pairs)
    good = sum(q for _, q in pairs)
    bad = len(pairs) - good
    if not good or not bad:
        return float("-inf")
    best, at, below_good, below_bad = -1.0, float("-inf"), 0, 0
    for (w, q), (nxt, _) in zip(pairs, pairs[1:]):
        below_good, below_bad = below_good + q, below_bad + (1 - q)
        value = (good - below_good) / good + below_bad / bad
        if nxt > w and value > best:
            best, at = value, (w + nxt) / 2
    return at


def kth_largest(values: DataFrame, k: int) -> int | None:
    """The k-th largest of the column key (long): counts by ever finer digits, 8192 groups at most in each pass."""
    if k <= 0:
        return None
    prefix, shift = None, 39
    while True:
        rest = values if prefix is None else values.where(F.shiftright("key", shift + 13) == prefix)
        groups = rest.groupBy(F.shiftright("key", shift).alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect()
        for digit, n in sorted(groups, reverse=True):
            if k <= n:
                prefix = digit
                break
            k -= n
        else:
            return None
        if shift == 0:
            return prefix
        shift -= 13


def fitted(docs: DataFrame, labels: DataFrame) -> tuple:
    """(log ratios of all cells, the cut) from the labelled sample and from the counts of all docs."""
    named = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("quality") > 0).cast("int").alias("quality"))
    named = named.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    numbers = {r["quality"]: r["n"] for r in named.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    share = {q: int(min(1.0, SAMPLE / n) * (1 << 30)) for q, n in numbers.items()}
    bound = F.when(F.col("quality") == 1, F.lit(share.get(1, 0))).otherwise(F.lit(share.get(0, 0)))
    chosen = named.where(place < bound)  # about SAMPLE rows of each quality, whatever the input
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # copies of one text are on one side, or the cut would be placed on rows that the model has seen
    model = (F.col("quality") == 1) & (F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(2)) == 0)
    sampled = cut(text.join(F.broadcast(chosen), "doc_id").withColumn("model", model))
    ratios = log_ratios(counts(sampled.where("model")), counts(text))
    scored = weighted(sampled.where("NOT model"), ratios).select("__weight", "quality").collect()
    return ratios, best_cut([(r[0], r[1]) for r in scored])


def perturbed(weight: Column) -> Column:
    """The weight with Gumbel noise, in whole steps."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "text"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return F.floor((weight - F.log(-F.log(uniform))) * GRAIN).cast("long")


def top(rows: DataFrame, weight: str, key: str, at: float) -> DataFrame:
    """The k rows with the largest key, and those that tie with the last; k is the number of rows whose weight is ``at`` or more."""
    least = kth_largest(rows.select(F.col(key).alias("key")), rows.where(F.col(weight) >= F.lit(at)).count())
    return rows.where(F.lit(False) if least is None else F.col(key) >= F.lit(least))


def keep(docs: DataFrame, labels: DataFrame, name: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """The rows of docs that the sample takes: all columns, or those named, and the log importance as ``name`` if one is given.

    labels: doc_id, quality (0 or 1).
    """
    weight, key = fresh(docs, "weight", "key")
    ratios, at = fitted(docs, labels)
    every = weighted(docs, ratios, weight)
    kept = [F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)]
    rows = stored(every.select(*kept, F.col(weight), perturbed(F.col(weight)).alias(key)))
    taken = top(rows, weight, key, at).drop(key)
    return taken.drop(weight) if name is None else taken.withColumnRenamed(weight, name)
