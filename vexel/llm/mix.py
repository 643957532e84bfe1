"""Mixing sources to target weights.

Words are counted per source, target sizes follow from weights by water filling, and each document is emitted
floor(rate) times plus one hash-seeded Bernoulli copy with the remaining probability.

Draws are correlated within a source, so that its words come near the target even where it has few documents: documents
share ``CELLS`` cells of their source by hash, and cells draw one after the other, the largest first, each with the
probability that the rest of the target is of the rest of the words. This keeps every document's probability at the
fraction, as what one cell takes too much or too little goes to all later ones in proportion; only where a cell has more
words than all later ones can make up for, do these follow the target rather than the fraction.

Defined cases: null text has size 0; null source is a source of its own and comes last; sources without words have
target 0 and rate 0; repeated rows draw alike, as the draw depends on doc_id and text alone; cells of one size draw in the
order of their numbers; a very long text is counted where it lies and never leaves its row; an empty table gives an empty
result; other columns pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexel.llm.common import fresh, stored

#: Fixed values of the contract: weights by rank of source, repeating, and the most copies of a source.
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: Sources up to this many are broadcast (a row has some 200 bytes and its name); beyond, the join shuffles.
BROADCAST_SOURCES = 20_000
SEED = 20240607
#: Cells of a source; a bit each stands beside the source's target.
CELLS = 1024


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size): one row per source.

    Sources fill in ascending order of cap/weight. With C and V the caps and weights of the first j sources, the level
    is (T - C)/(W - V); source j+1 is full if its cap is at most its weight times that level. Fullness is monotone in
    this order, so the level of the first source that isn't full holds for all that follow.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    capped = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    filled = capped.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    water = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return filled.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * water).cast("double").alias("target"))


def uniform(seed: bytes) -> float:
    import xxhash

    return (xxhash.xxh64_intdigest(seed, SEED) >> 11) / float(1 << 53)


def draw_cells(source: str | None, cells: list[tuple[int, int]], wanted: float) -> list[int]:
    """CELLS bits in signed longs, whether a cell's documents get one more copy; cells (words, number) come near ``wanted``."""
    longs = [0] * (CELLS // 64)
    left = float(sum(words for words, _ in cells))
    for words, cell in sorted(cells, key=lambda c: (-c[0], c[1])):
        chance = wanted / left if left > 0 else 0.0
        if uniform(f"{source is None} {cell} {source}".encode()) < chance:
            longs[cell // 64] |= 1 << cell % 64
            wanted -= words
        left -= words
    return [x - (1 << 64) if x >> 63 else x for x in longs]


def drawn(cells: DataFrame) -> DataFrame:
    """source, source_size, target, rate, bits: one row per source, from its cells (and cell, words)."""

    def draw(key, rows):
        import pandas as pd

        size, target, rate = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0]), float(rows["rate"].iloc[0])
        pairs = list(zip(rows["words"].tolist(), rows["cell"].tolist()))
        bits = draw_cells(key[0], pairs, target - int(rate) * size)
        return pd.DataFrame({"source": [key[0]], "source_size": [size], "target": [target], "rate": [rate], "bits": [bits]})

    return cells.groupBy("source").applyInPandas(draw, "source string, source_size long, target double, rate double, bits array<long>")


def rates(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, names: tuple[str, ...] = ("size", "source_size", "target", "copies")) -> DataFrame:
    """docs with columns of these names on end: words, words of the source, target of the source, copies taken."""
    size, source_size, target, copies = names
    cell, own, rate, bits = fresh(docs.select(*docs.columns, *(F.lit(0).alias(n) for n in names)), "cell", "source", "rate", "bits")
    sized = docs.withColumn(size, word_count(F.col("text"))).withColumn(cell, F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text")), F.lit(CELLS)).cast("int"))
    cells = stored(sized.groupBy(F.col("source").cast("string").alias("source"), F.col(cell).alias("cell")).agg(F.sum(size).alias("words")))
    goals = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    goals = goals.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0)))
    goals = goals.withColumnRenamed("source", own)
    goals = stored(drawn(cells.join(goals, cells["source"].eqNullSafe(goals[own])).drop(own)))
    goals = goals.select(F.col("source").alias(own), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("rate").alias(rate), F.col("bits").alias(bits))
    if goals.count() <= BROADCAST_SOURCES:
        goals = F.broadcast(goals)
    joined = sized.join(goals, sized["source"].cast("string").eqNullSafe(goals[own]))
    more = F.expr(f"shiftright(get(`{bits}`, cast(`{cell}` div 64 as int)), `{cell}` % 64) & 1")
    return joined.withColumn(copies, (F.floor(rate) + more).cast("long")).drop(own, cell, rate, bits)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The mixture: the rows of docs, each as often as it was taken."""
    *names, number = fresh(docs, "size", "source_size", "target", "copies", "number")
    taken = rates(docs, weights, most, tuple(names))
    once = taken.where(F.col(names[3]) > 0).withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(names[3]))))
    return once.select(*(F.col(f"`{c}`") for c in docs.columns))
