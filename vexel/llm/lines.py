"""Fuzzy line dedup in DataFrame operations only.

Lines are normalised (lower case, tabs as blanks, blanks at the ends cut off). A line's fingerprint has several blocks of
``BITS`` bits. A hash deals its different words to the blocks, and each block is the SimHash of its own words, so that a
changed word disturbs two blocks at most, an added or a lost one only one. The number of blocks grows with the number of
words (``BLOCKS``), and d changed words leave all but 2d blocks alike at least: the pigeonhole guarantee. Lines are
candidates if they agree

* in one block, where these hold ten words and more (lines of 160 words and more);
* in two blocks, in shorter lines; where a block may be empty (up to 23 words), two blocks share one SimHash;
* in all words but one, in lines of four to nine words: here every word is a block;
* in a piece of characters, if short lines are asked for (``short``): lines of up to that many characters are cut into more
  pieces than they may have edits, of which one stays whole and hardly moves, so no pair of them is left out; the piece must
  be one of the shorter line's own cut. In longer lines of up to three words, pieces between the signs that a hash names
  stand for words.

Candidates are verified by edit similarity (Levenshtein distance over the longer length, in characters, of the normalised
lines). Verified pairs and equal lines make connected groups, and of each group the occurrence with the smallest
(doc_id, line) stays.

Every pair of candidates is compared or already in one group, at every size of a block's group: first its members are
compared with its least one, then all pairs that this has not put into one group.

Defined cases: blank lines always stay; null text has no lines and stays null; a null doc_id comes last; rows that repeat
doc_id and text are treated as one and share their fate; ties within a group go to the smallest doc_id, then the first line;
lines of up to three
words repeat only what is equal, unless short lines are asked for; a very long line has blocks in proportion, and must fit in a row as
its document does; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations
from math import ceil, floor
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import HASHED, discard, fresh, settings, slots, spread, stored
from vexel.llm.graph import connected_components, with_least

SIMILARITY = 0.8
#: Bits of a block: four longs of eight 8-bit counters.
LONGS = 4
BITS = 8 * LONGS
LANES = 0x0101010101010101
#: Blocks of lines of up to 23 words, 47, 95 and so on, doubling; from then on in proportion, 32 words a block at most.
BLOCKS = (4, 6, 8, 12, 16, 24)
#: Level i has lines of SIMILARITY * SHORT * 2^(i-1) words to SHORT * 2^i - 1: near a border a line belongs to two, so that lines
#: of which the shorter has that share of the longer's words at least have a level in common.
SHORT = 24
LEVELS = 16
#: Levels whose lines are candidates by one block.
SINGLE = 4
#: Level of the shortest lines, their words, and the least words of level 0.
TINY, TINY_FROM, TINY_TO, FEW = -1, 4, 9, 8
#: Level of the rows of lines that occur more than once, of the pieces that a short line is cut into, and of those that a shorter
#: line's pieces may have become in it: only the former make candidates, with any under their key.
COPIES, OWN, PIECES = -2, -3, -4
#: Characters of a short line, as the queries ask for it, and one in how many signs ends a piece of a longer one of few words.
SHORT_CHARS, PIECE_SIGNS = 32, 4
#: Bits of a turn beside its level.
TURN_BITS = 8
#: The pairs of level 0's blocks, and the least words of such a pair.
PAIRS = tuple(combinations(range(BLOCKS[0]), 2))
PAIR_WORDS = 2
#: Thresholds of the distance.
BANDS = (4, 8, 12, 16, 24, 32, 48, 64, 80, 96, 128, 160, 192, 256, 512, 1024, 2048, 4096)
#: The threshold that is tried first where it is less than half of what is allowed.
FIRST_BAND = 64
#: Signs of a chunk besides a blank, and the edits from which on chunks are compared before signs.
CHUNK, COARSE = 3, 12
#: Keys of lines up to this many are broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_KEYS = 500_000
#: Votes and keys of a task that the compiled hash map takes, as a power of two; beyond, or a page of memory, Spark's slower one does.
HASH_BITS = 19
#: Parts over which one side of a block's group is dealt for pairs, at most, and the members a part has until all are used.
PARTS, PART_ROWS = 8, 64
#: Characters of lines whose pairs of signs are marked, and the longs of marks.
MARKED, MARKS = 64, 2
MARK_COLUMNS = ("size", *(f"m{k}" for k in range(MARKS)))
LAST = (1 << 63) - 1
#: Signs cut off the ends of a line.
BLANKS = " \r\x0b\x0c"


def normalise(line: Column) -> Column:
    # looking for a tab costs less than replacing none
    lower = F.lower(line)
    plain = F.when(F.contains(line, F.lit("\t")), F.replace(lower, F.lit("\t"), F.lit(" "))).otherwise(lower)
    # cutting goes through the whole line, so only lines with something to cut are cut
    ends = reduce(or_, (f(F.lit(c)) for c in "\t" + BLANKS for f in (line.startswith, line.endswith)))
    return F.when(ends, F.btrim(plain, F.lit(BLANKS))).otherwise(plain)


def node(wide: bool) -> Column:
    """What stands for a line: its first hash, or both."""
    return F.struct("k1", "k2") if wide else F.col("k1")


def exploded(docs: DataFrame) -> DataFrame:
    """doc (null: largest), th (hash of the text), line, norm, and k1, k2: two hashes of norm."""
    # what is taken beside an explosion is taken anew for every line; the outer kind makes no filter of the array
    texts = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("th"), F.split("text", "\n").alias("lines"))
    rows = texts.select("doc", "th", F.posexplode_outer("lines").alias("line", "raw"))
    # blank lines go by what they are, as a condition on norm would make Spark normalise every line twice
    norm = rows.where(F.ltrim("raw", F.lit("\t" + BLANKS)) != "").select("doc", "th", "line", normalise(F.col("raw")).alias("norm"))
    return norm.withColumns({"k1": F.xxhash64("norm"), "k2": F.xxhash64(F.lit(1), F.col("norm"))})


def blocks_of(level: int) -> int:
    return BLOCKS[level] if level < len(BLOCKS) else BLOCKS[-1] << (level - len(BLOCKS) + 1)


def bounds() -> dict[int, tuple[int, int]]:
    """First and last number of words of each level."""
    own = {i: (ceil(SIMILARITY * (SHORT << i - 1)) if i else FEW, (SHORT << i) - 1) for i in range(LEVELS)}
    return {TINY: (TINY_FROM, TINY_TO)} | own | {LEVELS - 1: (own[LEVELS - 1][0], (1 << 31) - 1)}


def turn(level: int, k: int | Column) -> Column:
    """Turn k of a level's votes, in one integer with the level."""
    return F.lit(level << TURN_BITS) + (k if isinstance(k, Column) else F.lit(k))


def turns(level: int, n: Column) -> Column:
    return F.sequence(turn(level, 0), turn(level, n - 1))


def levels(n: Column) -> Column:
    """The turns of the levels of a line of n words: of one level, two near a border, or none.

    A word votes once in its level, but in level 0 for each pair that its block is in, and in TINY for each word left out, or none.
    """
    own = {TINY: n + 1, 0: F.lit(BLOCKS[0] - 1)}
    none = F.array().cast("array<int>")
    found = bounds()
    # of each second level, a line has one at most
    chains = [[i for i in found if i % 2 == odd] for odd in (0, 1)]
    return F.concat(*(F.coalesce(*(F.when(n.between(*found[i]), turns(i, own.get(i, F.lit(1)))) for i in chain), none) for chain in chains))


def pieces(line: Column, similarity: float) -> tuple[Column, Column]:
    """Different hashes of the pieces that a line is cut into, and of other pieces of it; of lines that are alike, the longer has
    one of those that the shorter is cut into, for certain.

    Of two lines alike, the shorter is cut into one piece more than the longer may have edits, so that one piece stays whole.
    The longer doesn't know the shorter's length, so it takes the pieces of all lengths in question, at all places to which
    one can have moved: with d edits of balance before it, the rest of the balance comes behind it.
    """
    def edits(n: Column) -> Column:
        return F.floor(n * F.lit(1 - similarity) + F.lit(1e-9)).cast("int")

    def of_length(n: Column, l: Column, still: bool = False) -> Column:
        count = edits(F.floor(l / F.lit(similarity) + F.lit(1e-9)).cast("int")) + 1
        spare, moved = edits(n) - (n - l), edits(n) + (n - l)

        def at(i: Column) -> Column:
            start, end = (F.floor(k * l / count).cast("int") for k in (i, i + 1))
            places = F.array(F.lit(0)) if still else F.sequence(-F.floor(spare / 2).cast("int"), F.floor(moved / 2).cast("int"))
            return F.transform(places, lambda d: F.xxhash64(l, i, F.substring(line, F.greatest(start + d, F.lit(0)) + 1, end - start)))

        return F.flatten(F.transform(F.sequence(F.lit(0), count - 1), at))

    n = F.char_length(line)
    own = F.array_distinct(of_length(n, n, still=True))
    return own, F.array_except(F.flatten(F.transform(F.sequence(n - edits(n), n), lambda l: of_length(n, l))), own)


def wordless(line: Column) -> Column:
    """Different hashes of the pieces of a line between signs that a hash names."""
    signs = F.transform(F.split(line, ""), lambda c: F.when(F.pmod(F.xxhash64(c), F.lit(PIECE_SIGNS)) == 0, F.concat(c, F.lit("\n"))).otherwise(c))
    return F.array_distinct(F.transform(F.split(F.array_join(signs, ""), "\n"), lambda w: F.xxhash64(w)))


def blocks(docs: DataFrame, short: int = 0, similarity: float = SIMILARITY, wide: bool = False) -> DataFrame:
    """node, level, key: a key for each block (level 0: pair of blocks) of each different line, unlike those of others.

    A line that occurs more than once has two rows of level COPIES, too, under a key of its own; one of up to ``short``
    characters has rows of levels OWN and PIECES, which share keys.
    """
    texts = exploded(docs).select(node(wide).alias("node"), "norm").groupBy("node").agg(F.first("norm").alias("norm"), F.count(F.lit(1)).alias("n"))
    hashes = F.array_distinct(F.transform(F.split("norm", " "), lambda w: F.xxhash64(w))).alias("words")
    words = texts.select("node", "n", hashes, *(["norm"] if short else []))
    none = F.array().cast("array<int>")
    more = [F.when(F.col("n") > 1, turns(COPIES, F.lit(2))).otherwise(none)]
    if short:
        # a condition of two would have Spark count the signs of every line
        is_short = F.when(F.octet_length("norm") <= 4 * short, F.char_length("norm") <= short).otherwise(False)
        more.append(F.when(F.col("norm").isNotNull(), F.array(*(turn(v, 0) for v in (OWN, PIECES)))).otherwise(none))
        few = F.when((F.size("words") < TINY_FROM) & ~is_short, wordless(F.col("norm"))).otherwise(F.col("words"))
        words = words.select("node", "n", few.alias("words"), F.when(is_short, F.col("norm")).alias("norm"))
    leveled = words.select("node", "words", F.explode(F.concat(levels(F.size("words")), *more)).alias("turn"), *(["norm"] if short else []))
    level = F.shiftright("turn", TURN_BITS)
    special = F.when(level == COPIES, F.array(F.lit(0).cast("long")))
    if short:
        own, others = pieces(F.col("norm"), similarity)
        special = special.when(level == OWN, own).when(level == PIECES, others)
    number = F.get(F.array(*(F.lit(blocks_of(i)) for i in range(LEVELS))), F.greatest(level, F.lit(0)))
    # Spark explodes in compiled code only where the array is a column, as lambdas are not compiled; it would make a filter of
    # the whole array, to leave out empty ones, but for the outer kind
    voters = leveled.select("node", "turn", special.otherwise(F.col("words")).alias("words"))
    each = voters.select("node", "turn", number.alias("number"), F.posexplode_outer("words").alias("at", "h")).where("h IS NOT NULL")
    # a word votes in its block; in level 0, by turns in the pairs that its block is in; in TINY in all turns but its own
    turned = F.col("turn").bitwiseAND(F.lit((1 << TURN_BITS) - 1))
    dealt = F.pmod("h", "number").cast("int")
    among = F.array(*(F.lit(k) for i in range(BLOCKS[0]) for k, p in enumerate(PAIRS) if i in p))
    pair = F.get(among, dealt * (BLOCKS[0] - 1) + turned)
    block = F.when(level > 0, dealt).when(level == 0, pair).when(level.isin(OWN, PIECES), F.col("at")).otherwise(turned)
    voting = each.where((level != TINY) | (turned != F.col("at"))).select("node", F.shiftleft(level.cast("long"), 32).bitwiseOR(block.cast("long")).alias("slot"), "h")
    level, block = F.shiftright("slot", 32).cast("int").alias("level"), F.col("slot").bitwiseAND(F.lit((1 << 32) - 1)).alias("block")
    found = _simhash(voting).select("node", level, block, "n", "fp").where((F.col("level") != 0) | (F.col("n") >= PAIR_WORDS))
    name = F.when(F.col("level").isin(TINY, OWN, PIECES), F.lit(0).cast("long")).when(F.col("level") == COPIES, F.xxhash64("node")).otherwise(F.col("block"))
    kind = F.when(F.col("level") == OWN, PIECES).otherwise(F.col("level"))
    return found.select("node", "level", F.xxhash64(kind, name, "n", "fp").alias("key"))


def _simhash(words: DataFrame) -> DataFrame:
    """node, slot, n, fp: number of words and SimHash of each slot of words (node, slot, h)."""
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(LANES & LAST >> 7))).alias(f"s{j}") for j in range(LONGS)]
    # the last lanes and the count share a long, so that no sum can run over: bits 56 to 59 go to lanes of 12 bits
    last = F.shiftrightunsigned("h", 56).bitwiseAND(F.lit((1 << LONGS) - 1))
    spread = reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(last, 11 * j) for j in range(LONGS)))
    ends = spread.bitwiseAND(F.lit(sum(1 << 12 * j for j in range(LONGS)))) + F.lit(1 << 48)
    counted = words.groupBy("node", "slot").agg(*lanes, F.sum(ends).alias("ends"))
    n = F.shiftrightunsigned("ends", 48)
    # counter i of sum j counts bit 8i + j; in lanes of 16 bits, a count over n/2 carries into the lane's bit 7
    wide, ones = 0x00FF00FF00FF00FF, 0x0001000100010001
    lift = (F.lit(127).cast("long") - F.expr("least(n, 127) div 2")) * F.lit(ones)
    fp = F.lit(0).cast("long")
    for j in range(LONGS):
        top = F.shiftleft(F.least(F.shiftrightunsigned("ends", 12 * j).bitwiseAND(F.lit(0xFFF)), F.lit(0xFF)), 56)
        for half in (0, 8):
            lane = F.shiftrightunsigned(F.col(f"s{j}").bitwiseOR(top), half).bitwiseAND(F.lit(wide))
            flags = F.shiftrightunsigned(lane + lift, 7).bitwiseAND(F.lit(ones))
            fp = fp.bitwiseOR(F.shiftleft(flags, j + half))
    return counted.withColumn("n", n).select("node", "slot", "n", fp.alias("fp"))


def shared(rows: DataFrame, most: str = "TRUE", partitions: int | None = None) -> DataFrame:
    """The rows (node, key and others, none of them null) whose key occurs more than once, and whose maxima by key pass ``most``.

    least: the smallest node under the key.
    """
    dealt = rows.repartition(partitions or slots(rows.sparkSession), "key")
    # one exchange serves the counts and the rows, as both read all columns
    others = [c for c in rows.columns if c not in ("key", "node")]
    often = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), *(F.max(c).alias(c) for c in others))
    often = often.where(" AND ".join(["n > 1", most, *(f"{c} IS NOT NULL" for c in ("least", *others))])).select("key", "least")
    return dealt.join(often.hint("shuffle_hash"), "key")


def candidate_groups(docs: DataFrame, short: int = 0, similarity: float = SIMILARITY, wide: bool = False) -> tuple[DataFrame, DataFrame]:
    """(key, node, own, least: lines under the blocks, or pairs of blocks, in which they agree with others; node: lines with equal copies).

    own: whether the line makes candidates with all under the key; the others do so with these alone. least: the smallest node there.
    """
    partitions = spread(docs)
    with settings(docs.sparkSession, {HASHED: HASH_BITS}):
        single = stored(shared(blocks(docs, short, similarity, wide), f"level <> {PIECES}", partitions), partitions)
    paired = F.col("level").between(1, SINGLE - 1)
    own = single.where(paired).groupBy("node", "level").agg(F.sort_array(F.collect_list("key")).alias("keys")).where(F.size("keys") > 1)
    pairs = F.flatten(F.transform("keys", lambda a, i: F.transform(F.slice("keys", i + 2, F.size("keys")), lambda b: F.xxhash64(a, b))))
    double = shared(own.select("node", pairs.alias("keys")).select("node", F.explode("keys").alias("key"))).select("key", "node", F.lit(True).alias("own"), "least")
    rest = single.where(~paired & (F.col("level") != COPIES)).select("key", "node", F.col("level") != PIECES, "least")
    return stored(double.union(rest)), single.where(F.col("level") == COPIES).select("node").distinct()


def told_by_first(lines: DataFrame) -> bool:
    """Whether no two different lines (k1, k2) share their first hash, so that a long can stand for each."""
    return lines.groupBy("k1").agg(F.min("k2").alias("low"), F.max("k2").alias("high")).where("low < high").isEmpty()


def occurrences(docs: DataFrame, near: DataFrame, equal: DataFrame, wide: bool) -> DataFrame:
    """node, doc, th, line, norm, k1, k2: all occurrences of these lines (node).

    norm is null but for lines of near.
    """
    both = near.withColumn("near", F.lit(True)).union(equal.withColumn("near", F.lit(False)))
    needed = stored(both.groupBy("node").agg(F.max("near").alias("near")))
    if needed.count() <= BROADCAST_KEYS:
        needed = F.broadcast(needed)
    found = exploded(docs).withColumn("node", node(wide)).join(needed, "node")
    return stored(found.select("node", "doc", "th", "line", F.when(F.col("near"), F.col("norm")).alias("norm"), "k1", "k2"), spread(docs))


def verified(texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs u, v whose lines are alike enough: Levenshtein distance over the longer length, in characters."""
    both = pairs
    for e, name in (("u", "x"), ("v", "y")):
        both = both.join(texts.select(F.col("node").alias(e), F.col("norm").alias(name), *(F.col(c).alias(f"{c}_{e}") for c in MARK_COLUMNS)), e)
    near = both.where(may_be_alike(similarity)).select("u", "v", "x", "y", F.expr(allowed(similarity)).alias("most"))
    # few bytes can be much work: pairs are dealt evenly
    near = stored(near.repartition(slots(pairs.sparkSession)))
    close = alike(near)
    out = stored(close.select("u", "v"))
    discard(near, close.made_from)
    return out


def alike(pairs: DataFrame) -> DataFrame:
    """The rows whose x and y have a Levenshtein distance of at most ``most``; made_from: the stored table they come from.

    The words that both have at the start and at the end are cut off, which leaves the distance as it is. What remains is
    compared word by word in order; that costs as much as turning one into the other at least, so pairs within ``most`` there
    are settled in linear time. Of the rest, the distance in chunks of words times a chunk's size is a bound of the same kind,
    and only what it leaves takes the distance itself.
    """
    wx, wy, p, q, mx, my, d, c = fresh(pairs, "wx", "wy", "p", "q", "mx", "my", "d", "c")

    def same(x: Column, y: Column) -> Column:
        """How many words x and y share from the start on."""
        at = F.array_position(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), F.lit(False))
        return F.when(at > 0, at - 1).otherwise(F.size(x)).cast("int")

    x, y = F.col(wx), F.col(wy)
    split = pairs.withColumns({wx: F.split("x", " "), wy: F.split("y", " ")}).withColumn(p, same(x, y))
    ends = F.least(same(F.reverse(x), F.reverse(y)), F.least(F.size(x), F.size(y)) - F.col(p))
    middles = split.withColumn(q, ends).withColumns({m: F.slice(w, F.col(p) + 1, F.size(w) - F.col(p) - F.col(q)) for m, w in ((mx, x), (my, y))})
    nothing = F.lit("")
    steps = F.zip_with(mx, my, lambda a, b: F.levenshtein(F.coalesce(a, nothing), F.coalesce(b, nothing)) + F.when(a.isNull() | b.isNull(), 1).otherwise(0))
    costed = middles.withColumn(d, F.aggregate(steps, F.lit(0), lambda total, c: total + c))
    # with a blank after every word, parts of lines have the distance of the lines
    left, right = (F.when(F.col(d) > F.col("most"), F.array_join(F.transform(m, lambda w: F.concat(w, F.lit(" "))), "")) for m in (mx, my))
    # written down, as a filter would move below the steps and take each of them many times over
    parts = costed.select(*pairs.columns, d, left.alias(mx), right.alias(my))
    parts = stored(parts.withColumn(c, F.when((F.col(d) > F.col("most")) & (F.col("most") > COARSE), coded(F.col(mx), F.col(my)))))
    coarse = F.col(c).isNotNull() & within(F.col(c)["x"], F.col(c)["y"], F.floor(F.col("most") / (CHUNK + 1)).cast("int"))
    close = parts.where(F.when(F.col(d) <= F.col("most"), True).when(coarse, True).otherwise(within(F.col(mx), F.col(my), F.col("most"))))
    out = close.select(*pairs.columns)
    out.made_from = parts
    return out


def coded(x: Column, y: Column) -> Column:
    """Struct of x and y with one sign for each chunk of their words; null if a sign stands for two chunks there."""

    def let(value: Column, then: Callable[[Column], Column]) -> Column:
        """then(value), with the value taken once."""
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def chunks(line: Column) -> Column:
        return F.regexp_extract_all(line, F.lit(f"[^ ]{{1,{CHUNK}}} ?| "), F.lit(0))

    def codes(parts: Column) -> Column:
        return F.transform(parts, lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(1 << 20)) + F.lit(1 << 16)), 8, "0"))

    def signs(hexes: Column) -> Column:
        return F.decode(F.unhex(F.array_join(hexes, "")), "UTF-32")

    def done(t: Column) -> Column:
        one = F.size(F.array_distinct(F.concat(t["x"], t["y"]))) == F.size(F.array_distinct(F.concat(t["cx"], t["cy"])))
        return F.when(one, F.struct(signs(t["cx"]).alias("x"), signs(t["cy"]).alias("y")))

    both = F.struct(chunks(x).alias("x"), chunks(y).alias("y"))
    return let(both, lambda t: let(F.struct(t["x"].alias("x"), t["y"].alias("y"), codes(t["x"]).alias("cx"), codes(t["y"]).alias("cy")), done))


def bounded(x: Column, y: Column, band: int) -> Column:
    """The distance, or more than any line has where it is over the band (-1 to Spark); taken once."""
    return F.levenshtein(x, y, band).bitwiseAND(F.lit((1 << 31) - 1))


def within(x: Column, y: Column, most: Column) -> Column:
    """Whether the Levenshtein distance is at most ``most``, which differs by row.

    Spark's threshold is a constant, and costs by its size: where much is allowed, a small one settles most near copies; after
    that the next threshold from ``most`` on decides.
    """
    out = F.levenshtein(x, y) <= most
    for band in reversed(BANDS):
        out = F.when(most <= band, bounded(x, y, band) <= most).otherwise(out)
    return F.when((most > 2 * FIRST_BAND) & (bounded(x, y, FIRST_BAND) <= FIRST_BAND), True).otherwise(out)


def marks(line: Column) -> list[Column]:
    """Bits of the different pairs of neighbouring signs of a line, in MARKS longs; a single sign has none."""

    def bits(k: int) -> Column:
        def add(seen: Column, i: Column) -> Column:
            at = F.pmod(F.xxhash64(F.substring(line, i, 2)), F.lit(64 * MARKS))
            return seen.bitwiseOR(F.when(F.floor(at / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long")))

        n = F.char_length(line)
        return F.when(n < 2, F.lit(0).cast("long")).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0).cast("long"), add))

    return [bits(k) for k in range(MARKS)]


def allowed(similarity: float) -> str:
    """SQL: the edits that lines of size_u and size_v signs may have."""
    return f"cast(floor(greatest(size_u, size_v) * {1 - similarity!r}D + 1e-9D) as int)"


def may_be_alike(similarity: float) -> str:
    """SQL: false only for lines u and v that have more edits than allowed.

    Their lengths differ by no more. An edit changes two pairs of neighbouring signs at most, so no line has more than two for
    each allowed edit that the other lacks.
    """
    lacks = [" + ".join(f"bit_count({c}_{a} & ~{c}_{b})" for c in MARK_COLUMNS[1:]) for a, b in ("uv", "vu")]
    return " AND ".join([f"abs(size_u - size_v) <= {allowed(similarity)}", *(f"coalesce({x} <= 2 * {allowed(similarity)}, true)" for x in lacks)])


def marked(texts: DataFrame) -> DataFrame:
    """node, norm, its size, and its marks, null beyond MARKED signs."""
    size = F.char_length("norm")
    return texts.select("node", "norm", size.alias("size"), *(F.when(size <= MARKED, m).alias(c) for c, m in zip(MARK_COLUMNS[1:], marks(F.col("norm")))))


def near_signs(similarity: float) -> Column:
    """Whether lines sign_u and sign_v of up to MARKED signs are alike; true where one is null, that is, longer."""
    close = bounded(F.col("sign_u"), F.col("sign_v"), floor(MARKED * (1 - similarity) + 1e-9)) <= F.expr(allowed(similarity))
    return F.coalesce(close, F.lit(True))


def signed(texts: DataFrame) -> DataFrame:
    """node, the columns of marks, and the line itself up to MARKED signs."""
    return texts.select("node", *MARK_COLUMNS, F.when(F.col("size") <= MARKED, F.col("norm")).alias("sign"))


def possible(texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs u, v without those that their marks, or their few signs, tell apart."""
    for e in "uv":
        pairs = pairs.join(signed(texts).select(F.col("node").alias(e), *(F.col(c).alias(f"{c}_{e}") for c in (*MARK_COLUMNS, "sign"))), e)
    return pairs.where(may_be_alike(similarity)).where(near_signs(similarity)).select("u", "v")


def pairs_apart(placed: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """u, v: the pairs under a key (key, node, own, root) with different roots of which one is own, unless they can't be alike.

    The side of all is dealt over the parts of its key, and the own ones, of which a short line has far fewer, go to every part.
    Pairs of unlike short lines grow with the square of a key's lines, so lines of up to MARKED signs are compared where they
    meet: only pairs that are alike are written.
    """
    # one exchange serves the counts and the rows, as both read all columns
    placed = placed.where("key IS NOT NULL AND node IS NOT NULL").repartition(slots(placed.sparkSession), "key")
    ends = (f(c).alias(f"{f.__name__}_{c}") for c in ("root", "node", "own") for f in (F.min, F.max))
    mixed = placed.groupBy("key").agg(*ends, F.count(F.lit(1)).alias("n")).where("min_root <> max_root AND min_node <> max_node AND max_own")
    rest = placed.join(mixed.select("key", F.least(F.ceil(F.col("n") / PART_ROWS), F.lit(PARTS)).cast("int").alias("parts")), "key")
    rest = stored(rest.join(signed(texts), "node"))
    left, right = (rest.select("key", "parts", *(F.col(c).alias(f"{c}_{e}") for c in ("node", "root", "own", "sign", *MARK_COLUMNS))) for e in "uv")
    left = left.where("own_u").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "own_u")
    right = right.withColumn("part", F.pmod(F.xxhash64("node_v"), F.col("parts")).cast("int")).drop("parts")
    met = left.join(right, ["key", "part"]).where(f"root_u <> root_v AND (node_u < node_v OR NOT own_v) AND {may_be_alike(similarity)}")
    out = stored(met.where(near_signs(similarity)).select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v")).distinct())
    discard(rest)
    return out


def line_groups(members: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """node, root: every line that is alike to another, from candidates (key, node, own, least) and their texts (as marked() gives them)."""
    star = stored(members.where("node <> least").groupBy(F.col("least").alias("u"), F.col("node").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    # a line meets the one first that it shares most keys with, which mostly settles the others
    best = stored(star.groupBy("v").agg(F.max(F.struct("n", "u")).alias("best")).select("best.u", "v"))
    roots = connected_components(verified(texts, best, similarity))
    others = star.join(best, ["u", "v"], "left_anti").select("u", "v")
    for e in "uv":
        others = others.join(roots.select(F.col("node").alias(e), F.col("root").alias(f"root_{e}")), e, "left")
    apart = stored(possible(texts, others.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v"), similarity))
    roots = linked(roots, verified(texts, apart, similarity))
    placed = members.join(roots, "node", "left").select("key", "node", "own", F.coalesce("root", "node").alias("root"))
    met = pairs_apart(placed, texts, similarity)
    # what is apart under its key's least line has been compared
    rest = verified(texts, stored(met.join(star, ["u", "v"], "left_anti").select("u", "v")), similarity)
    discard(met, best, apart, star)
    return linked(roots, rest)


def linked(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node, root: the groups of roots, joined by links (u, v), which also have nodes of their own."""
    if links.isEmpty():
        return roots
    # links are few: they join groups, and lines that had none
    ends = links.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    ends = stored(ends)
    sides = [ends.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "uv"]
    joined = connected_components(links.join(sides[0], "u").join(sides[1], "v").select(F.col("root_u").alias("u"), F.col("root_v").alias("v")))
    every = roots.union(ends.where("node = root").join(roots, "node", "left_anti").select("node", "root"))
    return stored(every.join(joined.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left").select("node", F.coalesce("last", "root").alias("root")))


def repeated(docs: DataFrame, similarity: float = SIMILARITY, short: int = 0) -> DataFrame:
    """doc, th, line: the occurrences of lines that occur before, alike or nearly."""
    # one hash tells the lines as good as always; two lines that share it are counted as copies, and so are met here
    for wide in (False, True):
        members, equal = candidate_groups(docs, short, similarity, wide)
        found = occurrences(docs, members.select("node"), equal, wide)
        if wide or told_by_first(found):
            break
        discard(members, found)
    texts = stored(marked(found.where("norm IS NOT NULL").groupBy("node").agg(F.first("norm").alias("norm"))))
    roots = line_groups(members, texts, similarity)
    place = F.struct("doc", "line")
    first = found.groupBy("node").agg(F.min(place).alias("place"))
    rooted = first.join(roots, "node", "left").select("node", "place", F.coalesce("root", "node").alias("root"))
    # the first place goes from the lines to their group and back
    kept = stored(with_least(rooted.select(F.col("root").alias("u"), F.struct("place", "node").alias("v"))).select("v.node", F.col("m.place").alias("kept")))
    discard(members, texts)
    if kept.count() <= BROADCAST_KEYS:
        kept = F.broadcast(kept)
    return found.select("node", "doc", "th", "line").join(kept, "node").where(place > F.col("kept")).select("doc", "th", "line")


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, counts: tuple[str, str] | None = None, short: int = 0) -> DataFrame:
    """docs with text without its repeated lines; counts: names of columns on end for lines and lines removed.

    short: lines of up to so many characters are compared completely, however few words they have.
    """
    doc, th, d, t, gone, parts = fresh(docs, "doc", "th", "d", "t", "gone", "parts")
    by_doc = repeated(docs, similarity, short).groupBy(F.col("doc").alias(d), F.col("th").alias(t)).agg(F.collect_set("line").alias(gone))
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), th: F.xxhash64("text")})
    joined = keyed.join(by_doc.hint("shuffle_hash"), (keyed[doc] == by_doc[d]) & (keyed[th] == by_doc[t]), "left").withColumn(parts, F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(parts), i)), "\n"))
    others = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    lost = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone))
    seen = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts))
    more = [seen.cast("long").alias(counts[0]), lost.cast("long").alias(counts[1])] if counts else []
    return joined.select(*others, *more)
