"""Chat formatting, mixing, line dedup, quality, nearest neighbours and the pipeline."""

import hashlib
import os
import random
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import data
from vexel.llm import ann, chat, common, lines, mix, quality, queries


def test_chat(spark):
    rng = random.Random(2)
    bits = ["<|im_start|>", "<|im_end|>", "<|im_sep|>", "&amp;", "&lt;|", "<", "|", "&", "\n", "assistant", " ok ", "é🙂", "<|"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            text = rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))])
            rows.append((conv if conv else None, turn, rng.choice(["user", "assistant", "system", "us\ner&nl;", None]), text, "x"))
    rows += [(77, t, "assistant", f"turn {t}", "x") for t in range(400)] + [(78, 1, "user", "tie", "x")] * 3 + [(78, None, "user", "first", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string").repartition(4)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if r[1] is None else r[1]), r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(a, b) for _, a, b in own]
        assert got[conv]["loss_text"] == "".join(b for _, a, b in own if a == "assistant")
        starts = got[conv]["formatted"].count("<|im_start|>")
        assert starts == sum(1 for i, x in enumerate(own) if i == 0 or own[i - 1][1] != x[1])
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def fill(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        left, mass = total - sum(full.values()), sum(w[s] for s in rest)
        share = {s: left * w[s] / mass for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return full | share
        full |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": int(10 ** rng.uniform(0, 5)) for i in range(14)} | {None: 500, "zero": 0}
    got = {r["source"]: r["target"] for r in mix.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = fill(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_mix(spark):
    rng = random.Random(9)
    rows = [(i, data.sentence(rng, rng.randint(1, 30)), "xx", rng.choice(["a"] * 6 + ["b", "b", None]), 1, "k", 7, 0.5, 9, "w", "c") for i in range(3000)]
    df = data.frame(spark, rows)
    once, again = (mix.rates(df.select("doc_id", "text", "source")).orderBy("doc_id").collect() for _ in range(2))
    assert once == again
    for s in ("a", "b", None):
        own = [r for r in once if r["source"] == s]
        assert sum(r["copies"] * r["size"] for r in own) == pytest.approx(own[0]["target"], rel=0.01)
        assert max(r["copies"] for r in own) <= 3 and max(r["copies"] for r in own) - min(r["copies"] for r in own) <= 1
    mixed = mix.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in once)
    assert mixed.where("size <> 7").count() == 0
    odd = data.frame(spark)
    assert mix.rates(odd.select("doc_id", "text", "source")).count() == len(data.rows())
    assert mix.mix(data.empty(spark)).count() == 0


def test_mix_of_small_sources():
    """Few cells of very different sizes come near the wanted words, and each is drawn with the fraction's probability."""
    rng = random.Random(2)
    for fraction in (0.1, 0.5, 0.8):
        off, drawn = [], np.zeros(50)
        for k in range(400):
            cells = [(int(3 + 400 * rng.paretovariate(2)), i) for i in range(50)]
            total = sum(w for w, _ in cells)
            longs = mix.draw_cells(f"s{k}", cells, fraction * total)
            taken = [longs[i // 64] >> i % 64 & 1 for _, i in cells]
            off.append(abs(sum(t * w for t, (w, _) in zip(taken, cells)) - fraction * total) / total)
            drawn += taken
        assert np.median(off) < 0.01 and np.mean(off) < 0.05 and abs(drawn.mean() / 400 - fraction) < 0.03


def test_mix_on_the_table(spark):
    """Every source of the table comes within a tenth of its target."""
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no tables")
    rows = queries.op3_mixing(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "source")
    for r in rows.join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect():
        assert r["taken"] == pytest.approx(r["target"], rel=0.1) and r["over"] <= 0


def test_lines(spark):
    line = "the quick brown fox jumps over the lazy dog while seventeen other animals watch from the hill nearby and say nothing at all about it today"
    near = f"  {line.upper()} "
    rows = [(1, f"{line}\n\nunique one"), (2, f"first words\n{near}\nunique two"), (3, line), (4, None), (5, ""), (6, "---\n---"), (None, f"{line}\nlast of all"), (3, line), (7, "unique one\nunique one\nnew")]
    df = spark.createDataFrame([(*r, "d", 5) for r in rows], "doc_id long, text string, doc string, `__gone` int").repartition(3)
    got = lines.dedup_lines(df, counts=("n", "m"))
    assert got.columns == [*df.columns, "n", "m"]
    kept = sorted(((r["doc_id"] if r["doc_id"] is not None else 999), r["text"], r["n"], r["m"]) for r in got.collect() if r["doc_id"] != 4)
    assert kept == [
        (1, f"{line}\n\nunique one", 3, 0), (2, "first words\nunique two", 3, 1), (3, "", 1, 1), (3, "", 1, 1), (5, "", 1, 0), (6, "---", 2, 1),
        (7, "new", 3, 2), (999, "last of all", 2, 1),
    ]
    assert got.where("doc_id = 4 AND text IS NULL").count() == 1
    assert lines.dedup_lines(data.empty(spark)).count() == 0
    assert lines.dedup_lines(data.frame(spark)).count() == len(data.rows())


def changed(rng, words, n):
    """The line with n words replaced."""
    out = list(words)
    for i in rng.sample(range(len(words)), n):
        out[i] = data.sentence(rng, 1, "mnopqrst")
    return " ".join(out)


def levenshtein(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x):
        last, row[0] = row[0], i + 1
        for j, b in enumerate(y):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (a != b))
    return row[-1]


@lru_cache(maxsize=None)
def level_blocks(line):
    """{level: {block: (SimHash of its words, their number)}} by the plain rule."""
    words, out = list(dict.fromkeys(line.split(" "))), {}
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]

    def cell(hs):
        kept = [8 * i + j for i in range(8) for j in range(lines.LONGS)]
        return sum(1 << k for k in kept if 2 * sum(h >> k & 1 for h in hs) > len(hs)), len(hs)

    for level, (low, high) in lines.bounds().items():
        if low <= len(words) <= high:
            cells = defaultdict(list)
            for at, h in enumerate(hashes):
                b = (h - (1 << 64) if h >> 63 else h) % lines.blocks_of(max(level, 0))
                for k in [x for x in range(len(words) + 1) if x != at] if level < 0 else [p for p in lines.PAIRS if b in p] if level == 0 else [b]:
                    cells[k].append(h)
            out[level] = {k: cell(hs) for k, hs in cells.items() if level or len(hs) >= lines.PAIR_WORDS}
    return out


def candidates(x, y):
    a, b = level_blocks(x), level_blocks(y)
    if -1 in a and -1 in b and set(a[-1].values()) & set(b[-1].values()):
        return True
    return any(sum(a[v].get(k) == c for k, c in b[v].items()) >= (2 if 0 < v < lines.SINGLE else 1) for v in a.keys() & b.keys() if v >= 0)


def near(x, y):
    return levenshtein(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9


def test_line_blocks(spark):
    """Counters packed in longs give the plain SimHash of each block."""
    rng = random.Random(7)
    texts = [data.sentence(rng, n) for n in (1, 3, 19, 20, 22, 23, 24, 45, 100, 400, 900, 3000)] + ["a", "zé zé été b"]
    got = lines.blocks(spark.createDataFrame(list(enumerate([*texts, " A "])), "doc_id long, text string")).collect()
    want = [(v, k if v >= 0 else 0, *c) for t in texts for v, cells in level_blocks(t).items() for k, c in cells.items()]
    copies = [r for r in got if r["level"] == lines.COPIES]
    assert len(copies) == 2 and len({r["key"] for r in copies}) == 1
    assert len(got) == len(want) + 2
    assert len({r["key"] for r in got}) == len(set(want)) + 1


def test_line_plans_do_no_work_twice(spark):
    """A line is normalised once, and no array is made anew, or by lambdas, where it is exploded."""
    df = spark.createDataFrame([(1, "a line"), (2, " \t\r\n\x0b\x0c ")], "doc_id long, text string")
    assert [(r["doc"], r["norm"]) for r in lines.exploded(df).collect()] == [(1, "a line")]
    assert sum("lower(" in p for p in lines.exploded(df)._jdf.queryExecution().optimizedPlan().toString().split("\n")) == 1
    plan = lines.blocks(df, lines.SHORT_CHARS)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [p for p in plan if ("Generate" in p or "Filter" in p) and "lambda" in p]


def test_lines_against_brute_force(spark):
    """Families of far more than 32 variants, equal words in other orders, short lines: every candidate's links count."""
    rng = random.Random(1)
    texts = []
    for size, n in ((50, 24), (40, 9), (20, 50), (8, 170), (12, 5)):
        words = data.sentence(rng, n).split()
        texts += [changed(rng, words, rng.randint(0, max(1, n // 5))) for _ in range(size)]
        texts += [" ".join(rng.sample(words, n)) for _ in range(4)] + [changed(rng, words[::-1], 1), " ".join([*words, "more"]), " ".join(words[1:])]
    texts += [data.sentence(rng, rng.randint(1, 6), "abc") for _ in range(40)]
    rng.shuffle(texts)
    names = list(dict.fromkeys(texts))
    root = {t: t for t in names}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, x in enumerate(names):
        for y in names[:i]:
            if abs(len(x) - len(y)) <= 0.2 * max(len(x), len(y)) and candidates(x, y) and near(x, y):
                root[find(x)] = find(y)
    seen, want = set(), []
    for t in texts:
        want.append("" if find(t) in seen else t)
        seen.add(find(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [r["text"] for r in lines.dedup_lines(df).orderBy("doc_id").collect()]
    assert got == want and 20 < sum(t == "" for t in want) < len(want) - 20


def test_line_recall(spark):
    """A changed word hides hardly any copy, however short the line, and most copies with a twentieth of their words changed go."""
    rng = random.Random(4)
    rows, kind = [], {}
    for k in range(40):
        for n in (5, 8, 12, 20, 41, 80):
            words = [data.sentence(rng, 1, "abcdefghijkl") + "x" for _ in range(n)]
            for share in (0, 0.05):
                copy = changed(rng, words, max(1, int(n * share)))
                if near(" ".join(words), copy):
                    kind[len(rows) + 1] = (n, share)
                rows += [" ".join(words), copy]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    found = defaultdict(list)
    for i, key in kind.items():
        found[key].append(got[i] == "")
    assert all(np.mean(v) >= 0.95 for (_, share), v in found.items() if not share), {k: np.mean(v) for k, v in found.items()}
    assert all(np.mean(v) >= 0.9 for v in found.values()), {k: np.mean(v) for k, v in found.items()}


def test_short_lines_lose_no_link(spark):
    """Short lines, of one word or more, against brute force over all pairs; longer ones without blanks."""
    rng = random.Random(9)
    texts = ["internationalisation committees", "internationalization committee", "somewhere over", "some where over", "café", "cafés", "naïve é", "naïve e"]
    for n in (4, 5, 7, 10, 13, 16, 20, 24, 29, 32):
        for _ in range(4):
            whole = "".join(rng.choice("abcdefghij ") for _ in range(n)).strip() or "a"
            texts.append(whole)
            for _ in range(3):
                copy = list(whole)
                for _ in range(rng.randint(1, max(1, n // 5))):
                    at, kind = rng.randrange(len(copy) + 1), rng.randrange(3)
                    copy[at : at + (kind > 0)] = rng.choice("abcdefghij") if kind < 2 else ""
                texts.append("".join(copy)[: lines.SHORT_CHARS].strip() or "b")
    names = list(dict.fromkeys(texts))
    root = {t: t for t in names}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, x in enumerate(names):
        for y in names[:i]:
            if near(x, y):
                root[find(x)] = find(y)
    seen, want = set(), []
    for t in texts:
        want.append("" if find(t) in seen else t)
        seen.add(find(t))
    long = "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(120))
    texts += [long, long[:60] + "-" + long[61:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [r["text"] for r in lines.dedup_lines(df, short=lines.SHORT_CHARS).orderBy("doc_id").collect()]
    assert got == [*want, long, ""] and sum(t == "" for t in want) > 60


def test_short_lines_make_few_pairs(spark, monkeypatch):
    """Short lines of the same syllables share pieces all over; of their pairs, few are compared, and none that is alike is lost."""
    rng = random.Random(11)
    syllables = [data.sentence(rng, 1, "abcdefghijklmnop")[:3] for _ in range(40)]
    texts = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(5))[:32].strip() for _ in range(160)]
    texts += [t[:k] + rng.choice("xyz") + t[k + 1 :] for t in texts[:40] for k in (rng.randrange(len(t)),)]
    names = list(dict.fromkeys(texts))
    root = {t: t for t in names}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, x in enumerate(names):
        for y in names[:i]:
            if abs(len(x) - len(y)) <= 6 and near(x, y):
                root[find(x)] = find(y)
    seen, want = set(), []
    for t in texts:
        want.append("" if find(t) in seen else t)
        seen.add(find(t))
    compared, verified = [], lines.verified
    monkeypatch.setattr(lines, "verified", lambda texts, pairs, similarity: compared.append(pairs.count()) or verified(texts, pairs, similarity))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [r["text"] for r in lines.dedup_lines(df, short=lines.SHORT_CHARS).orderBy("doc_id").collect()]
    assert got == want and 30 < sum(t == "" for t in want) < 100
    assert compared[1] < len(names) * (len(names) - 1) // 2 // 100, compared


def test_line_tables_stay_small(spark, tmp_path, monkeypatch):
    """Exchanges of text have partitions by the table's size, and unlike short lines under one key are not written as pairs."""
    spark.range(2000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text")).write.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(common, "SPREAD_BYTES", 5000)
    docs, before = spark.read.parquet(str(tmp_path / "docs")), spark.conf.get("spark.sql.shuffle.partitions")
    assert common.spread(docs) > 20 and common.spread(data.empty(spark)) == int(before)
    assert common.stored(docs.groupBy(F.spark_partition_id().alias("p")).count(), 50).count() > 0
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    asked = []
    monkeypatch.setattr(lines, "stored", lambda df, *more: asked.append(more) or common.stored(df, *more))
    lines.dedup_lines(docs)
    assert asked[0] == (common.spread(docs),)
    texts = lines.marked(spark.createDataFrame([(1, "abcdefghij"), (2, "abcxyzghij"), (3, "abcdefghxy"), (4, "abcdefghij" * 9), (5, "abcdefghij" * 8 + "k" * 10)], "node long, norm string"))
    placed = spark.createDataFrame([(7, i, True, i) for i in range(1, 6)], "key long, node long, own boolean, root long")
    assert {(r["u"], r["v"]) for r in lines.pairs_apart(placed, texts).collect()} == {(1, 3), (4, 5)}


def test_lines_compare_no_pair_twice(spark, monkeypatch):
    """A line is compared with one other first, no pair is compared again, and a text is hashed once, not with each line."""
    plan = lines.exploded(spark.createDataFrame([(1, "a line")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert [p for p in plan if "Generate" in p or "xxhash64(text" in p][0].lstrip(" +-:").startswith("Generate")
    rng = random.Random(21)
    base = data.sentence(rng, 40).split()
    texts = [" ".join(base)] + [changed(rng, base, n % 9 + 1) for n in range(60)]
    compared, verified = [], lines.verified
    monkeypatch.setattr(lines, "verified", lambda texts, pairs, similarity: compared.append([(r["u"], r["v"]) for r in pairs.collect()]) or verified(texts, pairs, similarity))
    lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    first, every = [v for _, v in compared[0]], [p for pairs in compared for p in pairs]
    assert 20 < len(first) == len(set(first)) and len(every) == len(set(every))


def test_lines_that_share_their_first_hash(spark, monkeypatch):
    """Two hashes tell lines where the first alone doesn't."""
    df = spark.createDataFrame([(1, 2), (1, 3), (2, 2)], "k1 long, k2 long")
    assert not lines.told_by_first(df) and lines.told_by_first(df.where("k2 = 2"))
    rng = random.Random(12)
    texts = [data.sentence(rng, n) for n in (3, 6, 12, 30, 60) for _ in range(4)]
    texts += [changed(rng, t.split(), 1) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    one = lines.dedup_lines(df, short=lines.SHORT_CHARS).orderBy("doc_id").collect()
    monkeypatch.setattr(lines, "told_by_first", lambda rows: False)
    assert lines.dedup_lines(df, short=lines.SHORT_CHARS).orderBy("doc_id").collect() == one and any(r["text"] == "" for r in one)


def test_chunks_bound_the_distance(spark, monkeypatch):
    """Long lines with words put in, left out and replaced are settled by chunks, and never against the distance in characters."""
    rng = random.Random(13)
    pairs = []
    for k in range(120):
        words = data.sentence(rng, rng.randint(20, 40), "abé").split()
        copy = [w for w in words if rng.random() > 0.002 * k]
        copy = " ".join(data.sentence(rng, 1, "xyz") if rng.random() < 0.002 * k else w for w in [*copy[:3], "put in", *copy[3:]])
        pairs.append((" ".join(words), copy, int(0.2 * max(len(copy), len(" ".join(words))))))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x string, y string, most int")
    want = {i for i, (x, y, m) in enumerate(pairs) if levenshtein(x, y) <= m}
    assert {r["i"] for r in lines.alike(df).collect()} == want and 20 < len(want) < 110
    chunked = df.select("i", "most", lines.coded(F.col("x"), F.col("y")).alias("c")).where("c IS NOT NULL")
    settled = {r["i"] for r in chunked.where(F.levenshtein("c.x", "c.y") <= F.floor(F.col("most") / (lines.CHUNK + 1))).collect()}
    assert settled <= want and len(settled) > len(want) // 2


def test_levels_overlap_by_the_similarity():
    """Lines of which the shorter has 0.8 of the longer's words have a level in common."""
    own = {n: {v for v, (a, z) in lines.bounds().items() if a <= n <= z} for n in range(4, 400)}
    assert all(own[m] & own[n] for n in own for m in own if lines.SIMILARITY * n <= m < n)


def test_lines_with_tabs_and_returns(spark):
    df = spark.createDataFrame([(1, "Some line of text\r\n\tother\twords here "), (2, "some line of text\nother words here\x0b")], "doc_id long, text string")
    assert [r["text"] for r in lines.dedup_lines(df).orderBy("doc_id").collect()] == ["Some line of text\r\n\tother\twords here ", ""]


def test_edits_count_in_characters(spark):
    """Candidates are verified by characters, whatever way is taken to the distance."""
    rng = random.Random(5)
    texts = ["invoice number 4711", "invoice number 4712", "some where over the rainbow", "somewhere over the rainbow", "quite another line", "a", "b", "a b", "b a"]
    for _ in range(60):
        words = data.sentence(rng, rng.randint(1, 12), "ab").split()
        texts += [" ".join(words), " ".join(words[rng.randint(0, 2) :] + words[:1]), changed(rng, words, rng.randint(1, len(words)))]
    pairs = [(x, y, m) for x in texts for y in rng.sample(texts, 6) for m in (0, 1, 3, 9)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x string, y string, most int")
    got = {r["i"] for r in lines.alike(df).collect()}
    assert got == {i for i, (x, y, m) in enumerate(pairs) if levenshtein(x, y) <= m}


def test_lines_in_two_orders(spark):
    """Near copies of each other, but not of the first line with their fingerprint, are found."""
    words = data.sentence(random.Random(6), 30).split()
    turned = list(reversed(words))
    x, y = " ".join(turned), " ".join([turned[1], turned[0], *turned[2:]])
    df = spark.createDataFrame([(0, " ".join(words)), (1, x), (2, y)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()} == {0: " ".join(words), 1: x, 2: ""}


def test_within(spark):
    rows = [("kitten", "sitting", 3), ("kitten", "sitting", 2), ("", "", 0), ("a" * 300, "a" * 290 + "b" * 10, 10), ("a" * 300, "b" * 300, 299), ("abc", "abc", 0)]
    got = [r["w"] for r in spark.createDataFrame(rows, "x string, y string, m int").select(lines.within(F.col("x"), F.col("y"), F.col("m")).alias("w")).collect()]
    assert got == [True, False, True, True, False, True]


def test_quality(spark):
    rng = random.Random(3)
    rows = [(i, data.sentence(rng, rng.randint(5, 60)) if i % 5 else " ".join(w + "%%%" for w in data.sentence(rng, rng.randint(5, 60)).split())) for i in range(400)]
    rows += [(1000, None), (1001, ""), (None, "some words"), (1002, "ab")]
    df = spark.createDataFrame([(*r, 0.1, 4) for r in rows], "doc_id long, text string, `__weight` double, quality int").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    kept = quality.keep(df, labels)
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids >= {i for i in range(400) if i % 5} | {1000, 1001} and not any(i % 5 == 0 for i in ids if i is not None and i < 400)
    assert quality.keep(df, labels, "w").where("w IS NULL").count() == 0
    assert quality.keep(df, labels.limit(0)).count() == len(rows)
    assert quality.keep(df.limit(0), labels).count() == 0


def test_kth_largest(spark):
    rng = random.Random(7)
    keys = [rng.choice([rng.randint(-5, 5), rng.getrandbits(45) - (1 << 44)]) for _ in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in (1, 2, 17, 250, 500):
        assert quality.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]
    assert quality.kth_largest(df, 0) is None and quality.kth_largest(df.limit(0), 3) is None


def test_importance_against_brute_force(spark):
    """Means of log ratios over byte trigrams, words and pairs of words, with tables of our own."""
    texts = ["the cat sat on the mat", "the the the dog", "é à la carte", "", None, "ab", "x", " \t\n", "one\ntwo  three\tone two", "a" * 50]
    column = pa.array(texts, pa.string())
    ratios = np.random.default_rng(3).normal(size=quality.NONE)
    got = [r["w"] for r in quality.weighted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), ratios, "w").orderBy("doc_id").collect()]
    words = sorted({w for t in texts for w in (t or "").split()})
    # cells of single words, from texts of one word
    cell = dict(zip(words, (int(c[0]) for c in np.split(quality.ngrams(pa.array(words))[1][0], len(words)))))
    pair = {(a, b): int(quality.ngrams(pa.array([f"{a} {b}"]))[2][0][0]) for a in words for b in words}
    assert all((c == quality.EQUAL) == (a == b) for (a, b), c in pair.items())
    assert len(set(cell.values())) == len(cell) and all(quality.CELLS <= c < 2 * quality.CELLS for c in cell.values())
    for t, w in zip(texts, got):
        raw, own = (t or "").encode(), (t or "").split()
        three = [(int.from_bytes(raw[i : i + 3]) * 2654435761 % (1 << 32)) >> 16 for i in range(len(raw) - 2)]
        want = [*three, *(cell[x] for x in own), *(pair[p] for p in zip(own, own[1:]))]
        assert w == pytest.approx(quality.LENGTH * sum(ratios[c] for c in want) / max(1, len(want)), abs=1e-9)
    assert sum(len(c) for c, _ in quality.ngrams(column)) > 0


def test_sample_against_brute_force(spark):
    """The k rows with the largest sum of weight and noise, in any number of partitions."""
    rng = random.Random(4)
    rows = [(i, f"t{i % 90}", rng.gauss(0, 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, weight double").withColumn("key", quality.perturbed(F.col("weight"))).repartition(4)
    keys = sorted((r["key"] for r in df.collect()), reverse=True)
    for at in (-2.0, 0.0, 4.0, 99.0):
        k = sum(w >= at for _, _, w in rows)
        assert sorted((r["key"] for r in quality.top(df, "weight", "key", at).collect()), reverse=True) == keys[:k]
    noise = np.array([r["n"] for r in spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).select((quality.perturbed(F.lit(0.0)) / quality.GRAIN).alias("n")).collect()])
    assert abs(noise.mean() - 0.5772) < 0.1 and abs(noise.std() - 1.2825) < 0.1  # a Gumbel distribution's mean and deviation


def brute_nearest(rows, queries, k=5):
    """{query: [(vec_id, score)]} over usable rows {vec_id: vector}."""
    out = {}
    for q in queries:
        v = rows[q]
        scored = [(-float((rows[i] * v).sum() / (np.sqrt((rows[i] * rows[i]).sum()) * np.sqrt((v * v).sum()))), i) for i in rows if i != q and len(rows[i]) == len(v)]
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_nearest(spark):
    """Odd rows, ties, repeated rows, one block."""
    rng = np.random.default_rng(5)
    x = {i: rng.normal(size=8).astype(np.float32) for i in range(160)}
    x |= {200 + i: x[i * 7] for i in range(20)} | {300 + i: x[0] * np.float32(2) for i in range(7)}  # equal directions tie
    rows = [(i, v.tolist(), "a", 1) for i, v in x.items()] + [(0, x[0].tolist(), "b", 2)] * 8 + [(3, x[3].tolist(), "c", 3)] * 9
    rows += [(5000, None, "a", 1), (5050, [0.0] * 8, "a", 1), (5100, [float("nan")] * 8, "a", 1), (5150, [None] + [1.0] * 7, "a", 1), (5200, [1.0, 2.0], "a", 1), (5250, [float("inf")] * 8, "a", 1), (None, [1.0] * 8, "a", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string, rank int").repartition(3)
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute_nearest({i: v.astype(np.float64) for i, v in x.items()}, [i for i in x if i % 50 == 0])
    assert got.keys() == want.keys()
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-14) and [i for i, _ in got[q]] == [i for i, _ in want[q]]
    few = ann.nearest(df.where("vec_id < 3"), df.where("vec_id = 0")).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_through_the_forest(spark, monkeypatch):
    """Recall where blocks hold far more rows than a query's candidates: fails if the forest gives all rows, or too few."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(8000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = ann.Forest(x[:4000])
    shares = [len(at) / 4000 for at in forest.candidates(x[:40], int(ann.SHARE * 4000))]
    assert 0.3 < np.mean(shares) < 0.75 and max(shares) < 0.9
    monkeypatch.setattr(ann, "ROWS", 4000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    scores = x[::50] @ x.T
    scores[np.arange(160), np.arange(0, 8000, 50)] = -9
    hits = sum(len(got[50 * j] & set(np.argsort(-scores[j])[:5].tolist())) for j in range(160))
    assert all(len(v) == 5 for v in got.values()) and 0.9 <= hits / 800


def test_near_stage_recall(spark):
    """Copies at a similarity of 0.8 to 0.95 go, others stay."""
    import corpus_pipeline

    rng = random.Random(8)
    rows, near = [], set()
    for i in range(60):
        words = data.sentence(rng, 400).split()
        copy = list(words)
        for at in rng.sample(range(0, 400, 10), (2, 4, 8, 14)[i % 4]):
            copy[at] = "other"
        sets = [{tuple(w[j : j + 5]) for j in range(396)} for w in (words, copy)]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            near.add(1000 + i)
        rows += [(i, " ".join(words)), (1000 + i, " ".join(copy))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.near_stage(spark, df, "").collect()}
    assert 30 <= len(near) < 60 and got == {i for i, _ in rows} - near


def test_near_stage_hashes_balls(spark):
    """Fingerprints within 3 bits, and chains of them, share a key whatever the bands say; others don't."""
    from vexel.llm import jaccard

    rng = random.Random(10)
    fps, family = [], []
    for k in range(20):
        fp = rng.getrandbits(64)
        for step in range(3):
            fps.append(fp - (1 << 64) if fp >> 63 else fp)
            family.append(k)
            for bit in rng.sample(range(64), 1 + (k + step) % 3):
                fp ^= 1 << bit
    rows = [((i, -i), fp) for i, fp in enumerate(fps)]
    got = {r["node"]["k1"]: r["key"] for r in jaccard.balls(spark.createDataFrame(rows, f"node {jaccard.NODE}, fp bigint")).collect()}
    assert len(got) == 60 and len(set(got.values())) == 20 and len({(family[i], key) for i, key in got.items()}) == 20
    words = data.sentence(rng, 3000).split()
    texts = [" ".join(words), " ".join([*words, "more"]), data.sentence(rng, 300)]
    df = spark.createDataFrame([((i, i), t) for i, t in enumerate(texts)], f"node {jaccard.NODE}, text string")
    signatures = common.stored(jaccard.signed(df, 5))
    keys = {r["node"]["k1"]: r["key"] for r in jaccard.balls(signatures).collect()}
    assert keys[0] == keys[1] != keys[2]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(1)
    texts = ["\n".join(data.sentence(rng, 20) for _ in range(4)) for _ in range(60)]
    rows = [(i, texts[i % 60], "xx", "ab"[i % 2], len(texts[i % 60])) for i in range(120)]
    rows += [(200 + i, " ".join(w + "###" for w in texts[i].split()), "xx", "a", 9) for i in range(30)]
    rows += [(300, None, None, None, None), (301, "", "xx", "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200), 0) for i in [*range(0, 60), *range(200, 215)]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, str(tmp_path)))
        seen[name] = [r.asDict() for r in docs.collect()]
        assert name == "encode" or docs.columns == columns
    ids = {r["doc_id"] for r in seen["quality"]}
    assert ids >= set(range(120)) and not ids & set(range(200, 230))
    by_id = {r["doc_id"]: r for r in seen["lines"]}
    assert all(by_id[i]["text"] == texts[i] and by_id[i + 60]["text"] == "" and by_id[i + 60]["n_chars"] == 0 for i in range(60))
    assert set(range(60)) <= {r["doc_id"] for r in seen["near"]} and len([r for r in seen["near"] if not r["text"]]) == 1
    assert len(seen["mix"]) == len(seen["encode"]) > 0
    assert {hashlib.sha256(b"").hexdigest()} >= {r["ids_sha256"] for r in seen["encode"] if r["n_tokens"] == 0}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["encode"])
