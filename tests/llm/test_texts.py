"""Exact dedup, SimHash, suffix dedup, BPE and language ID against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tests.llm import data
from vexel.llm import bpe, exact, graph, langid, simhash, suffix

LAST = (1 << 63) - 1


def test_exact(spark):
    rows = data.rows()
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append((-len(r[1] or ""), LAST if r[0] is None else r[0]))
    want = []
    for r in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        keep = min(groups[body])[1]
        keep = None if keep == LAST else keep
        want.append((r[0], keep, len(groups[body]), r[0] == keep, hashlib.sha256(body.encode()).hexdigest()))
    got = [tuple(r) for r in exact.exact_groups(data.frame(spark)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exact.exact_groups(data.empty(spark)).count() == 0


def test_trie_spills_by_subtree(monkeypatch):
    rng = random.Random(3)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(400)]
    trie, out = exact.PatriciaTrie(), []
    for i, k in enumerate(keys):
        trie.insert(k, len(k), i)
        if trie.bytes > 20_000:
            out += list(trie.pop_largest())
    out += list(trie.terminals())
    want = defaultdict(lambda: [LAST, 0])
    for i, k in enumerate(keys):
        want[k][0], want[k][1] = min(want[k][0], i), want[k][1] + 1
    got = defaultdict(lambda: [LAST, 0])
    for k, (_, i, n) in out:
        got[k][0], got[k][1] = min(got[k][0], i), got[k][1] + n
    assert got == want and len(out) > len(want)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def test_simhash(spark):
    rows = data.rows()
    fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
    roots = brute_components({f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], LAST), i)
    want = [(i, f"{f:016x}", least.get(roots[f])) for i, f in fps]
    got = [tuple(r) for r in simhash.near_groups(data.frame(spark)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_groups(data.empty(spark)).count() == 0


def test_ball_hashing_loses_no_link(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(6):
            fps.add(f)
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
    fps |= {0, 7, (1 << 64) - 1}
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))]
    got = {r["fp"] % (1 << 64): r["component_id"] for r in simhash.components(spark.createDataFrame(signed, "doc_id long, fp long")).collect()}
    roots = brute_components(fps)
    least = {}
    for i, f in enumerate(sorted(fps)):
        least[roots[f]] = min(least.get(roots[f], LAST), i)
    assert got == {f: least[roots[f]] for f in fps}


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0




def test_suffix(spark):
    rng = random.Random(8)
    passages = [data.sentence(rng, 40) for _ in range(4)]
    texts = []
    for _ in range(40):
        parts = [data.sentence(rng, rng.randint(0, 12)) for _ in range(3)]
        parts.insert(1, rng.choice(passages)[: rng.randint(60, 200)])
        parts.insert(3, rng.choice(passages)[rng.randint(0, 50) :])
        texts.append("é".join(parts))
    texts += ["ab" * 300, "x" * 99, "x" * 100, "x" * 101, "x" * 250, "", None, passages[0] + passages[0]]
    rows = [(i, t) for i, t in enumerate(texts)]
    want, seen = [], set()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in suffix.removal_digests(df).collect()) == want


def test_suffix_buckets_by_size(spark, tmp_path, monkeypatch):
    """A larger table has more buckets of triggers, none of which grows with it, and the same passages go."""
    data.frame(spark).repartition(5).write.parquet(str(tmp_path / "docs"))
    docs, used, parse = spark.read.parquet(str(tmp_path / "docs")), [], suffix.parse
    monkeypatch.setattr(suffix, "parse", lambda buckets: used.append(buckets) or parse(buckets))
    few = sorted(map(str, suffix.removal_digests(docs).collect()))
    monkeypatch.setattr("vexel.llm.common.SPREAD_BYTES", 10_000)
    assert sorted(map(str, suffix.removal_digests(docs).collect())) == few
    assert used[1] > 2 * used[0] > 0


def test_suffix_takes_odd_rows(spark):
    got = suffix.removal_digests(data.frame(spark)).collect()
    assert len(got) == len(data.rows())
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[103]["n_removed"] == 0 and by_id[104]["n_removed"] == by_id[104]["n_bytes"] > 100_000
    assert 4900 <= by_id[108]["n_removed"] <= 5000
    assert suffix.removal_digests(data.empty(spark)).count() == 0


def test_suffix_blocks(monkeypatch):
    """Windows cut into blocks give the same phrases' windows."""
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 99, 5000).astype(np.uint8)
    offsets = np.array([0, 1200, 1250, 5000])
    whole = suffix.Parser().phrases(raw, offsets)
    monkeypatch.setattr(suffix, "BLOCK", 512)
    cut = suffix.Parser().phrases(raw, offsets)

    def windows(p):
        lo, count, trigger, gram, _ = p
        return {(i, int(t), int(g)) for a, c, t, g in zip(lo, count, trigger, gram) for i in range(a, a + c)}

    assert windows(whole) == windows(cut) and len(windows(whole)) == 1101 + 3651


def test_bpe_as_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        content = f.read()
    rng = random.Random(4)
    alphabet = list("aaabbc thein'sdre ll'm 123 ½²Ⅷ \x1c\x85 \n\tÀé́Σςİıß漢字한글🙂_-!?.<|>٠") + ["<|endoftext|>", "<|startoftext|>", "<|endof"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(2000)] + ["aaaaaaa aaaa", "", None]
    texts += [r[1] for r in data.rows()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    full = {r["doc_id"]: r for r in bpe.encode(df, content).collect()}
    digests = {r["doc_id"]: r for r in bpe.encode_digests(df, content).collect()}
    assert len(full) == len(texts)
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert (full[i]["ids"], full[i]["decoded"]) == (ids, decoded), t
        raw = np.array(ids, "<u4").tobytes()
        assert tuple(digests[i])[1:] == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert bpe.encode_digests(data.empty(spark), content).count() == 0
    # pieces of a long text make the same tokens
    memory = bpe.Memory(bpe.PairIndexBPE(content))
    for t in [t or "" for t in texts[:300]] + ["  ".join(t or "" for t in texts[:200])]:
        whole = bpe.Digest()
        for _, ids, part in bpe.encode_texts(memory, [t], 25):
            whole.add(ids, part)
        ids = lib.encode(t, add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert whole.row() == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_language(spark):
    rng = random.Random(6)
    rows = [(i, data.sentence(rng, rng.randint(4, 80), letters), lang) for i in range(150) for lang, letters in (("aa", "abcdefg"), ("bb", "mnopqrs"), ("cc", "áéíóúabm"))]
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(rows)]
    rows += [(9001, None, "aa"), (9002, "12 34 !!", "bb"), (9003, "", "aa"), (9004, "abc " * 50_000, None), (None, "mnop qrs", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["lang_pred"] for i in (9001, 9002, 9003)] == ["und"] * 3 and by_id[9004]["lang_pred"] == "aa"
    truth = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 9000}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert 50 < len(held) < 150 and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95
    assert langid.identify(data.empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.identify(nothing).first()["lang_pred"] == "und"
    assert langid.identify(data.frame(spark)).count() == len(data.rows())
