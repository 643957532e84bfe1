"""Odd documents that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kind string, size long, `__weight` double, fp long, word string, key string"


def sentence(rng: random.Random, words: int, letters: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(words))


def rows(seed: int = 1, n: int = 60):
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(5, 60)) for _ in range(n // 2)]
    shared = "\n".join(sentence(rng, 12) for _ in range(3))
    out = []
    for i in range(n):
        kind = i % 6
        text = rng.choice(texts)
        if kind == 1:
            text = sentence(rng, 8) + "\n" + shared + "\n" + sentence(rng, 9)
        elif kind == 2:
            text = text.replace(" ", "  ").upper()
        elif kind == 3:
            text = text + " tail"
        out.append((i, text, rng.choice(["xx", "yy", None]), rng.choice(["a", "b", None]), len(text)))
    long = sentence(rng, 30_000)
    out += [(100, None, None, None, None), (101, "", "xx", "a", 0), (102, " \t\n\r\x0b\x0c", "xx", "b", 6), (103, long, "xx", "a", len(long)), (104, long, "yy", "c", len(long))]
    out += [(105, "ß Ünïcode 漢字 🙂 é", "yy", None, 9), (106, "!!! ... 123", "yy", "b", 11), (107, "x", "xx", "a", 1), (None, "no id here at all", "xx", "a", 4), (108, "a" * 5000, "xx", "zz", 5000)]
    out += [out[3], out[3], (5, "another text under an id that is taken", "xx", "a", 3)]
    return [(*r, "k", 7, 0.5, 9, "w", "c") for r in out]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
