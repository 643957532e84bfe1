"""BPE encoding and decoding with a pair occurrence index.

The different words of a partition lie end to end in one array of symbols. An index maps every pair that has a rank to
all its positions; ranks are applied in ascending order, each to all its positions at once, and the lists of the pairs
that arise next to a merge are updated. Words are cut as the tokenizer's file says; documents are then put together
from their words' ids.

Defined cases: null text counts as empty and has no tokens; the file's added tokens are matched in the raw text; an empty
table gives an empty result; repeated rows give repeated rows; other columns are ignored. Very long texts are encoded in
pieces of about ``PIECE`` characters, cut after blanks, over which no token reaches; digests are taken piece by piece, so
only a single word must fit in memory. Equal words have equal tokens wherever they stand; there are no other ties.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from vexel.llm.common import doc_text, text_chunks

#: Bytes of words, ids and decoded words that a task remembers, about, before it starts anew.
REMEMBERED = 32 << 20
#: Bytes that a remembered word takes beside its letters, about: two strings, a number, places in lists.
WORD_BYTES = 240
#: Characters that are cut into words at once.
PIECE = 1 << 20
#: Lower-case letters from which a class of the standard library's re can be built; texts with others take the file's pattern.
PLAIN = "a-zß-öø-ʯ"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or else 256 and up in turn."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class PairIndexBPE:
    """Encoder for tokenizer files of kind BPE with word ends, made from the file's content."""

    def __init__(self, content: str) -> None:
        import numpy as np
        import regex

        spec = json.loads(content)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in added.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.cuts = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(self.cuts, regex.V0).findall
        # the same cuts for texts in plain letters: no letter, digit or blank in the class above differs between the modules
        fast = self.cuts.replace("[^\\s\\p{L}\\p{N}]", f"[^\\s{PLAIN}0-9]").replace("[\\p{L}]", f"[{PLAIN}]").replace("[\\p{N}]", "[0-9]")
        self.is_plain = re.compile(f"[\t\n\r -~{PLAIN}]*").fullmatch
        self.find_plain = re.compile(fast).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added = added
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        codes = self.left << 32 | self.right
        self.by_code = np.argsort(codes, kind="stable")
        self.codes = codes[self.by_code]

    def ranks(self, a, b):
        """Rank of each pair of symbols, -1 if it has none."""
        import numpy as np

        code = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.by_code[at], -1)

    def encode_words(self, words: list[str]) -> tuple:
        """(ids of all words on end, their offsets)."""
        import numpy as np

        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        n = len(flat)
        stops = np.cumsum(lengths)
        last = np.zeros(n, bool)
        last[stops[lengths > 0] - 1] = True
        # one more cell on end takes what falls off
        symbols = np.append(np.where(last, self.final[flat], self.inner[flat]), -1).astype(np.int32)
        after = np.append(np.where(last, n, np.arange(1, n + 1)), n)
        first = np.zeros(n, bool)
        first[(stops - lengths)[lengths > 0]] = True
        before = np.append(np.where(first, n, np.arange(-1, n - 1)), n)
        alive = np.append(np.ones(n, bool), False)

        where: dict[int, list] = {}
        active: list[int] = []

        def put(at) -> None:
            """Adds the pairs that start at these positions to the index."""
            at = at[(at < n) & (after[at] < n)] if len(at) else at
            if not len(at):
                return
            rank = self.ranks(symbols[at], symbols[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edges = np.flatnonzero(np.diff(rank)) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(rank)]):
                if i < j:
                    r = int(rank[i])
                    if r not in where:
                        where[r] = []
                        heapq.heappush(active, r)
                    where[r].append(at[i:j])

        put(np.arange(n))
        while active:
            r = heapq.heappop(active)
            lists = where.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            if len(at) > 1:
                at = np.unique(at)
            nxt = after[at]
            good = alive[at] & (symbols[at] == self.left[r]) & (symbols[nxt] == self.right[r])
            at, nxt = at[good], nxt[good]
            if self.left[r] == self.right[r] and len(at) > 1:
                # runs of one symbol merge from the left, two by two
                starts = np.append(True, nxt[:-1] != at[1:])
                run = np.flatnonzero(starts)[np.cumsum(starts) - 1]
                at = at[(np.arange(len(at)) - run) % 2 == 0]
                nxt = after[at]
            if not len(at):
                continue
            symbols[at] = self.made[r]
            alive[nxt] = False
            beyond = after[nxt]
            after[at] = beyond
            before[beyond] = at
            put(np.concatenate([at, before[at]]))
        kept = alive[:n]
        counts = np.concatenate([[0], np.cumsum(kept)])
        return symbols[:n][kept], counts[np.concatenate([[0], stops])]

    def words(self, text: str) -> list[str]:
        """The text's words in order; added tokens stand as words of their own."""
        if self.special is not None and "<" in text:
            parts = self.special.split(text)
            if len(parts) > 1:
                return list(chain.from_iterable([p] if i % 2 else self.plain(p) for i, p in enumerate(parts)))
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower() looks at the letters around this one
                text = text.replace("Σ", "σ")
        text = text.lower()
        return self.find_plain(text) if self.is_plain(text) else self.find(text)


class Numbers(dict):
    """Numbers words as they come; ``new`` lists those that came since it was emptied."""

    def __init__(self, known: list[str]) -> None:
        super().__init__((w, i) for i, w in enumerate(known))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Memory:
    """Words already encoded, for one task, bounded by their bytes."""

    def __init__(self, bpe: PairIndexBPE) -> None:
        import numpy as np

        self.bpe = bpe
        self.index = Numbers(list(bpe.added))
        self.decoded = list(bpe.added)
        self.ids = np.array(list(bpe.added.values()), np.int32)
        self.offsets = np.arange(len(bpe.added) + 1)
        self.bytes = 0

    def numbers(self, lists: list[list[str]]) -> list:
        """Number of each word; new words are encoded."""
        import numpy as np

        if self.bytes > REMEMBERED:
            self.__init__(self.bpe)
        number = self.index.__getitem__
        found = [list(map(number, words)) for words in lists]
        new = self.index.new
        if new:
            self.index.new = []
            ids, offsets = self.bpe.encode_words(new)
            names = self.bpe.names
            tokens = [names[i] for i in ids.tolist()]
            cuts = offsets.tolist()
            self.decoded += [" ".join(tokens[a:b]) for a, b in zip(cuts, cuts[1:])]
            self.offsets = np.concatenate([self.offsets, offsets[1:] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
            self.bytes += 2 * sum(map(len, new)) + len(new) * WORD_BYTES
        return found


def pieces(text: str, limit: int) -> Iterator[str]:
    """The text in pieces of about ``limit`` characters, cut after blanks."""
    at = 0
    while len(text) - at > limit:
        stop = text.find(" ", at + limit) + 1
        if not stop:
            break
        yield text[at:stop]
        at = stop
    yield text[at:] if at else text


def encode_texts(memory: Memory, texts: list[str], limit: int | None = None) -> Iterator[tuple]:
    """(number of the text, ids as a uint32 array, decoded) of each piece of each text, in order."""
    import numpy as np

    def encoded(part: list[tuple[int, str]]) -> Iterator[tuple]:
        numbers = memory.numbers([memory.bpe.words(t) for _, t in part])
        flat, offsets, decoded = memory.ids, memory.offsets, memory.decoded.__getitem__
        for (i, _), own in zip(part, numbers):
            w = np.array(own, np.int64)
            starts, sizes = offsets[w], offsets[w + 1] - offsets[w]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            at = np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
            yield i, flat[at].astype(np.uint32), " ".join(map(decoded, own))

    limit = limit or PIECE
    part: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        for piece in pieces(text, limit):
            part.append((i, piece))
            size += len(piece)
            if size >= limit:
                yield from encoded(part)
                part, size = [], 0
    if part:
        yield from encoded(part)


@functools.lru_cache(maxsize=1)
def encoder(content: str) -> PairIndexBPE:
    """The encoder of a tokenizer file, made once in a process."""
    return PairIndexBPE(content)


class Whole:
    """ids and decoded text of a document."""

    def __init__(self) -> None:
        self.ids: list = []
        self.texts: list[str] = []

    def add(self, ids, text: str) -> None:
        self.ids.append(ids.astype("int32"))
        if len(ids):
            self.texts.append(text)

    def row(self) -> tuple:
        import numpy as np

        return np.concatenate(self.ids), " ".join(self.texts)


class Digest:
    """Number of ids and digests of ids and decoded text of a document."""

    def __init__(self) -> None:
        self.n, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids, text: str) -> None:
        if len(ids):
            self.text.update(f" {text}".encode() if self.n else text.encode())
            self.ids.update(ids.astype("<u4").tobytes())
            self.n += len(ids)

    def row(self) -> tuple:
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


def _mapped(docs: DataFrame, content: str, schema: str, kind: type) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(encoder(content))
        for batch in text_chunks(batches, PIECE):
            rows = []
            for i, ids, text in encode_texts(memory, batch.column("text").to_pylist()):
                if i == len(rows):
                    rows.append(kind())
                rows[i].add(ids, text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in zip(*(r.row() for r in rows)))], names=["doc_id", *names])

    names = [c.split()[0] for c in schema.split(", ")]
    return doc_text(docs).mapInArrow(run, f"doc_id long, {schema}")


def encode(docs: DataFrame, content: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (string). content: the tokenizer file's text."""
    return _mapped(docs, content, "ids array<int>, decoded string", Whole)


def encode_digests(docs: DataFrame, content: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode() returns."""
    return _mapped(docs, content, "n_tokens long, ids_sha256 string, decoded_sha256 string", Digest)
