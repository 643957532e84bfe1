"""Language ID with a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter keeps its maximum over the
window, and a softmax layer gives language probabilities; trained with numpy on labelled text. For prediction the
embedding and the filters are folded into two tables over byte pairs, so that a window costs two gathers a byte. A text is
cut into windows over its whole length; its probabilities are the means over its windows, by their bytes.

Training takes a bounded sample of labelled rows: about ``PER_LANGUAGE`` texts of each language, chosen by a hash of text
and doc_id, and ``WINDOWS`` pieces of each, of ``WINDOW`` characters. All else covers every byte.

Defined cases: a null text, or one without a letter, gives ``und`` and score 0; without labelled rows every text gives
``und``; null langs are never learned from; repeated rows get equal results; of equally probable languages the first by name
is taken; a very long text counts by all of its windows, some at a time; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import column_buffers, text_chunks

#: Bounds of the training sample: texts of each language, and pieces of each text.
PER_LANGUAGE = 600
WINDOWS = 6
#: Bytes of a window, and widths and numbers of the filters.
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
#: Windows that are computed together.
TOGETHER = 1024
PAD = 256


@dataclass
class Network:
    languages: list[str]
    first: object  # table over pairs of bytes at positions p, p+1: all filters on end
    second: object  # the same for p+2, p+3
    bias: object
    weights: object
    offset: object

    def probabilities(self, windows):
        """Softmax output for windows (n, WINDOW) of bytes, PAD behind the text's end."""
        import numpy as np

        out = np.empty((len(windows), len(self.languages)), np.float32)
        for i in range(0, len(windows), TOGETHER):
            x = windows[i : i + TOGETHER].T.astype(np.int32)
            x = np.concatenate([x, np.full((3, x.shape[1]), PAD, np.int32)])
            pair = x[:-1] * 257 + x[1:]
            best = np.full((x.shape[1], len(self.bias)), -np.inf, np.float32)
            a, b = np.empty_like(best), np.empty_like(best)
            for p in range(WINDOW):
                np.take(self.first, pair[p], axis=0, out=a)
                np.take(self.second, pair[p + 2], axis=0, out=b)
                a += b
                np.maximum(best, a, out=best)
            logits = np.maximum(best + self.bias, 0) @ self.weights + self.offset
            e = np.exp(logits - logits.max(1, keepdims=True))
            out[i : i + TOGETHER] = e / e.sum(1, keepdims=True)
        return out


def train(texts: list[bytes], langs: list[str], steps: int = 400, batch: int = 48, seed: int = 7) -> tuple[dict, list[str]]:
    """Parameters and languages; Adam on the cross entropy of windows, whose gradients flow through the maxima's positions."""
    import numpy as np

    rng = np.random.default_rng(seed)
    languages = sorted(set(langs))
    widest = max(WIDTHS)
    rows, ys = [], []
    for text, lang in zip(texts, langs):
        raw = np.frombuffer(text, np.uint8)
        # whole windows, and now and then a short one, as texts can be short
        size = WINDOW if rng.random() < 0.6 else int(rng.integers(8, WINDOW))
        at = int(rng.integers(0, max(1, len(raw) - size + 1)))
        row = np.full(WINDOW + widest - 1, PAD, np.int32)
        part = raw[at : at + size]
        row[: len(part)] = part
        rows.append(row)
        ys.append(languages.index(lang))
    x, y = np.array(rows), np.array(ys)
    classes, f = len(languages), FILTERS
    par = {"e": rng.normal(0, 0.5, (257, EMBEDDING)), "b": np.zeros(f * len(WIDTHS)), "w": rng.normal(0, 0.2, (f * len(WIDTHS), classes)), "o": np.zeros(classes)}
    par |= {f"k{w}": rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, f)) for w in WIDTHS}
    par = {k: v.astype(np.float32) for k, v in par.items()}
    par["e"][PAD] = 0
    m, v = ({k: np.zeros_like(p) for k, p in par.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), batch)
        xb, yb = x[pick], y[pick]
        emb = par["e"][xb]
        best, where, patches = [], [], {}
        for w in WIDTHS:
            win = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1)[:, :WINDOW].transpose(0, 1, 3, 2)
            patches[w] = win
            conv = win.reshape(batch * WINDOW, w * EMBEDDING) @ par[f"k{w}"]
            conv = conv.reshape(batch, WINDOW, f)
            arg = conv.argmax(1)
            where.append(arg)
            best.append(np.take_along_axis(conv, arg[:, None, :], 1)[:, 0])
        pooled = np.concatenate(best, 1) + par["b"]
        act = np.maximum(pooled, 0)
        logits = act @ par["w"] + par["o"]
        prob = np.exp(logits - logits.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(batch), yb] -= 1
        prob /= batch
        grad = {"w": act.T @ prob + 1e-4 * par["w"], "o": prob.sum(0), "e": np.zeros_like(par["e"])}
        back = (prob @ par["w"].T) * (pooled > 0)
        grad["b"] = back.sum(0)
        for j, w in enumerate(WIDTHS):
            g = back[:, j * f : (j + 1) * f]
            at = where[j]
            taken = patches[w][np.arange(batch)[:, None], at].reshape(batch, f, w * EMBEDDING)
            grad[f"k{w}"] = np.einsum("bfd,bf->df", taken, g)
            to_e = np.einsum("bf,df->bfd", g, par[f"k{w}"]).reshape(batch, f, w, EMBEDDING)
            symbols = xb[np.arange(batch)[:, None, None], at[:, :, None] + np.arange(w)]
            np.add.at(grad["e"], symbols.ravel(), to_e.reshape(-1, EMBEDDING))
        grad["e"][PAD] = 0
        rate = 0.01 * (1 - step / (steps + 1))
        for k in par:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            par[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return par, languages


def fold(par: dict, languages: list[str]) -> Network:
    import numpy as np

    f = FILTERS
    single = np.zeros((4, 257, f * len(WIDTHS)), np.float32)
    for j, w in enumerate(WIDTHS):
        kernel = par[f"k{w}"].reshape(w, EMBEDDING, f)
        for k in range(w):
            single[k, :, j * f : (j + 1) * f] = par["e"] @ kernel[k]
    pair = [(single[k][:, None, :] + single[k + 1][None, :, :]).reshape(257 * 257, -1) for k in (0, 2)]
    return Network(languages, *pair, par["b"], par["w"], par["o"])


def predict_batch(net: Network, batch: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, lang_pred, score of a batch with doc_id, text, letters (whether the text has one)."""
    import numpy as np

    raw, offsets = column_buffers(batch.column("text"))
    letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
    lengths = np.diff(offsets) * letters
    counts = -(-lengths // WINDOW)
    doc = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts, ends = offsets[doc] + within * WINDOW, offsets[doc] + lengths[doc]
    padded = np.append(raw, np.zeros(WINDOW, np.uint8))
    total = np.zeros((len(counts), len(net.languages)), np.float64)
    step = 8 * TOGETHER
    for i in range(0, len(doc), step):
        s, e = starts[i : i + step], ends[i : i + step]
        at = s[:, None] + np.arange(WINDOW)
        windows = np.where(at < e[:, None], padded[np.minimum(at, len(padded) - 1)], PAD)
        np.add.at(total, doc[i : i + step], net.probabilities(windows) * np.minimum(e - s, WINDOW)[:, None])
    share = total / np.maximum(lengths, 1)[:, None]
    best = share.argmax(1) if len(net.languages) else np.zeros(len(counts), int)
    known = lengths > 0
    names = np.array([*net.languages, "und"], object)[np.where(known, best, len(net.languages))]
    score = np.where(known, np.clip(share.max(1), 0, 1), 0.0)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])


def sample(labelled: DataFrame) -> list:
    """Pieces (piece, lang) of about PER_LANGUAGE texts of each language of labelled (doc_id, text, lang), cut where the texts lie.

    WINDOWS pieces of WINDOW characters a text, at places by hash; the driver gets no more than these.
    """
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # one row per class of the network, which holds them all anyway
    rows = labelled.join(F.broadcast(counts), "lang")
    place = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    last = F.greatest(F.lit(1), F.char_length("text") - WINDOW + 1)
    starts = (F.pmod(F.xxhash64("text", "doc_id", F.lit(i)), last).cast("int") + 1 for i in range(WINDOWS))
    pieces = F.explode(F.array(*(F.substring(F.col("text"), at, F.lit(WINDOW)) for at in starts)))
    return sorted(rows.where(place < F.lit(float(PER_LANGUAGE)) / F.col("n")).select(pieces.alias("piece"), "lang").collect())


def learn(labelled: DataFrame) -> tuple[dict, list[str]] | None:
    rows = [(r[0].encode(), r[1]) for r in sample(labelled) if r[0]]
    return train([t for t, _ in rows], [x for _, x in rows]) if rows else None


def predict(docs: DataFrame, learned: tuple[dict, list[str]] | None) -> DataFrame:
    """doc_id, lang_pred, score: one row per row of docs; only the text is looked at."""
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), has_letter.alias("letters"))
    if learned is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = fold(*learned)  # parameters are a few KB; their tables some 20 MB
        for batch in text_chunks(batches):
            yield predict_batch(net, batch)

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Learns from rows with a lang that aren't held out, never from others."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    return predict(docs, learn(labelled)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
