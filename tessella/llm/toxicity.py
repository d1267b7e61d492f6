"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as a learned vector (words seen in enough documents) beside the mean of
its character trigrams' vectors. Two gated recurrent layers read a window of words, one
from either end; attention weighs their states into one vector, and a logistic unit gives
the window's score. A text's score is the highest of its overlapping windows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, with_workers

#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 32, 16
#: Sizes: word vector, trigram vector, states of each direction, attention.
WORD, CHAR, STATE, ATTEND = 8, 8, 8, 8
TRIGRAMS = 1 << 13
#: Learning is from so many documents of each label at most, each with one excerpt of so
#: many characters at most, from a place that a hash chooses; scoring reads whole texts.
SAMPLE, EXCERPT = 1200, 20_000
EPOCHS, RATE, BATCH, SEED = 18, 0.01, 256, 5
#: RATE falls evenly, epoch by epoch, to nearly this share of it.
LAST = 0.05
#: Small samples take smaller batches, and more epochs till they have made so many steps.
STEPS = 400
#: The first epochs take windows by their words; then the network chooses, every few epochs.
FIRST, AGAIN = 4, 4
#: A word has a vector of its own if so many sampled documents have it.
SEEN = 3
#: So many negatives also give a window of one of their words only, as junk texts have;
#: and one window in a hundred is empty and negative.
REPEATED = 0.3
#: Share of a batch's words that lose their own vectors while learning, so that single
#: documents are not learned by their rare words and trigrams carry what they can.
DROPPED = 0.5
THRESHOLD = 0.3
#: Windows scored at a time: keeps a step's arrays in cache.
CHUNK = 2048

words_of = re.compile(r"[^\W\d_]+").findall


def windows(n: int) -> list[int]:
    """Starts of overlapping windows that cover n words; the last ends with the text."""
    if n <= WINDOW:
        return [0]
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all words' UTF-8 with edge marks, and where each word's begin."""
    raw = [b"^" + w.encode() + b"$" for w in words]
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    ends = np.cumsum([len(x) for x in raw])
    keep = np.ones(len(flat), bool)
    keep[ends - 1] = keep[ends - 2] = False  # a trigram would cross into the next word
    ids = np.zeros(len(flat), np.uint32)
    ids[:-2] = (flat[:-2] * np.uint32(0x9E3779B1)) ^ (flat[1:-1] * np.uint32(0x85EBCA77)) ^ (flat[2:] * np.uint32(0xC2B2AE3D))
    ids = (ids ^ (ids >> np.uint32(15))) % np.uint32(TRIGRAMS)
    counts = np.array([len(x) - 2 for x in raw])
    return ids[keep].astype(np.int64), np.cumsum(counts) - counts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters, scores and gradients; ``constant`` is set where there was nothing to learn."""

    def __init__(self, vocabulary: dict[str, int], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        small = lambda *shape: (0.1 * rng.standard_normal(shape)).astype(np.float32)
        self.vocabulary, self.constant = vocabulary, None
        self.p = {"word": small(len(vocabulary) + 1, WORD), "char": small(TRIGRAMS, CHAR), "v": draw(ATTEND), "A": draw(2 * STATE, ATTEND), "out": draw(2 * STATE), "bias": np.full(1, -2, np.float32)}  # texts are seldom toxic
        self.p["word"][0] = 0  # words without a vector of their own
        for d in "fb":
            self.p |= {f"W{d}": draw(WORD + CHAR, 3 * STATE), f"U{d}": draw(STATE, 3 * STATE), f"c{d}": np.zeros(3 * STATE, np.float32)}

    def vectors(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of distinct words, and what they came from. Row 0 is padding."""
        own = np.array([0, *(self.vocabulary.get(w, 0) for w in words)], np.int64)
        x = np.zeros((len(words) + 1, WORD + CHAR), np.float32)
        x[:, :WORD] = self.p["word"][own]
        if not words:
            return x, own, np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, at = trigrams(words)
        sizes = np.diff(np.append(at, len(ids)))
        x[1:, WORD:] = np.add.reduceat(self.p["char"][ids], at, axis=0) / sizes[:, None]
        return x, own, ids, sizes

    def _run(self, d: str, gates: np.ndarray, index: np.ndarray, mask: np.ndarray | None, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction, (steps, windows, STATE)."""
        n, steps = index.shape
        h, u = np.zeros((n, STATE), np.float32), self.p[f"U{d}"]
        states, trail = np.empty((steps, n, STATE), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, b = gates[index[:, t]], h @ u
            zr = sigmoid(a[:, : 2 * STATE] + b[:, : 2 * STATE])
            z, r = zr[:, :STATE], zr[:, STATE:]
            c = np.tanh(a[:, 2 * STATE :] + r * b[:, 2 * STATE :])
            new = c + z * (h - c)
            if mask is not None:
                new = new * mask[:, t, None]
            if keep:
                trail.append((t, h, z, r, c, b[:, 2 * STATE :]))
            h = new
            states[t] = h
        return states, trail

    def forward(self, x: np.ndarray, index: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Probability for each window; ``index``: rows of ``x``, 0 where a text has ended."""
        mask = None if index.all() else (index > 0).astype(np.float32)
        f, b = (self._run(d, x @ self.p[f"W{d}"] + self.p[f"c{d}"], index, mask, keep) for d in "fb")
        h = np.concatenate((f[0], b[0]), axis=2)
        k = np.tanh(h @ self.p["A"])
        s = k @ self.p["v"]
        if mask is not None:
            s = np.where(mask.T > 0, s, -1e9)
        a = np.exp(s - s.max(axis=0))
        if mask is not None:
            a *= mask.T
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", a, h)
        return sigmoid(pooled @ self.p["out"] + self.p["bias"]), (f, b, h, k, a, pooled, mask)

    def gradients(self, x: np.ndarray, index: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean log loss: by parameter, and by row of ``x``."""
        p, (f, b, h, k, a, pooled, mask) = self.forward(x, index, keep=True)
        n = len(y)
        top = ((p - y) / n).astype(np.float32)
        g = {"out": pooled.T @ top, "bias": top.sum(keepdims=True)}
        d_pooled = top[:, None] * self.p["out"]
        d_a = np.einsum("nh,tnh->tn", d_pooled, h)
        d_s = a * (d_a - (a * d_a).sum(axis=0))
        g["v"] = np.einsum("tn,tna->a", d_s, k)
        d_k = d_s[:, :, None] * self.p["v"] * (1 - k * k)
        g["A"] = np.einsum("tnh,tna->ha", h, d_k)
        d_h = a[:, :, None] * d_pooled + d_k @ self.p["A"].T
        d_x = np.zeros_like(x)
        for d, (_, trail), own in (("f", f, d_h[:, :, :STATE]), ("b", b, d_h[:, :, STATE:])):
            u, d_gates, d_u, carry = self.p[f"U{d}"], np.zeros((len(x), 3 * STATE), np.float32), np.zeros_like(self.p[f"U{d}"]), np.zeros((n, STATE), np.float32)
            for t, before, z, r, c, hc in reversed(trail):
                e = own[t] + carry
                if mask is not None:
                    e = e * mask[:, t, None]
                d_c = e * (1 - z) * (1 - c * c)
                d_z = e * (before - c) * z * (1 - z)
                d_r = d_c * hc * r * (1 - r)
                d_in = np.concatenate((d_z, d_r, d_c), axis=1)
                d_rec = np.concatenate((d_z, d_r, d_c * r), axis=1)
                d_u += before.T @ d_rec
                carry = e * z + d_rec @ u.T
                rows = index[:, t]
                for j in range(3 * STATE):
                    d_gates[:, j] += np.bincount(rows, d_in[:, j], len(x))
            d_gates[0] = 0
            g[f"U{d}"], g[f"W{d}"], g[f"c{d}"] = d_u, x.T @ d_gates, d_gates.sum(axis=0)
            d_x += d_gates @ self.p[f"W{d}"].T
        return g, d_x

    def window_scores(self, lists: list[list[str]]) -> list[np.ndarray]:
        """Scores of all overlapping windows of each list of words."""
        known: dict[str, int] = {}
        ids = [np.array([known.setdefault(w, len(known) + 1) for w in ws], np.int64) for ws in lists]
        x = self.vectors(list(known))[0]
        counts, index = [], []
        for doc in ids:
            starts = windows(len(doc))
            counts.append(len(starts))
            if len(doc) < WINDOW:
                index.append(np.concatenate((doc, np.zeros(WINDOW - len(doc), np.int64)))[None])
            else:
                index.append(np.lib.stride_tricks.sliding_window_view(doc, WINDOW)[starts])
        every = np.concatenate(index) if index else np.zeros((0, WINDOW), np.int64)
        whole = every[:, -1] > 0
        out = np.zeros(len(every), np.float32)
        for part in (np.flatnonzero(whole), np.flatnonzero(~whole)):
            for k in range(0, len(part), CHUNK):
                rows = part[k : k + CHUNK]
                out[rows] = self.forward(x, every[rows])[0]
        return np.split(out, np.cumsum(counts)[:-1]) if counts else []

    def score(self, texts: list[str | None]) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        return [float(s.max()) for s in self.window_scores([words_of((t or "").lower()) for t in texts])]


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Learn from documents: the window of a positive that counts is its best one.

    In the first epochs that is the window with the word most typical of positives, then
    the one that the network itself scores highest; negatives give their highest windows
    and random ones. Adam; everything is drawn from one seed.
    """
    rng = np.random.default_rng(seed)
    lists, y = [words_of(t.lower()) for t in texts], np.array(labels, np.float32)
    in_docs = Counter(w for ws in lists for w in set(ws))
    net = Network({w: i + 1 for i, w in enumerate(sorted(w for w, n in in_docs.items() if n >= SEEN))}, seed)
    if not len(y) or y.min() == y.max():
        net.constant = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0  # without labels nothing is toxic
        return net
    positive = Counter(w for ws, one in zip(lists, y, strict=True) if one for w in set(ws))
    odds = {w: np.log((positive[w] + 0.5) / (n - positive[w] + 0.5)) for w, n in in_docs.items()}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    size = min(BATCH, max(32, len(y) // 8))
    epochs = max(epochs, -(-STEPS * size // (2 * len(y))))
    for epoch in range(epochs):
        rate = RATE * (1 - (1 - LAST) * epoch / epochs)
        if epoch < FIRST:
            best = [np.array([max((odds[w] for w in ws[s : s + WINDOW]), default=0.0) for s in windows(len(ws))]) for ws in lists]
        elif (epoch - FIRST) % AGAIN == 0:
            best = net.window_scores(lists)
        chosen: list[tuple[list[str], float]] = []
        for ws, one, b in zip(lists, y, best, strict=True):
            starts = windows(len(ws))
            picks = {int(b.argmax())} if one else {int(b.argmax()), int(rng.integers(len(starts)))}
            chosen += [(ws[starts[k] : starts[k] + WINDOW], float(one)) for k in picks]
            if not one and ws and rng.random() < REPEATED:
                chosen.append(([ws[int(rng.integers(len(ws)))]] * WINDOW, 0.0))
        chosen += [([], 0.0)] * (1 + len(chosen) // 100)
        order = rng.permutation(len(chosen))
        for k in range(0, len(order), size):
            batch = [chosen[i] for i in order[k : k + size]]
            known: dict[str, int] = {}
            index = np.zeros((len(batch), WINDOW), np.int64)
            for i, (ws, _) in enumerate(batch):
                index[i, : len(ws)] = [known.setdefault(w, len(known) + 1) for w in ws]
            x, own, ids, sizes = net.vectors(list(known))
            gone = rng.random(len(own)) < DROPPED
            own[gone], x[gone, :WORD] = 0, 0
            g, d_x = net.gradients(x, index, np.array([one for _, one in batch], np.float32))
            g["word"] = np.zeros_like(net.p["word"])
            g["word"][own[1:]] += d_x[1:, :WORD]  # distinct words: each row of its own, but for row 0
            g["word"][0] = 0
            spread = np.repeat(d_x[1:, WORD:] / sizes[:, None], sizes, axis=0) if len(sizes) else np.zeros((0, CHAR), np.float32)
            g["char"] = np.stack([np.bincount(ids, spread[:, j], TRIGRAMS) for j in range(CHAR)], axis=1)
            step += 1
            for name, grad in g.items():
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                net.p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, excerpt: int = EXCERPT) -> Network:
    """Train on a bounded sample: of each label up to ``sample`` documents, dealt by a hash of the id.

    Labelled documents of any length are drawn from; a longer text than ``excerpt`` gives so
    many of its characters. Ids alone are joined to ``labels`` and aggregated, which
    combines before its shuffle; the number of ids bounds the broadcast that fetches their
    excerpts. Of ids that several rows share the first excerpt in order is learned from.
    Rows without id or text are not learned from.
    """
    h, text = F.xxhash64("__id"), F.col(text_col)
    place = F.pmod(F.xxhash64("__text", F.lit("place")), F.greatest(F.lit(1), F.length("__text") - excerpt + 1)).cast("int") + 1
    given = docs.where(text.isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), text.alias("__text"))
    marked = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    picked = (
        marked.join(given.select("__id"), "__id", "left_semi")
        .groupBy("__y", F.pmod(h, F.lit(sample)).alias("__slot"))
        .agg(F.min_by("__id", F.struct(h, F.col("__id"))).alias("__id"))
        .select("__id", "__y")
    )
    drawn = given.join(F.broadcast(picked), "__id").select("__id", "__y", F.substring("__text", place, F.lit(excerpt)).alias("__text"))
    rows = drawn.groupBy("__id", "__y").agg(F.min("__text").alias("__text")).orderBy("__id", "__y").collect()
    return train([r["__text"] for r in rows], [r["__y"] for r in rows])


def toxicity(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """``<id>, [keep...,] score`` for each row: all overlapping windows of the whole text; narrow.

    Null, empty and wordless texts have no window and get the network's score of an empty
    one. Texts of any length go window by window in chunks; ties, repeated rows and null
    ids pass row by row, as do the columns of ``keep`` (if one of them is called ``score``,
    give another ``name``); an empty table gives an empty result. Without
    labelled rows of both kinds the score is the constant share of positives.
    """
    kept = list(dict.fromkeys([id_col, *keep]))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, scores, held, size = batch.column(0).to_pylist(), [], [], 0
            for text in texts:
                held.append(text)
                size += len(text or "")
                if size > 1 << 21:
                    scores += shared.value.score(held)
                    held, size = [], 0
            scores += shared.value.score(held)
            yield pa.record_batch([*batch.columns[1:], pa.array(scores, pa.float64())], names=[*kept, name])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, T.DoubleType())])
    return with_workers(docs).select(docs[text_col].cast("string").alias(free(kept, "text")[0]), *kept).mapInArrow(run, schema)
