"""Toxicity with a bidirectional gated recurrent network, trained and run in numpy.

A text's words (runs of bytes other than 0x20 and 0x09-0x0D; A-Z folded, ASCII
punctuation at the edges dropped) go through the network in overlapping windows. A
word's input is the embedding of the word, if it is in a lexicon of the words whose use
differs most between the labels, beside the mean embedding of its hashed byte 3-grams.
Attention pools the two directions' states to a window's logit; a text's score is its
largest window logit, calibrated on training rows left out of the fit, where 0.5 is the
threshold of the best accuracy. Windows of toxic texts carry no label of their own: the
one that the current network (at first, the lexicon) finds most toxic stands for a text.

Null and empty texts are one empty window. With labels of one kind only, that kind's
share is the score of every row.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashed
from .common import runs
from .textkit import U64, Words, hash_spans

WINDOW, STRIDE, HIDDEN = 32, 24, 8
LEXICON, WORD_DIM, CHAR_BITS, CHAR_DIM = 4096, 8, 12, 4
#: Bound of the sample, rows of each label (and hashed.TRAIN_BYTES of text); one in CALIBRATE of them calibrates.
TRAIN_ROWS, CALIBRATE = 1000, 4
ROUNDS, STEPS, BATCH, RATE = 2, 150, 128, 0.01
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True


def word_spans(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the words without punctuation at their edges (whole if all is punctuation)."""
    start, end = words.start.copy(), words.end.copy()
    solid = np.append(0, np.cumsum(~PUNCTUATION[words.data]))
    bare = solid[end] > solid[start]
    for _ in range(64):
        go = bare & PUNCTUATION[words.data[start]]
        if not go.any():
            break
        start[go] += 1
    for _ in range(64):
        go = bare & PUNCTUATION[words.data[end - 1]]
        if not go.any():
            break
        end[go] -= 1
    return start, end


class Batch:
    """Texts as numbered distinct words: their hashes and 3-grams, and the windows over them."""

    def __init__(self, texts: list[str | None]):
        words = Words(texts, lower=True)
        start, end = word_spans(words)
        value = hash_spans(words.data, start, end)
        self.hash, head, self.word = np.unique(value, return_index=True, return_inverse=True)
        start, end = start[head], end[head]
        n = np.maximum(end - start - 2, 1)
        at, stop = runs(start, n), np.repeat(end, n)
        gram = np.zeros(len(at), np.uint32)
        for i in range(3):  # a shorter word is filled up, whatever stands after it
            inside = at + i < stop
            gram = gram << np.uint32(8) | np.where(inside, words.data[np.where(inside, at + i, 0)], 0).astype(np.uint32) if len(at) else gram
        self.gram = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - CHAR_BITS)).astype(np.int64)
        self.gram_at = np.append(0, np.cumsum(n))[: len(self.hash) + 1]
        counts = words.counts
        self.windows = np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE))
        self.text = np.repeat(np.arange(len(counts)), self.windows)
        self.window_start = words.first[:-1][self.text] + STRIDE * runs(np.zeros(len(counts), np.int64), self.windows)
        self.window_size = np.clip(words.first[1:][self.text] - self.window_start, 0, WINDOW)

    def grid(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (time x windows; the one past the last where there is none) and lengths."""
        at = self.window_start[pick][None, :] + np.arange(WINDOW)[:, None]
        size = self.window_size[pick]
        real = np.arange(WINDOW)[:, None] < size[None, :]
        padded = np.append(self.word, 0)
        return np.where(real, padded[np.minimum(at, len(self.word))], len(self.hash)), size


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    lexicon: np.ndarray
    p: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None


def inputs(model: Model, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Lexicon row and input vector of each distinct word, and a zero vector at the end."""
    row = np.minimum(np.searchsorted(model.lexicon, batch.hash), len(model.lexicon) - 1)
    row = np.where(model.lexicon[row] == batch.hash, row + 1, 0)
    n = len(batch.hash)
    x = np.zeros((n + 1, WORD_DIM + CHAR_DIM), np.float32)
    if n:
        x[:n, :WORD_DIM] = model.p["word"][row]
        count = np.diff(batch.gram_at)
        x[:n, WORD_DIM:] = np.add.reduceat(model.p["char"][batch.gram], batch.gram_at[:-1], axis=0) / count[:, None]
    return row, x


def forward(model: Model, x: np.ndarray, grid: np.ndarray, size: np.ndarray, train: bool = False):
    """Window logits, and what backward() needs."""
    p, steps, n = model.p, grid.shape[0], grid.shape[1]
    states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
    tape = []
    for side in (0, 1):
        project = x @ p[f"w{side}"] + p[f"b{side}"]
        u, v = p[f"u{side}"], p[f"v{side}"]
        h = np.zeros((n, HIDDEN), np.float32)
        for t in range(steps) if not side else range(steps - 1, -1, -1):
            live = (t < size)[:, None]
            g = project[grid[t]]
            zr = 1 / (1 + np.exp(-(g[:, : 2 * HIDDEN] + h @ u)))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ v)
            new = np.where(live, h + z * (c - h), h)
            if train:
                tape.append((side, t, h, z, r, c, live))
            h = new
            states[t, :, side * HIDDEN : (side + 1) * HIDDEN] = h
    real = np.arange(steps)[:, None] < np.maximum(size, 1)[None, :]
    energy = np.where(real, states @ p["attend"], -1e9)
    weight = np.exp(energy - energy.max(0))
    weight /= weight.sum(0)
    pooled = (weight[:, :, None] * states).sum(0)
    return pooled @ p["out"] + p["bias"][0], (states, weight, pooled, tape)


def backward(model: Model, x: np.ndarray, grid: np.ndarray, pull: np.ndarray, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the parameters and of the input vectors, for d loss / d logit = pull."""
    states, weight, pooled, tape = kept
    p = model.p
    g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
    g["out"] += pooled.T @ pull
    g["bias"][0] = pull.sum()
    d_pool = pull[:, None] * p["out"][None]
    d_weight = (states * d_pool[None]).sum(2)
    d_energy = weight * (d_weight - (weight * d_weight).sum(0)[None])
    d_states = weight[:, :, None] * d_pool[None] + d_energy[:, :, None] * p["attend"]
    g["attend"] += np.tensordot(d_energy, states, ([0, 1], [0, 1]))
    dx = np.zeros_like(x)
    carry = [np.zeros_like(pooled[:, :HIDDEN]), np.zeros_like(pooled[:, :HIDDEN])]
    gates = [np.zeros((len(x), 3 * HIDDEN), np.float32) for _ in (0, 1)]
    for side, t, h, z, r, c, live in reversed(tape):
        dh = carry[side] + d_states[t, :, side * HIDDEN : (side + 1) * HIDDEN]
        on = np.where(live, dh, 0)
        da = on * z * (1 - c * c)
        d_rh = da @ p[f"v{side}"].T
        d_zr = np.concatenate([on * (c - h) * z * (1 - z), d_rh * h * r * (1 - r)], 1)
        g[f"v{side}"] += (r * h).T @ da
        g[f"u{side}"] += h.T @ d_zr
        np.add.at(gates[side], grid[t], np.concatenate([d_zr, da], 1))
        carry[side] = np.where(live, on * (1 - z) + d_rh * r + d_zr @ p[f"u{side}"].T, dh)
    for side in (0, 1):
        g[f"w{side}"] += x.T @ gates[side]
        g[f"b{side}"] += gates[side].sum(0)
        dx += gates[side] @ p[f"w{side}"].T
    return g, dx


def logits(model: Model, batch: Batch, step: int = 8192) -> np.ndarray:
    """The logit of every window."""
    _, x = inputs(model, batch)
    out = np.empty(len(batch.text), np.float32)
    for a in range(0, len(out), step):
        pick = np.arange(a, min(len(out), a + step))
        out[pick] = forward(model, x, *batch.grid(pick))[0]
    return out


def text_logits(model: Model, texts: list[str | None]) -> np.ndarray:
    batch = Batch(texts)
    at = np.append(0, np.cumsum(batch.windows))[:-1]
    return np.maximum.reduceat(logits(model, batch), at) if len(texts) else np.empty(0, np.float32)


def _lexicon(batch: Batch, owner: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words whose document frequencies differ most, in hash order, and their log odds."""
    pair = np.unique(owner * (len(batch.hash) + 1) + batch.word)
    text, word = pair // (len(batch.hash) + 1), pair % (len(batch.hash) + 1)
    pos = np.bincount(word[y[text] == 1], minlength=len(batch.hash))
    neg = np.bincount(word[y[text] == 0], minlength=len(batch.hash))
    a, b = (y == 1).sum(), (y == 0).sum()
    odds = np.log((pos + 0.5) / (a + 1)) - np.log((neg + 0.5) / (b + 1))
    both = pos + neg
    strength = np.where(both > 1, np.abs(odds) * np.sqrt(both), 0)
    top = np.sort(np.argsort(-strength, kind="stable")[:LEXICON])
    top = top[strength[top] > 0] if (strength[top] > 0).any() else top[:1]
    return batch.hash[top], (odds * both / (both + 2))[top]


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Learn from the rows of labels (doc_id, toxic) that docs (doc_id, text) has."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter("label in (0, 1)").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    share = dict(known.groupBy("label").count().collect())
    got = sorted(hashed.training_rows(docs, known, most).collect(), key=lambda r: (zlib.crc32(r[1].encode()), r[1], r[0]))
    y = np.array([r[0] for r in got], np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1, U64), {}, constant=float(share.get(1, 0) / max(1, sum(share.values()))))
    texts = [r[1] for r in got]
    aside = np.zeros(len(y), bool)
    for k in (0, 1):
        aside[np.flatnonzero(y == k)[::CALIBRATE]] = True
    if not (y[~aside] == 1).any() or not (y[~aside] == 0).any():
        aside[:] = False
    model = train([t for t, a in zip(texts, aside, strict=True) if not a], y[~aside])
    check = aside if aside.any() else ~aside
    z = text_logits(model, [t for t, a in zip(texts, check, strict=True) if a]).astype(float)
    truth = y[check] == 1
    weight = np.where(truth, share[1] / truth.sum(), share[0] / (~truth).sum())
    model.slope, model.offset = hashed.platt(z, truth, weight / weight.mean())
    model.slope = max(model.slope, 1e-3)
    cuts = np.unique(z)
    cuts = np.append((cuts[:-1] + cuts[1:]) / 2, [cuts[0] - 1, cuts[-1] + 1])
    right = [(weight * ((z >= c) == truth)).sum() for c in cuts]
    best = cuts[np.flatnonzero(np.isclose(right, max(right)))]
    model.offset = -model.slope * float(best[np.argmin(np.abs(best + model.offset / model.slope))])
    return model


def train(texts: list[str], y: np.ndarray) -> Model:
    rng = np.random.default_rng(5)
    batch = Batch(texts)
    words_of = np.repeat(np.arange(len(texts)), Words(texts).counts)
    lexicon, odds = _lexicon(batch, words_of, y)
    init = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
    p = {"word": init(len(lexicon) + 1, WORD_DIM) * np.float32(0.2), "char": init(1 << CHAR_BITS, CHAR_DIM) * np.float32(0.2), "attend": init(2 * HIDDEN), "out": init(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
    p["word"][1:, 0] = odds
    for side in (0, 1):
        p |= {f"w{side}": init(WORD_DIM + CHAR_DIM, 3 * HIDDEN), f"u{side}": init(HIDDEN, 2 * HIDDEN), f"v{side}": init(HIDDEN, HIDDEN), f"b{side}": np.zeros(3 * HIDDEN, np.float32)}
    model = Model(lexicon, p)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    row, _ = inputs(model, batch)
    seed = np.append(np.append(0.0, odds)[row], 0.0)
    grid, _ = batch.grid(np.arange(len(batch.text)))
    view = np.take(seed, grid).max(0)  # at first: the window with the most telling word
    del grid
    first = np.append(0, np.cumsum(batch.windows))[:-1]
    clean = np.flatnonzero(y[batch.text] == 0)
    count = 0
    for _ in range(ROUNDS):
        order = np.lexsort((-view, batch.text))
        toxic = order[first][y == 1]
        telling = clean[np.argsort(-view[clean], kind="stable")[: 2 * len(toxic)]]
        pool = np.concatenate([toxic, telling, rng.choice(clean, min(len(clean), 3 * len(toxic)), replace=False)])
        target = np.append(np.ones(len(toxic)), np.zeros(len(pool) - len(toxic))).astype(np.float32)
        for _ in range(max(1, STEPS * BATCH // len(pool))):
            mixed = rng.permutation(len(pool))
            for a in range(0, len(mixed), BATCH):
                pick = pool[mixed[a : a + BATCH]]
                t = target[mixed[a : a + BATCH]]
                grid, size = batch.grid(pick)
                used, small = np.unique(grid, return_inverse=True)
                grid = small.reshape(grid.shape)
                _, x = _some_inputs(model, batch, row, used)
                z, kept = forward(model, x, grid, size, train=True)
                g, dx = backward(model, x, grid, ((_sigmoid(z) - t) / len(t)).astype(np.float32), kept)
                g["word"], g["char"] = _input_gradients(model, batch, row, used, dx)
                count += 1
                for k, v in g.items():
                    m, s = moment[k]
                    m += 0.1 * (v - m)
                    s += 0.01 * (v * v - s)
                    p[k] -= (RATE * (m / (1 - 0.9**count)) / (np.sqrt(s / (1 - 0.99**count)) + 1e-6)).astype(np.float32)
        view = logits(model, batch)
    return model


def _grams(batch: Batch, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = batch.gram_at[used + 1] - batch.gram_at[used]
    return batch.gram[runs(batch.gram_at[used], n)], n


def _some_inputs(model: Model, batch: Batch, row: np.ndarray, used: np.ndarray) -> tuple[None, np.ndarray]:
    """inputs() of the used words alone; the number past the last stands for no word."""
    x = np.zeros((len(used), WORD_DIM + CHAR_DIM), np.float32)
    real = used[used < len(batch.hash)]
    if len(real):
        gram, n = _grams(batch, real)
        x[: len(real), :WORD_DIM] = model.p["word"][row[real]]
        x[: len(real), WORD_DIM:] = np.add.reduceat(model.p["char"][gram], np.append(0, np.cumsum(n))[:-1], axis=0) / n[:, None]
    return None, x


def _input_gradients(model: Model, batch: Batch, row: np.ndarray, used: np.ndarray, dx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word, char = np.zeros_like(model.p["word"]), np.zeros_like(model.p["char"])
    real = used[used < len(batch.hash)]
    if len(real):
        gram, n = _grams(batch, real)
        np.add.at(word, row[real], dx[: len(real), :WORD_DIM])
        np.add.at(char, gram, np.repeat(dx[: len(real), WORD_DIM:] / n[:, None], n, axis=0))
    return word, char


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, score and predicted (1 from a score of 0.5 on) of every row, over its whole text."""

    def work(texts: list[str | None], _: pa.RecordBatch) -> list:
        if model.constant is not None:
            s = np.full(len(texts), model.constant)
        else:
            s = _sigmoid(model.slope * text_logits(model, texts).astype(float) + model.offset)
        return [s, pa.array((s >= 0.5).astype(np.int32))]

    return hashed.per_row(docs, keep, "score double, predicted int", work)
