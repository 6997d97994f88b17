"""Quality: counting rules and a calibrated hashed n-gram classifier.

Words are runs of bytes other than 0x20 and 0x09-0x0D. A logistic regression over
hashed words and character 3- and 4-grams (A-Z kept apart from a-z) of the whole text is
fitted on labelled rows; its margin is calibrated on rows left out of the fit, weighed
to the labels' shares, and scored in Arrow batches against a fixed threshold.

A text fails the base rules with under 50 words or when over half of its words repeat in
three-word windows; null and empty texts have no words and fail. Without labels of both
kinds every text that passes the base rules is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashed
from .common import seg_sum
from .textkit import U64, Words, hash_spans, mix, rolling

ORDERS, BITS = (3, 4), 15
#: Bound of the sample, rows of each label; one in CALIBRATE of them calibrates.
TRAIN_ROWS, CALIBRATE = 1200, 3
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_QUALITY = 50, 50, 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    known: bool


def counts(words: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, bounds = words.data, words.text_at
    texts = len(bounds) - 1
    spaces = (data == 0x20) | ((data >= 9) & (data <= 13))
    # no text is empty here: each has its newline
    chars = np.add.reduceat(~spaces & ((data & 0xC0) != 0x80), bounds[:-1], dtype=np.int64) if texts else bounds[:-1]
    symbols = np.add.reduceat(_SYMBOL[data], bounds[:-1], dtype=np.int64) if texts else bounds[:-1]
    ends = np.flatnonzero(data == 10)  # a newline also ends each text
    begins = np.append(0, ends[:-1] + 1) if len(ends) else ends
    filled = np.searchsorted(words.start, ends) > np.searchsorted(words.start, begins)
    begins, ends = begins[filled], ends[filled]
    owner = np.searchsorted(bounds, begins, "right") - 1
    line = mix(hash_spans(data, begins, ends) + owner.astype(U64) * U64(0x9E3779B97F4A7C15))
    _, head = np.unique(line, return_index=True)
    dup = np.bincount(owner, minlength=texts) - np.bincount(owner[head], minlength=texts)
    repeat = np.zeros(len(words) + 1, np.int64)
    if len(words) > 2:
        word_owner = words.owner()
        whole = np.flatnonzero(word_owner[2:] == word_owner[:-2])
        window = mix(rolling(words.hash, 3)[whole] + word_owner[whole].astype(U64) * U64(0x9E3779B97F4A7C15))
        _, back, times = np.unique(window, return_inverse=True, return_counts=True)
        at = whole[times[back] > 1]
        np.add.at(repeat, at, 1)
        np.add.at(repeat, at + 3, -1)
    hit = (np.cumsum(repeat[:-1]) > 0).astype(np.int64)
    return {"n_words": words.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": seg_sum(hit, words.first)}


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Learn from the rows of labels (doc_id, quality) that docs (doc_id, text) has."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter("label in (0, 1)").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    share = dict(known.groupBy("label").count().collect())
    rows = hashed.sample(docs, known, most, ORDERS, BITS, with_words=True, lower=False, chars=True)
    y = np.array([r[0] for r in rows])
    if len(set(y.tolist())) < 2:
        return Model(np.zeros((1, 1), np.float32), 0.0, 1.0, 0.0, False)
    aside = np.arange(len(rows)) % CALIBRATE == 0
    weights, bias = hashed.fit([r for r, x in zip(rows, aside, strict=True) if not x], (2 * y - 1)[~aside, None], (len(ORDERS) + 1) << BITS)
    margin = np.array([float((weights[r[1], 0] * r[2]).sum()) + bias[0] for r, x in zip(rows, aside, strict=True) if x])
    truth = y[aside] == 1
    per_row = np.where(truth, share[1] / max(1, truth.sum()), share[0] / max(1, (~truth).sum()))
    slope, offset = hashed.platt(margin, truth, per_row / per_row.mean())
    return Model(weights, float(bias[0]), slope, offset, True)


def assess(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), threshold: float = MIN_QUALITY) -> DataFrame:
    """keep, the counts, base_failed, quality (calibrated probability) and kept of every row."""

    def work(texts, _):
        words = Words(texts)
        c = counts(words)
        failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
        quality = np.ones(len(texts))
        if model.known:
            margin = hashed.linear(words, model.weights, ORDERS, BITS, with_words=True, chars=True)[:, 0] + model.bias
            quality = 1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -700, 700)))
        return [*(x.astype(np.int64) for x in c.values()), failed, quality, ~failed & (quality >= threshold)]

    return hashed.per_row(docs, keep, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean", work)
