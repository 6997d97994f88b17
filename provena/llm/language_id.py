"""Language identification with error-correcting output codes.

Every language has a codeword of bits; for each bit a binary classifier over hashed
byte 2- and 3-grams of the whole text (A-Z folded) predicts it. A text gets the
language whose codeword has the smallest logistic loss against all predictions, and is
flagged as ambiguous when the runner-up is close. Codes are exhaustive for up to five
languages; beyond, seeded random codes with the largest smallest distance of many.

Null texts and texts with no letter are `und` with score 0. With no labelled rows all
other texts are `und` too; with one language it is given to all, with score 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashed
from .textkit import Words

ORDERS, BITS = (2, 3), 14
#: Bound of the sample that classifiers are fitted on, rows of each language.
TRAIN_ROWS = 600
#: A result is ambiguous below this difference of losses.
MARGIN = 0.5


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def codewords(n: int) -> np.ndarray:
    """n rows of +-1: one codeword per language."""
    if n <= 1:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        bits = [[1 if (m >> i) & 1 else -1 for i in range(n)] for m in range(1, 1 << (n - 1))]
        return np.array(bits, np.int8).T
    rng, best, far = np.random.default_rng(7), None, -1
    width = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        gap = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        whole = bool((np.abs(code.sum(0)) < n).all())
        if whole and gap > far:
            best, far = code, gap
    return best


def fit(docs: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Learn from docs (doc_id, text, lang); rows without lang are no use."""
    rows = hashed.sample(docs, docs.select("doc_id", F.col("lang").alias("label")), most, ORDERS, BITS)
    languages = sorted({r[0] for r in rows})
    code = codewords(len(languages))
    index = np.array([languages.index(r[0]) for r in rows], np.int64)
    weights, bias = hashed.fit(rows, code[index] if len(rows) else np.zeros((0, 0)), len(ORDERS) << BITS)
    return Model(languages, code, weights, bias)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, its share of exp(-loss), and how far the next is."""
    loss = np.logaddexp(0, -margins[:, None, :] * model.code[None]).sum(2)
    best = loss.argmin(1)
    ranked = np.sort(loss, 1)
    share = np.exp(ranked[:, :1] - ranked)
    gap = ranked[:, 1] - ranked[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
    return best, 1 / share.sum(1), gap


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred, score, ambiguous of every row."""

    def work(texts, batch):
        letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
        if not model.languages:
            return [["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)]
        margins = hashed.linear(Words(texts, lower=True), model.weights, ORDERS, BITS) + model.bias
        best, score, gap = decode(model, margins)
        names = np.where(letters, np.array(model.languages, object)[best], "und")
        return [names.tolist(), np.where(letters, score, 0.0), ~letters | (gap < MARGIN)]

    return hashed.per_row(docs, keep, "lang_pred string, score double, ambiguous boolean", work, (F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letters"),))
