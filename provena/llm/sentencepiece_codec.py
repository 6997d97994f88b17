"""SentencePiece models on the tokenizers library: encoding, decoding and parity.

The model file's protobuf is read field by field; from it the normaliser (character map,
white-space rules, dummy prefix), the space marker, the unigram scores or the merges of
a byte-pair model, and byte fallback are rebuilt. Where no piece has a marker after
another character - checked on the vocabulary - words are encoded apart: a batch's words
that the worker has not met go to the library's multithreaded batch encoder, and texts are
put together from them with the same result. Every distinct word is also encoded with the
original library (parity) and decoded again (round trip).

Null texts are empty; an empty text has no ids. Strings of special tokens in a text are
ordinary text. A text's round trip fails where the normaliser changes it, and for U+2581,
which decodes as a space. The vocabulary is a file given by path; it is read on the
driver and travels with the tasks (a bounded few megabytes).
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, seg_sum, session

MARK = "▁"
#: Not a character, so no text holds it.
NEVER = "\U0010ffff"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
DEFAULT_MODEL = "piece_bpe_32k.model"
#: Distinct words that a worker keeps encoded.
CACHE_WORDS = 200_000
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_MODEL)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """Number and value of each protobuf field: varint, bytes, or float for 32 bits."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, struct.unpack("<d" if kind == 1 else "<f", data[at : at + n])[0]
            at += n
        else:
            raise ValueError(f"protobuf wire type {kind}")


class Spec:
    """What a model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for number, value in fields(data):
            if number == 1:
                p = dict(fields(value))
                self.pieces.append((p.get(1, b"").decode(), float(p.get(2, 0.0)), p.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.suffix = bool(trainer.get(24, 0))
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normalizer.get(2, b"")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        self.escape = bool(normalizer.get(5, 1))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        if self.kind not in (UNIGRAM, BPE) or self.suffix or not self.escape:
            raise ValueError("only unigram and byte-pair models with a marker before words")

    @property
    def splits(self) -> bool:
        """Whether words can be encoded apart."""
        return self.dummy_prefix and not any(MARK in p.lstrip(MARK) for p, _, t in self.pieces if t in (NORMAL, USER))


def merges(spec: Spec) -> list[tuple[str, str]]:
    """All ways to join two pieces to a third, best result first."""
    rank = {p: i for i, (p, _, t) in enumerate(spec.pieces) if t in (NORMAL, USER)}
    found = []
    for piece, score, kind in spec.pieces:
        if kind == NORMAL:
            for i in range(1, len(piece)):
                left, right = piece[:i], piece[i:]
                if left in rank and right in rank:
                    found.append((-score, rank[piece], rank[left], rank[right], left, right))
    return [(x[4], x[5]) for x in sorted(found)]


def build(spec: Spec, whole: bool = True):
    """A tokenizers.Tokenizer of the spec. whole: with the white-space rules; otherwise for
    words that are normalised and marked already."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if spec.kind == UNIGRAM:
        # pieces that no text may match get names that it cannot have; see Codec.ids for bytes
        model = models.Unigram([(p if t in (NORMAL, USER) else f"{NEVER}{i}", s) for i, (p, s, t) in enumerate(spec.pieces)], spec.unknown, False)
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
        model = models.BPE(vocab, merges(spec), unk_token=spec.pieces[spec.unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback)
    t = Tokenizer(model)
    steps = []
    if whole:
        if spec.charsmap:
            steps.append(normalizers.Precompiled(spec.charsmap))
        if spec.squeeze:
            steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if spec.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        steps.append(normalizers.Replace(" ", MARK))
        if spec.squeeze:
            steps.append(normalizers.Replace(Regex(rf"{MARK}+\z"), ""))
        t.normalizer = normalizers.Sequence(steps)
        if spec.splits:
            t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else [])])
    t.add_special_tokens([AddedToken(p, special=True, normalized=False) for p, _, k in spec.pieces if k == USER])
    t.encode_special_tokens = True
    return t


class Codec:
    """Encodes and decodes with a model file's bytes."""

    def __init__(self, data: bytes):
        self.data, self.spec = data, Spec(data)
        self.whole = build(self.spec)
        self.plain = build(self.spec, whole=False)
        self.normal = self.whole.normalizer
        self.bytes = [self._bytes(p, k) for p, _, k in self.spec.pieces]
        self.byte_ids = {b[0]: i for i, (b, p) in enumerate(zip(self.bytes, self.spec.pieces, strict=True)) if p[2] == BYTE}
        self._original = None
        self.forget()

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    @property
    def original(self):
        if self._original is None:
            import sentencepiece

            self._original = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        return self._original

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of normalised texts. A unigram model's unknown runs become byte pieces here."""
        if self.spec.kind != UNIGRAM or not self.spec.byte_fallback:
            return [e.ids for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]
        found = self.plain.encode_batch(texts, add_special_tokens=False)  # with offsets
        out = []
        for text, e in zip(texts, found, strict=True):
            ids = e.ids
            if self.spec.unknown in ids:
                ids = [k for i, (a, b) in zip(ids, e.offsets, strict=True) for k in ([self.byte_ids[x] for x in text[a:b].encode()] if i == self.spec.unknown else [i])]
            out.append(ids)
        return out

    def normalised(self, text: str) -> str:
        """A text as the model sees it: with markers for spaces, and one before all."""
        if not self.spec.charsmap and not self.spec.squeeze:
            return (MARK if text and self.spec.dummy_prefix else "") + text.replace(" ", MARK)
        return self.normal.normalize_str(text)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the dummy prefix's space is dropped, broken UTF-8 replaced."""
        raw = b"".join(self.bytes[i] for i in ids)
        if self.spec.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids (int32), the text bounds, and per text: parity with the original library,
        and whether it decodes to itself."""
        texts = [t or "" for t in texts]
        ready = [self.normalised(t) for t in texts]
        if not self.spec.splits:
            found = self.ids(ready)
            bounds = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int64)
            same = np.array([a == b for a, b in zip(found, self.original.encode(texts, num_threads=1), strict=True)], bool)
            back = np.array([self.decode(x) == t for x, t in zip(found, texts, strict=True)], bool)
            return np.array([i for x in found for i in x], np.int32), bounds, same, back
        plain = not self.spec.charsmap and not self.spec.squeeze
        tokens, counts = [], []
        number, known = self.number, len(self.number)
        if known > CACHE_WORDS:
            self.forget()
            number, known = self.number, 0
        for t in ready:
            words = [w[1:] for w in _WORDS(t)] if MARK * 2 in t else t.split(MARK)[1:]
            counts.append(len(words))
            tokens.extend([number.setdefault(w, len(number)) for w in words])
        self.learn(list(number)[known:])
        tokens = np.array(tokens, np.int64)
        text_at = np.append(0, np.cumsum(counts)).astype(np.int64)
        n = np.diff(self.at)[tokens]
        out = self.flat[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.at[tokens], n)]
        bounds = np.append(0, np.cumsum(n))[text_at]
        kept = np.array([plain or a.replace(MARK, " ") == (" " + t if t else "") for a, t in zip(ready, texts, strict=True)], bool)
        kept &= np.array([MARK not in t for t in texts], bool)
        return out, bounds, seg_sum((~self.same)[tokens].astype(np.int64), text_at) == 0, (seg_sum((~self.back)[tokens].astype(np.int64), text_at) == 0) & kept

    def forget(self) -> None:
        """Drop the encoded words."""
        self.number: dict[str, int] = {}
        self.flat, self.at = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.same, self.back = np.empty(0, bool), np.empty(0, bool)

    def learn(self, words: list[str]) -> None:
        """Encode new words (without their first marker), check them and keep the results."""
        if not words:
            return
        ids = self.ids([MARK + w for w in words])
        mark = self.original.piece_to_id(MARK)
        theirs = self.original.encode(words, num_threads=1)
        same = [a == (b if w else [mark]) for a, b, w in zip(ids, theirs, words, strict=True)]
        back = [b"".join([self.bytes[i] for i in x]) == (" " + w.replace(MARK, " ")).encode() for x, w in zip(ids, words, strict=True)]
        size = np.array([len(x) for x in ids], np.int64)
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])
        self.same, self.back = np.append(self.same, np.array(same, bool)), np.append(self.back, np.array(back, bool))


_codecs: dict[bytes, Codec] = {}


def encode(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threads: int = 2) -> DataFrame:
    """keep, n_tokens, ids (little-endian int32s), parity and round_trip of every row."""
    with open(path or default_path(), "rb") as f:
        data = session(docs).sparkContext.broadcast(f.read())
    shape = docs.select(*keep).schema
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        codec = _codecs.get(data.value)
        if codec is None:
            _codecs.clear()
            codec = _codecs[data.value] = Codec(data.value)
        for b in chunks(batches, len(keep), 1 << 20):
            ids, bounds, same, back = codec.encode(b.column(len(keep)).to_pylist())
            raw = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, "<i4"))])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(np.diff(bounds)), raw, pa.array(same), pa.array(back)], names=[*shape.names, "n_tokens", "ids", "parity", "round_trip"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, head + "n_tokens long, ids binary, parity boolean, round_trip boolean")


def decode(rows: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and text of rows with ids, as encode() gives them; null ids give null."""
    with open(path or default_path(), "rb") as f:
        data = session(rows).sparkContext.broadcast(f.read())
    shape = rows.select(*keep).schema
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(data.value)
        for b in chunks(batches, "ids"):
            texts = [None if x is None else codec.decode(np.frombuffer(x, "<i4")) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=[*shape.names, "text"])

    return rows.select(*keep, "ids").mapInArrow(run, head + "text string")
