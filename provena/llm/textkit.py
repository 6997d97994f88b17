"""Vectorised text primitives shared by the corpus operators.

A batch of texts is one byte buffer. Words are maximal runs of bytes other than
0x20 and 0x09-0x0D; case folding touches A-Z only. Hashes are 64-bit polynomial
sums (mod 2**64) passed through a bit mixer: equal inputs always agree, unequal
ones collide with odds near 2**-64 for inputs of under a thousand bytes.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _grown(name: str, step: np.uint64, n: int) -> np.ndarray:
    """step ** 0..n-1 modulo 2**64, kept for the life of the process."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, step, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over the word."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums s with s[i] = sum of values[j] * base**j for j < i, for span_hash."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _grown("b", _BASE, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end), the same wherever the span stands."""
    inverse = _grown("i", _INVERSE, len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64) * U64(0x2545F4914F6CDD1D))


#: Bytes whose weighted sums are held at once.
BLOCK = 1 << 17


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """span_hash of the spans [start, end) of bytes, in any order, whose sums are formed block
    by block: what is held beside the bytes grows with the spans alone."""
    points = np.append(start, end)
    order = np.argsort(points, kind="stable")
    ranked = points[order]
    sums = np.empty(len(points), U64)
    inverse = np.empty(len(points), U64)
    carry, scale, unscale = U64(0), U64(1), U64(1)
    step, back = (U64(pow(int(x), BLOCK, 1 << 64)) for x in (_BASE, _INVERSE))
    cuts = np.searchsorted(ranked, np.arange(0, len(data) + BLOCK, BLOCK))
    with np.errstate(over="ignore"):
        for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            values = _TABLE[data[k * BLOCK : (k + 1) * BLOCK]]
            own = np.zeros(len(values) + 1, U64)
            np.cumsum(values * _grown("b", _BASE, len(values)), out=own[1:])
            at = ranked[a:z] - k * BLOCK
            sums[order[a:z]] = carry + own[at] * scale
            inverse[order[a:z]] = _grown("i", _INVERSE, BLOCK)[at] * unscale
            carry, scale, unscale = carry + own[-1] * scale, scale * step, unscale * back
        last = cuts[-1]
        if last < len(ranked):  # the end of data, where that is a block's end
            sums[order[last:]] = carry
            inverse[order[last:]] = unscale
    n = len(start)
    return mix((sums[n:] - sums[:n]) * inverse[:n] + (end - start).astype(U64) * U64(0x2545F4914F6CDD1D))


def powers(n: int) -> np.ndarray:
    """The weights of a window's first n values in rolling_sums."""
    return _grown("b", _BASE, n)


def rolling_sums(values: np.ndarray, width: int) -> np.ndarray:
    """Weighted sum of every window of width values, before mixing; empty when there are fewer."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    sums = prefix_sums(values)
    return (sums[width:] - sums[:n]) * _grown("i", _INVERSE, n)


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of width values; empty when there are fewer."""
    return mix(rolling_sums(values, width))


class Words:
    """The words of a batch of texts.

    data: the bytes, texts divided by a newline; start, end: each word's place in
    data; first: the index of each text's first word, with the total at the end;
    text_at: each text's first byte, with one past the last newline at the end. Without spans
    only data and text_at are there.
    """

    def __init__(self, texts: list[str | bytes | None], lower: bool = False, spans: bool = True):
        raw = [t if isinstance(t, bytes) else b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(b"\n".join([*raw, b""]) or b"\n", np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        self.text_at = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=self.text_at[1:])
        self._hash: np.ndarray | None = None
        if not spans:
            return
        space = _SPACE[self.data]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
        if len(edge) % 2:
            edge = np.append(edge, len(self.data))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.text_at)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hash_spans(self.data, self.start, self.end)
        return self._hash

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every window of width values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def anchors(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, length: int, gram: int):
    """Cut the possible starts of strings of the given length into anchored runs.

    values: a hashable value per symbol of a buffer of several texts, each at
    starts with its length. Each start of a string of `length` symbols is owned by
    the leftmost of its smallest grams, which depends on that string alone, so
    equal strings have equal anchors at equal distances. Returns, for each run of
    neighbouring starts with one anchor: text, first start, number of starts,
    anchor place (all from the text's start), and the anchor gram's 64-bit hash.
    """
    grams = rolling(values, gram)
    span = length - gram + 1
    if len(grams) < span:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, U64),)
    # 31 bits of order, then the place: the least is the leftmost of the smallest
    ranked = ((grams >> U64(33)) << U64(32)) | np.arange(len(grams), dtype=U64)
    chosen = (window_min(ranked, span) & U64(0xFFFFFFFF)).astype(np.int64)
    fits = np.maximum(lengths - length + 1, 0)
    text = np.repeat(np.arange(len(starts)), fits)
    at = np.arange(len(text)) - np.repeat(np.cumsum(fits) - fits, fits) + starts[text]
    place = chosen[at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(at)))
    text, at, place = text[head], at[head], place[head]
    return text, at - starts[text], count, place - starts[text], grams[place]
