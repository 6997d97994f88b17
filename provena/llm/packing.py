"""Columns packed for an exchange: byte planes, the first column sorted and as differences."""

from __future__ import annotations

import numpy as np


def planes(x: np.ndarray) -> bytes:
    """Byte planes of a sorted column's differences, which compress well."""
    return np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def unplanes(raw: memoryview, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel(), dtype=kind)


def pack(columns: list[np.ndarray]) -> bytes:
    """The first column sorted, the rest as byte planes."""
    head = np.array([len(columns[0])], np.int64).tobytes() + planes(columns[0])
    return head + b"".join(c.view(np.uint8).reshape(-1, c.dtype.itemsize).T.tobytes() for c in columns[1:])


def unpack(raw: bytes, kinds: list[type]) -> list[np.ndarray]:
    n, view, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), memoryview(raw), 8, []
    for i, kind in enumerate(kinds):
        size = np.dtype(kind).itemsize * n
        part = view[at : at + size]
        out.append(unplanes(part, n, kind) if not i else np.ascontiguousarray(np.frombuffer(part, np.uint8).reshape(np.dtype(kind).itemsize, n).T).view(kind).ravel())
        at += size
    return out
