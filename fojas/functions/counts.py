"""Words of many texts at once: their stems with counts, and hashed vectors, from one look at the bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken at once (a longer text is taken whole), and characters of a word that are hashed for all words together.
BYTES, LONG = 1 << 22, 64
_INSIDE = np.zeros(256, bool)
_INSIDE[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True


def _slices(texts: pa.StringArray) -> Iterator[pa.StringArray]:
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BYTES, side="right")) - 1)
        yield texts.slice(lo, hi - lo)
        lo = hi


def _found(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (zeros follow), and row, begin and length of every run of two and more of the characters a-z and 0-9."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    inside, edge = _INSIDE[data], np.zeros(len(data) + 1, bool)
    edge[at] = True
    linked = inside[:-1] & inside[1:] & ~edge[1:-1] if len(data) else inside  # with the next one
    start = np.flatnonzero(inside & ~np.append(False, linked)[: len(data)])
    size = np.flatnonzero(inside & ~np.append(linked, False)[: len(data)]) + 1 - start
    start, size = start[size > 1], size[size > 1]
    return np.append(data, np.zeros(8, np.uint8)), np.searchsorted(at, start, side="right") - 1, start, size


def _stems(data: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray, n: int, stem: int) -> tuple[pa.ListArray, pa.ListArray]:
    key = np.zeros(len(start), np.uint64)
    for i in range(stem):
        key |= np.where(size > i, data[start + i], 0).astype(np.uint64) << np.uint64(8 * i)
    coded = pa.array(key).dictionary_encode()
    names = pa.array(coded.dictionary.to_numpy().astype("<u8").view("S8").astype("U8").tolist(), pa.string())
    pairs = pa.array(row * max(len(names), 1) + coded.indices.to_numpy()).dictionary_encode()  # in the order of the texts
    of, which = np.divmod(pairs.dictionary.to_numpy(), max(len(names), 1))
    at = pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=n))), pa.int32())
    f = pa.array(np.bincount(pairs.indices.to_numpy(), minlength=len(of)), pa.int32())
    return pa.ListArray.from_arrays(at, names.take(pa.array(which))), pa.ListArray.from_arrays(at, f)


def _hashed(data: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray, n: int, dim: int) -> pa.ListArray:
    row, start, size = (x[size > 2] for x in (row, start, size))
    h, own = np.zeros(len(row), np.uint32), np.arange(len(row))
    for i in range(LONG):
        h[own] = h[own] * np.uint32(31) + data[start[own] + i]
        own = own[size[own] > i + 1]
        if not len(own):
            break
    for j in own.tolist():
        x = int(h[j])
        for c in data[start[j] + LONG : start[j] + size[j]].tolist():
            x = (x * 31 + c) & 0xFFFFFFFF
        h[j] = x
    v = np.bincount(row * dim + h % np.uint32(dim), minlength=n * dim).astype(float)
    there = v.reshape(n, dim).any(axis=1)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(v), mask=pa.array(~there))


def counted(texts: pa.StringArray, stem: int, dim: int) -> dict[str, pa.Array]:
    """Columns by name for texts in lower case without accents: dl, terms and f as in ``lexical.documents`` if ``stem`` (at most 8) isn't 0, and
    the vector of ``vectors.hash_encode``, null instead of zeros, if ``dim`` isn't 0."""
    if stem > 8:
        raise ValueError("a stem has at most 8 characters")
    out: dict[str, list[pa.Array]] = {"dl": [], "terms": [], "f": []} if stem else {}
    if dim:
        out["vector"] = []
    for own in _slices(texts) if len(texts) else [texts]:
        n, (data, row, start, size) = len(own), _found(own) if len(own) else (np.zeros(8, np.uint8), *[np.zeros(0, np.int64)] * 3)
        if stem:
            out["dl"].append(pa.array(np.maximum(np.bincount(row, minlength=n), 1)[:n], pa.int32()))
            for name, x in zip(("terms", "f"), _stems(data, row, start, size, n, stem), strict=True):
                out[name].append(x)
        if dim:
            out["vector"].append(_hashed(data, row, start, size, n, dim))
    return {k: pa.concat_arrays(v) for k, v in out.items()}
