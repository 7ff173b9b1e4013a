"""Hashed word shingles of whole texts, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np

WIDTH = 5
#: Bytes of text hashed at once; a longer text is hashed in pieces cut at white space.
PIECE = 1 << 18
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * _U(2) + _U(1)
_powers = {"n": 0}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, PIECE + (1 << 16))
        up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
        up[0] = down[0] = 1
        _powers.update(n=size, up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return _powers["up"][:n], _powers["down"][:n]


def _words(buf: np.ndarray, starts_of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word; a text's start ends a word too."""
    up, down = _grown(len(buf))
    ink = ~_SPACE[buf]
    new = np.ones(len(buf), bool)
    new[1:] = ~ink[:-1]
    new[starts_of_texts] = True
    first = np.nonzero(ink & new)[0]
    last = np.ones(len(buf), bool)
    last[:-1] = ~ink[1:] | new[1:]
    end = np.nonzero(ink & last)[0] + 1
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up, out=total[1:])
    return _mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64)), first


def _shingled(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of WIDTH words."""
    n = len(words) - WIDTH + 1
    total = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        total += words[k : k + n] * _PLACE[k]
    return _mix(total)


def _set(words: np.ndarray, shingled: np.ndarray) -> np.ndarray:
    if len(words) >= WIDTH:
        return np.unique(shingled)
    return _mix((words * _PLACE[: len(words)]).sum(keepdims=True) + _U(len(words))) if len(words) else np.zeros(0, np.uint64)


def shingle_sets(texts):
    """texts: an Arrow string array -> yields each text's sorted, distinct shingle hashes (uint64), in order.

    Null and blank texts have none; a text with fewer words than a shingle has one, of all its words.
    """
    import pyarrow as pa

    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[upto])
        if hi - lo > PIECE:  # one long text
            words = []
            while lo < hi:
                end = min(hi, lo + PIECE)
                while end < hi and not _SPACE[data[end]]:
                    end += 1
                words.append(_words(data[lo:end], np.array([0]))[0])
                lo = end
            words = np.concatenate(words)
            yield _set(words, _shingled(words) if len(words) >= WIDTH else words)
        elif hi == lo:
            for _ in range(at, upto):
                yield np.zeros(0, np.uint64)
        else:
            starts = offsets[at : upto + 1] - lo
            words, first = _words(data[lo:hi], starts[:-1][starts[:-1] < hi - lo])
            runs = _shingled(words) if len(words) >= WIDTH else words
            bounds = np.searchsorted(first, starts)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield _set(words[a:b], runs[a : max(a, b - WIDTH + 1)])
        at = upto
