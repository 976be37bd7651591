"""CRC-32 of many words, and of neighbouring words joined by a space, with numpy.

A checksum is linear over the bytes' bits, so that of ``a b`` follows from those of ``a`` and ``b``: that of ``a`` is carried
over the bytes that follow by a table for their number. Words of over ``SHORT`` bytes are summed one by one.
"""

from __future__ import annotations

import zlib

import numpy as np

from .common import Texts

SHORT = 48
_U = np.uint32


def _tables() -> tuple[np.ndarray, np.ndarray]:
    one = np.arange(256, dtype=_U)
    for _ in range(8):
        one = (one >> _U(1)) ^ np.where(one & _U(1), _U(0xEDB88320), _U(0))
    over = np.empty((SHORT + 1, 4, 256), _U)
    for j in range(4):
        over[0, j] = np.arange(256, dtype=_U) << _U(8 * j)
    for n in range(1, SHORT + 1):
        over[n] = one[over[n - 1] & _U(255)] ^ (over[n - 1] >> _U(8))
    return one, over


#: By byte; by number of bytes that follow, place of a byte in the checksum and its value.
ONE, OVER = _tables()
_SPACE = _U(zlib.crc32(b" "))


def of_words(t: Texts) -> np.ndarray:
    """Unsigned checksum of each word's bytes."""
    size = t.ends - t.starts
    out = np.empty(len(size), _U)
    short = np.flatnonzero(size <= SHORT)
    order = short[np.argsort(-size[short].astype(np.int8), kind="stable")]
    start, c = t.starts[order], np.full(len(order), 0xFFFFFFFF, _U)
    more = len(order) - np.cumsum(np.bincount(size[order], minlength=SHORT + 1))  # words of over p bytes
    for p, m in enumerate(more[:SHORT].tolist()):
        if not m:
            break
        now = c[:m]
        c[:m] = ONE[(now ^ t.buf[start[:m] + p]) & _U(255)] ^ (now >> _U(8))
    out[order] = c ^ _U(0xFFFFFFFF)
    long = np.flatnonzero(size > SHORT)
    out[long] = [zlib.crc32(t.buf[s:e]) for s, e in zip(t.starts[long].tolist(), t.ends[long].tolist(), strict=True)]
    return out


def of_pairs(t: Texts, crc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Checksum of each word in ``first`` (indexes), a space and the next word."""
    a, b = crc[first], crc[first + 1]
    a = ONE[a & _U(255)] ^ (a >> _U(8)) ^ _SPACE
    size = (t.ends - t.starts)[first + 1]
    n = np.minimum(size, SHORT)
    out = b.copy()
    for j in range(4):
        out ^= OVER[n, j, (a >> _U(8 * j)) & _U(255)]
    for i in np.flatnonzero(size > SHORT).tolist():
        w = first[i] + 1
        out[i] = zlib.crc32(t.buf[t.starts[w] : t.ends[w]], int(a[i]))
    return out
