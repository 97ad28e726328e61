"""Repeatable randomness: uniforms that depend only on row keys and a seed."""

from __future__ import annotations

import hashlib
import math
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*keys: Column | str, seed: int | str) -> Column:
    """A double in [0, 1) from the first 52 bits of ``md5(key:key:...:seed)``."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws(":", *[p.cast("string") for p in parts], F.lit(str(seed)))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return bits / F.lit(4503599627370496.0)


#: Messages that are hashed at once; their words stay in a core's cache.
AT_ONCE = 1 << 14
_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_BEGIN = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]


def _md5_head(words: list[Any], n: int) -> np.ndarray:
    """The first 52 bits of the MD5 of ``n`` one-block messages, given as 16 arrays or numbers."""
    u = np.uint32
    a, b, c, d = (np.full(n, x, u) for x in _BEGIN)
    f, g = np.empty(n, u), np.empty(n, u)
    for t in range(64):
        kind, k = t // 16, (t, 5 * t + 1, 3 * t + 5, 7 * t)[t // 16] % 16
        if kind == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        elif kind == 3:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        else:
            x, y, z = (b, c, d) if kind == 0 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            np.bitwise_and(f, x, out=f)
            np.bitwise_xor(f, z, out=f)
        np.add(f, a, out=f)
        if isinstance(words[k], np.ndarray):
            np.add(f, words[k], out=f)
            np.add(f, u(_SINES[t]), out=f)
        else:
            np.add(f, u((_SINES[t] + words[k]) % 2**32), out=f)
        turn = _TURNS[kind][t % 4]
        np.left_shift(f, u(turn), out=g)
        np.right_shift(f, u(32 - turn), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    np.add(a, u(_BEGIN[0]), out=a)
    np.add(b, u(_BEGIN[1]), out=b)
    return (a.byteswap().astype(np.uint64) << np.uint64(20)) | (b.byteswap().astype(np.uint64) >> np.uint64(12))


def slot_uniforms(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, slots: np.ndarray, seed: int | str) -> np.ndarray:
    """``uniform(key, slot)`` for messages of a prefix (``sizes`` bytes of ``data`` from ``starts`` on), a slot and the seed.

    The same numbers as those of ``uniform``, for whole arrays at once: messages of equal shape are laid out side by side.
    """
    out = np.empty(len(slots), np.float64)
    end = f":{seed}".encode()
    most = int(slots.max()) if len(slots) else 0
    digits = np.ones(len(slots), np.int64)
    for power in range(1, len(str(most))):
        digits += slots >= 10**power
    shapes = sizes.astype(np.int64) * 16 + digits
    for shape in np.flatnonzero(np.bincount(shapes)):
        some = np.flatnonzero(shapes == shape)
        size, n_digits = divmod(int(shape), 16)
        length = size + n_digits + len(end)
        if length > 55:
            for i in some:
                text = data[starts[i] : starts[i] + size].tobytes() + str(int(slots[i])).encode() + end
                out[i] = int(hashlib.md5(text, usedforsecurity=False).hexdigest()[:13], 16) / 2.0**52
            continue
        used = length // 4 + 1
        first = 10 ** (n_digits - 1) if n_digits > 1 else 0
        texts = b"".join(str(k).encode() + end + b"\x80" for k in range(first, min(most, 10**n_digits - 1) + 1))
        tails = np.frombuffer(texts, np.uint8).reshape(-1, length - size + 1)
        for at in range(0, len(some), AT_ONCE):
            rows = some[at : at + AT_ONCE]
            block = np.zeros((len(rows), used * 4), np.uint8)
            begin = starts[rows]
            for k in range(size):
                block[:, k] = data[begin + k]
            block[:, size : length + 1] = tails[slots[rows] - first]
            words = [np.ascontiguousarray(x, np.uint32) for x in block.view("<u4").T]
            out[rows] = _md5_head([*words, *[0] * (14 - used), length * 8, 0], len(rows)) / 2.0**52
    return out
