"""Keyed draws. Every random choice is a function of (seed, key), so a lost task
recomputes the same rows and any SQL engine can repeat the draw."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 2**32


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def keyed_md5(seed: int | str, *keys) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(k).cast("string") for k in keys]))


def draw(seed: int | str, *keys) -> Column:
    """Uniform integer in [0, 2^32) for the key."""
    return F.conv(F.substring(keyed_md5(seed, *keys), 1, 8), 16, 10).cast("bigint")


def shard_of(key, n: int) -> Column:
    """Full 128-bit MD5 of the key modulo ``n``, folded over its four 32-bit words.
    With ``n`` below 2^31 no step leaves 63 bits."""
    if not 0 < n < 2**31:
        raise ValueError("the number of shards must be positive and below 2^31")
    digest = F.md5(_c(key).cast("string"))
    rest = F.lit(0).cast("bigint")
    for word in range(4):
        value = F.conv(F.substring(digest, 8 * word + 1, 8), 16, 10).cast("bigint")
        rest = (rest * (DRAW_RANGE % n) + value) % n
    return rest.cast("int")


_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_ends(tag: bytes, numbers: Iterable[int]) -> np.ndarray:
    """Words 8 to 15 of the MD5 blocks of messages that are 32 bytes, ``tag`` and a number: a row per number."""
    tails = [tag + str(k).encode() for k in numbers]
    blocks = [t + b"\x80" + bytes(23 - len(t)) + (8 * (32 + len(t))).to_bytes(8, "little") for t in tails]
    return np.frombuffer(b"".join(blocks), "<u4").reshape(-1, 8)


def md5_words(head: list[np.ndarray], end: list) -> list[np.ndarray]:
    """MD5 of many one-block messages at once: the four 32-bit words of their digests as the hex text reads.
    ``head``: arrays of words 0 to 7; ``end``: words 8 to 15, as arrays or one number for all."""
    words = [*head, *end]
    a, b, c, d = (np.full(len(head[0]), x, np.uint32) for x in _STATE)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        if isinstance(words[g], int):
            f += np.uint32((words[g] + _SINES[i]) % 2**32)
        else:
            f += words[g]
            f += np.uint32(_SINES[i])
        turn = _TURNS[i // 16][i % 4]
        a, d, c, b = d, c, b, b + ((f << np.uint32(turn)) | (f >> np.uint32(32 - turn)))
    return [(x + np.uint32(s)).byteswap() for x, s in zip((a, b, c, d), _STATE)]
