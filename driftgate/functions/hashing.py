"""Keyed hashes, row fingerprints and repeatable random draws, all as Spark expressions."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK_BYTES = 64


def hmac_sha256(value: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 (RFC 2104) of the UTF-8 text of ``value``; null stays null."""
    block = hashlib.sha256(key).digest() if len(key) > _BLOCK_BYTES else key
    block = block.ljust(_BLOCK_BYTES, b"\0")
    inner_pad = F.lit(bytes(b ^ 0x36 for b in block))
    outer_pad = F.lit(bytes(b ^ 0x5C for b in block))
    message = F.encode(value.cast("string"), "UTF-8")
    inner = F.sha2(F.concat(inner_pad, message), 256)
    return F.sha2(F.concat(outer_pad, F.unhex(inner)), 256)


def key_fingerprint(key: bytes) -> Column:
    """First eight hex digits of the SHA-256 of the key."""
    return F.left(F.sha2(F.lit(key), 256), F.lit(8))


def hex_slice(digest: Column, start: int, digits: int) -> Column:
    """``digits`` hex digits of a digest from ``start`` (1-based) as a bigint."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def uniform_draw(key: Column, method: str = "md5") -> Column:
    """A number in [0,1) that depends on ``key`` alone, so it repeats on any layout.

    ``md5`` can be repeated by any engine, ``xxhash64`` is several times faster.
    """
    if method == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(key), 11) / F.lit(float(2**53))
    return hex_slice(F.md5(key.cast("string")), 1, 13) / F.lit(float(2**52))


def normal_draw(key: Column, method: str = "md5") -> Column:
    """A standard normal draw that depends on ``key`` alone (Box-Muller on one or two hashes)."""
    if method == "xxhash64":
        first = (F.shiftrightunsigned(F.xxhash64(key), 11) + F.lit(0.5)) / F.lit(float(2**53))
        second = F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 11) / F.lit(float(2**53))
    else:
        digest = F.md5(key.cast("string"))
        first = (hex_slice(digest, 1, 13) + F.lit(0.5)) / F.lit(float(2**52))
        second = hex_slice(digest, 14, 13) / F.lit(float(2**52))
    return F.sqrt(F.lit(-2.0) * F.ln(first)) * F.cos(F.lit(6.283185307179586) * second)


def normal_draws(before: str, first: int, last: int, after: str) -> np.ndarray:
    """``normal_draw`` by MD5 of the keys ``before + number + after`` for the numbers from ``first`` up to ``last``, as one array."""
    start, end = before.encode(), after.encode()
    parts, at = [], first
    while at < last:
        digits = len(str(at))
        upto = min(last, 10**digits)  # numbers of equal length
        parts.append(_md5_words(start, at, upto, digits, end))
        at = upto
    a, b, c, d = (np.concatenate(words).byteswap().astype(np.uint64) for words in zip(*parts, strict=True))
    high, low = (a << np.uint64(32)) | b, (c << np.uint64(32)) | d
    one = ((high >> np.uint64(12)).astype(float) + 0.5) / float(2**52)
    two = (((high & np.uint64(0xFFF)) << np.uint64(40)) | (low >> np.uint64(24))).astype(float) / float(2**52)
    return np.sqrt(-2.0 * np.log(one)) * np.cos(6.283185307179586 * two)


_MD5_MIX = (
    lambda b, c, d: d ^ (b & (c ^ d)), lambda b, c, d: c ^ (d & (b ^ c)), lambda b, c, d: b ^ c ^ d, lambda b, c, d: c ^ (b | ~d),
)


@cache
def _md5_steps() -> list[tuple[int, int, int]]:
    """Constant, word of the message and turn of each of the 64 steps (RFC 1321)."""
    turns = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
    word = (lambda i: i, lambda i: 5 * i + 1, lambda i: 3 * i + 5, lambda i: 7 * i)
    return [(int(abs(np.sin(i + 1)) * 2**32), word[i // 16](i) % 16, turns[i // 16][i % 4]) for i in range(64)]


def _md5_words(before: bytes, first: int, last: int, digits: int, after: bytes) -> list[np.ndarray]:
    """The four words of the MD5 of each key, all keys in step; keys of more than one block, and a few keys, are left to hashlib."""
    length = len(before) + digits + len(after)
    if length > 55 or last - first < 500:
        texts = b"".join(hashlib.md5(b"%b%d%b" % (before, i, after)).digest() for i in range(first, last))
        return list(np.frombuffer(texts, "<u4").reshape(-1, 4).T.astype(np.uint32))
    same = (before + bytes(digits) + after + b"\x80").ljust(56, b"\0") + (8 * length).to_bytes(8, "little")
    words = [int.from_bytes(same[i:i + 4], "little") for i in range(0, 64, 4)]
    left = np.arange(first, last, dtype=np.uint32)
    for place in range(len(before) + digits - 1, len(before) - 1, -1):
        left, digit = np.divmod(left, np.uint32(10))
        words[place // 4] = words[place // 4] + ((digit + np.uint32(48)) << np.uint32(8 * (place % 4)))
    begun = [np.full(last - first, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = begun
    for i, (constant, w, turn) in enumerate(_md5_steps()):
        mixed = _MD5_MIX[i // 16](b, c, d)
        mixed += a
        if isinstance(words[w], int):
            mixed += np.uint32((constant + words[w]) % 2**32)
        else:
            mixed += words[w]
            mixed += np.uint32(constant)
        turned = mixed >> np.uint32(32 - turn)
        mixed <<= np.uint32(turn)
        mixed |= turned
        mixed += b
        a, d, c, b = d, c, b, mixed
    return [x + y for x, y in zip(begun, (a, b, c, d), strict=True)]


def keep_sample(key: Column, rate: float) -> Column:
    """Repeatable Bernoulli choice: the same key is always kept or always dropped."""
    return uniform_draw(key) < F.lit(float(rate))
