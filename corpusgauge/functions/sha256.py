"""SHA-256 that is left after a whole block and taken up again, by another task if need be.

``hashlib`` keeps the state of a digest to itself. The library behind it has it in a
public structure, which is used here; where that library is not to be had, the same
steps are taken in Python, slowly.
"""

from __future__ import annotations

import ctypes
import struct

BLOCK = 64
START = struct.pack(
    ">8I", 0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19
)
WORD = 0xFFFFFFFF


class _Context(ctypes.Structure):
    """``SHA256_CTX`` of OpenSSL."""

    _fields_ = [
        ("h", ctypes.c_uint32 * 8),
        ("bits", ctypes.c_uint32 * 2),
        ("data", ctypes.c_uint32 * 16),
        ("num", ctypes.c_uint),
        ("md_len", ctypes.c_uint),
    ]


def _library() -> ctypes.CDLL | None:
    """The library that ``hashlib`` is linked with, if it names these functions."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        lib.SHA256_Init.argtypes = [ctypes.POINTER(_Context)]
        lib.SHA256_Update.argtypes = [ctypes.POINTER(_Context), ctypes.c_char_p, ctypes.c_size_t]
    except (ImportError, OSError, AttributeError):
        return None
    return lib


def _roots(root: int, n: int) -> list[int]:
    """First 32 bits of the fractions of the square or cube roots of the first primes."""
    primes: list[int] = []
    x = 2
    while len(primes) < n:
        if all(x % p for p in primes):
            primes.append(x)
        x += 1
    out = []
    for p in primes:
        goal = p << (32 * root)
        low, high = 0, 1 << 40
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if mid**root <= goal else (low, mid)
        out.append(low & WORD)
    return out


ROUNDS = _roots(3, 64)


def _turn(x: int, n: int) -> int:
    return (x >> n | x << (32 - n)) & WORD


def plain_blocks(state: bytes, data: bytes) -> bytes:
    """:func:`blocks` without the library."""
    s = list(struct.unpack(">8I", state))
    for at in range(0, len(data), BLOCK):
        w = list(struct.unpack(">16I", data[at : at + BLOCK]))
        for i in range(16, 64):
            x, y = w[i - 15], w[i - 2]
            small = _turn(x, 7) ^ _turn(x, 18) ^ x >> 3
            w.append((w[i - 16] + small + w[i - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ y >> 10)) & WORD)
        a, b, c, d, e, f, g, h = s
        for k, v in zip(ROUNDS, w):
            one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (e & f ^ ~e & g) + k + v
            two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + (a & b ^ a & c ^ b & c)
            a, b, c, d, e, f, g, h = (one + two) & WORD, a, b, c, (d + one) & WORD, e, f, g
        s = [(x + y) & WORD for x, y in zip(s, (a, b, c, d, e, f, g, h))]
    return struct.pack(">8I", *s)


_LIBRARY = _library()


def blocks(state: bytes, data: bytes) -> bytes:
    """The state after further ``data``, whose length is a multiple of :data:`BLOCK`."""
    if len(data) % BLOCK:
        raise ValueError(f"{len(data)} bytes are no whole blocks")
    if _LIBRARY is None:
        return plain_blocks(state, data)
    c = _Context()
    _LIBRARY.SHA256_Init(c)
    c.h[:] = struct.unpack(">8I", state)
    _LIBRARY.SHA256_Update(c, data, len(data))
    return struct.pack(">8I", *c.h)


def finish(state: bytes, size: int) -> str:
    """Hex digest of the ``size`` bytes, all whole blocks, that led to ``state``."""
    return blocks(state, b"\x80".ljust(BLOCK - 8, b"\0") + struct.pack(">Q", 8 * size)).hex()
