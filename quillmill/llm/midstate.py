"""SHA-256 over many messages at once in numpy, with states that can be kept and gone on with.

States and digests are arrays of eight rows of 32-bit words, one column per
message.  Messages are runs of 64-byte blocks; a digest as hex text is one block.
"""

from __future__ import annotations

from math import isqrt

import numpy as np

U = np.uint32
#: Messages worked on together, so that their words stay in a processor's cache.
TOGETHER = 4096


def _primes(n: int) -> list[int]:
    found: list[int] = []
    at = 2
    while len(found) < n:
        if all(at % p for p in found):
            found.append(at)
        at += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle ** 3 <= x else (low, middle - 1)
    return low


START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], U)
ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], U)
_DIGITS = np.array([ord(c) for c in "0123456789abcdef"], U)
#: The two hex digits of each byte as one number of 16 bits.
HEX = (_DIGITS[np.arange(256) >> 4] << U(8)) | _DIGITS[np.arange(256) & 15]


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> U(n)) | (x << U(32 - n))


def _rounds(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        if i >= 16:
            x, y = w[i - 15], w[i - 2]
            w.append(w[i - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> U(3))) + w[i - 7]
                     + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> U(10))))
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[i] + w[i]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def advance(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states after one more block each."""
    out = np.empty_like(state)
    for at in range(0, state.shape[1], TOGETHER):
        part = slice(at, at + TOGETHER)
        out[:, part] = _rounds(state[:, part], block[:, part])
    return out


def start(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests of messages of so many blocks: the length block ends each."""
    last = np.zeros((16, state.shape[1]), U)
    last[0] = 0x80000000
    last[15] = np.asarray(blocks).astype(U) * U(512)
    return advance(state, last)


def hex_block(digest: np.ndarray) -> np.ndarray:
    """Digests as hex text, in blocks."""
    high = (HEX[digest >> U(24)] << U(16)) | HEX[(digest >> U(16)) & U(255)]
    low = (HEX[(digest >> U(8)) & U(255)] << U(16)) | HEX[digest & U(255)]
    return np.stack([high, low], axis=1).reshape(16, -1)


def from_bytes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u4").astype(U).reshape(-1, 8).T.copy()


def to_bytes(digest: np.ndarray) -> list[bytes]:
    body = digest.T.astype(">u4").tobytes()
    return [body[i: i + 32] for i in range(0, len(body), 32)]
