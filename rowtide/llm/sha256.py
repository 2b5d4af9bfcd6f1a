"""SHA-256 of many messages at once, whose states can be kept, copied and resumed.

A state is eight 32-bit words between two blocks of 64 bytes. The hexadecimal text of a digest is one block, so that
a message of digests can be resumed before any of them from 32 bytes. All functions work on arrays with a row per
message.
"""

import math

import numpy as np

SIZE = 32  # bytes of a digest, and of a state


def _primes(n: int) -> list[int]:
    found: list[int] = []
    number = 2
    while len(found) < n:
        if all(number % p for p in found):
            found.append(number)
        number += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 2)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle ** 3 <= x else (low, middle - 1)
    return low


_MASK = (1 << 32) - 1
#: First 32 bits of the fractions of the square roots of 8 primes and of the cube roots of 64.
START = np.array([math.isqrt(p << 64) & _MASK for p in _primes(8)], np.uint32)
_ROUND = [np.uint32(_cube_root(p << 96) & _MASK) for p in _primes(64)]
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _block(state: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """The states after one more block each, given as 16 arrays of words."""
    w = list(words)
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        small = _turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))
        large = _turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))
        w.append(w[i - 16] + small + w[i - 7] + large)
    a, b, c, d, e, f, g, h = (state[:, i] for i in range(8))
    for k, word in zip(_ROUND, w):
        up = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + k + word
        down = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        h, g, f, e, d, c, b, a = g, f, e, d + up, c, b, a, up + down
    return state + np.stack([a, b, c, d, e, f, g, h], axis=1)


def begin(rows: int) -> np.ndarray:
    return np.tile(START, (rows, 1))


def absorb(state: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """States after the hexadecimal text of one digest (a row of 32 bytes) each."""
    text = np.empty((len(digests), 2 * SIZE), np.uint8)
    text[:, 0::2], text[:, 1::2] = _HEX[digests >> 4], _HEX[digests & 15]
    words = text.view(">u4").astype(np.uint32)
    return _block(state, [words[:, i] for i in range(16)])


def finish(state: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Digests (rows of 32 bytes) of messages that end here, after ``count`` digests each."""
    words = [np.zeros(len(state), np.uint32) for _ in range(16)]
    words[0] = words[0] + np.uint32(1 << 31)
    words[15] = (count * (16 * SIZE)).astype(np.uint32)
    return as_bytes(_block(state, words))


def as_bytes(state: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(state.astype(">u4")).view(np.uint8)


def as_state(bytes_: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(bytes_).view(">u4").astype(np.uint32)
