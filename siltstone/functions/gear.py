"""The gear table and cut masks of content-defined chunking."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np

#: The seed of the table, and the SHA-256 of its 256 numbers as little-endian 64-bit integers.
GEAR_SEED = 0x8F3F73B5CF1C9ADE
GEAR_SHA256 = "fd65ecd25684a1b5232249fb469e75d1f25a6b3c3434fda271818059a50e71ba"
_MASK = (1 << 64) - 1


def mt19937_64(seed: int, n: int) -> list[int]:
    """The first n numbers of the public 64-bit Mersenne twister."""
    state = [seed]
    for i in range(1, 312):
        state.append((6364136223846793005 * (state[-1] ^ state[-1] >> 62) + i) & _MASK)
    out: list[int] = []
    while len(out) < n:
        for i in range(312):
            x = state[i] & ~0x7FFFFFFF & _MASK | state[(i + 1) % 312] & 0x7FFFFFFF
            state[i] = state[(i + 156) % 312] ^ x >> 1 ^ (0xB5026F5AA96619E9 if x & 1 else 0)
        for x in state:
            x ^= x >> 29 & 0x5555555555555555
            x ^= x << 17 & 0x71D67FFFEDA60000
            x ^= x << 37 & 0xFFF7EEE000000000 & _MASK
            out.append((x ^ x >> 43) & _MASK)
    return out[:n]


@cache
def gear_table() -> np.ndarray:
    table = np.array(mt19937_64(GEAR_SEED, 256), np.uint64)
    if hashlib.sha256(table.astype("<u8").tobytes()).hexdigest() != GEAR_SHA256:
        raise AssertionError("the gear table is wrong")
    return table


def low_ones(n: int) -> int:
    return (1 << min(max(n, 0), 64)) - 1


def mask_bits(avg_size: int) -> tuple[int, int]:
    """Bits of the strict mask, before the average size, and of the loose one, behind it."""
    bits = avg_size.bit_length() - 1
    return bits + 2, bits - 2 if bits > 2 else 1
