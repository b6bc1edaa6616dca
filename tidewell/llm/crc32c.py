"""CRC-32C of many byte strings at once: strings are cut into blocks, all blocks go through tables side by side, and blocks meet pairwise.

The checksum without start value and end mask is linear over bits: leading zeros don't change it, and that of two strings
back to back is the first one's, carried over as many zero bytes as the second has, xor the second one's.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The Castagnoli polynomial (bits reversed), and what a stored checksum is turned and raised by.
POLYNOMIAL = 0x82F63B78
TURN, RAISE = 15, 0xA282EAD8
BLOCK = 512  # bytes
#: Blocks that go through the tables side by side.
LANES = 1 << 13


def _apply(images: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The linear map that takes bit i to images[i]."""
    out = np.zeros_like(x)
    for i in range(32):
        out ^= np.where(x >> np.uint32(i) & np.uint32(1), images[i], np.uint32(0))
    return out


@lru_cache(maxsize=64)
def _images(doublings: int) -> np.ndarray:
    """What 2^doublings zero bytes make of each bit of a checksum."""
    if doublings:
        half = _images(doublings - 1)
        return _apply(half, half)
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        bits = np.where(bits & np.uint32(1), (bits >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), bits >> np.uint32(1))
    return bits


@lru_cache(maxsize=64)
def _tables(doublings: int) -> tuple[np.ndarray, np.ndarray]:
    """The same map as two tables, of the low and the high half."""
    out, images = [], _images(doublings)
    for half in (images[:16], images[16:]):
        t = np.zeros(1 << 16, np.uint32)
        for i, image in enumerate(half):
            t[1 << i : 2 << i] = t[: 1 << i] ^ image
        out.append(t)
    return out[0], out[1]


def _carried(c: np.ndarray, doublings: int) -> np.ndarray:
    low, high = _tables(doublings)
    return low[c & np.uint32(0xFFFF)] ^ high[c >> np.uint32(16)]


def _short(x: bytes) -> int:
    c = 0xFFFFFFFF
    for byte in x:
        c ^= byte
        for _ in range(8):
            c = c >> 1 ^ (POLYNOMIAL if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def checksums(strings: list[bytes]) -> np.ndarray:
    """The CRC-32C of each string."""
    n = np.array([len(x) for x in strings], np.int64)
    left = np.where(n < 4, 0, -(-n // BLOCK))  # shorter ones can't take the start value into their first bytes
    ends = np.cumsum(left) * BLOCK
    padded = np.zeros(int(left.sum()) * BLOCK, np.uint8)
    for x, size, end in zip(strings, n.tolist(), ends.tolist(), strict=True):
        if size >= 4:
            padded[end - size : end] = np.frombuffer(x, np.uint8)
            padded[end - size : end - size + 4] ^= 0xFF
    words = padded.view("<u4").reshape(-1, BLOCK // 4)
    c = np.zeros(len(words), np.uint32)
    for a in range(0, len(words), LANES):
        lanes = np.ascontiguousarray(words[a : a + LANES].T)
        own = np.zeros(lanes.shape[1], np.uint32)
        for step in lanes:
            own = _carried(own ^ step, 2)
        c[a : a + LANES] = own
    doublings = BLOCK.bit_length() - 1
    while left.max(initial=0) > 1:
        even = left + left % 2
        spread = np.zeros(int(even.sum()), np.uint32)
        spread[np.arange(len(c)) + np.repeat(np.cumsum(left % 2), left)] = c  # a zero in front of an odd number of blocks
        c, left = _carried(spread[::2], doublings) ^ spread[1::2], even // 2
        doublings += 1
    out = np.zeros(len(strings), np.uint32)
    out[left > 0] = c ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(n < 4):
        out[i] = _short(strings[i])
    return out


def masked(c: np.ndarray) -> np.ndarray:
    """Checksums as they are stored beside the data that they cover."""
    return (c >> np.uint32(TURN) | c << np.uint32(32 - TURN)) + np.uint32(RAISE)
