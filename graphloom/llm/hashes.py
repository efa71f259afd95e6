"""XXH64 and CRC-32 of many short pieces of one buffer at once, and their comparison byte by byte, in numpy."""

from __future__ import annotations

import zlib

import numpy as np
import xxhash

#: Fixed values of the published algorithm.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: The low n bytes of a word.
LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def words_at(flat: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit word that begins at each byte; zeros follow the last one."""
    padded = np.zeros(len(flat) + 8, np.uint8)
    padded[: len(flat)] = flat
    return np.ndarray((len(flat) + 1,), "<u8", padded.data, strides=(1,)).copy()


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(flat: np.ndarray, lanes: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """Of flat[start : start + length] for each piece; pieces of 32 bytes and more, which are few, go to the library."""
    out = np.empty(len(start), np.uint64)
    big = length >= 32
    if big.any():
        which, view = np.flatnonzero(big), memoryview(flat)
        out[which] = [xxhash.xxh64_intdigest(view[a : a + n], seed) for a, n in zip(start[which].tolist(), length[which].tolist(), strict=True)]
    order = np.flatnonzero(~big)
    order = order[np.argsort(-length[order].astype(np.int8), kind="stable")]  # longest first, so that each step is a slice
    at, left = start[order], length[order]
    h = left.astype(np.uint64) + np.uint64((seed + int(P5)) & (2**64 - 1))
    whole = left >> 3
    for j in range(int(whole[0]) if len(whole) else 0):
        n = int(np.searchsorted(-whole, -j, "left"))
        k = _turn(lanes[at[:n] + 8 * j] * P2, 31) * P1
        h[:n] = _turn(h[:n] ^ k, 27) * P1 + P4
    at, rest = at + 8 * whole, left & 7
    tail = lanes[at]
    half = np.flatnonzero(rest >= 4)
    h[half] = _turn(h[half] ^ ((tail[half] & LOW[4]) * P1), 23) * P2 + P3
    tail[half] >>= np.uint64(32)
    rest &= 3
    for j in range(3):
        more = np.flatnonzero(rest > j)
        h[more] = _turn(h[more] ^ (((tail[more] >> np.uint64(8 * j)) & LOW[1]) * P5), 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    out[order] = h ^ (h >> np.uint64(32))
    return out


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (c & np.uint32(1)))
    return c


CRC = _crc_table()


def crc32(flat: np.ndarray, start: np.ndarray, length: np.ndarray, long: int = 64) -> np.ndarray:
    """Of flat[start : start + length] for each piece; pieces of over `long` bytes go to the library."""
    out = np.empty(len(start), np.int64)
    order = np.argsort(-length, kind="stable")
    big = int(np.searchsorted(-length[order], -long, "left"))
    view = memoryview(flat)
    out[order[:big]] = [zlib.crc32(view[a : a + n]) for a, n in zip(start[order[:big]].tolist(), length[order[:big]].tolist(), strict=True)]
    order = order[big:]
    at, size = start[order], length[order]
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, "left"))
        c[:n] = CRC[(c[:n] ^ flat[at[:n] + j]) & 255] ^ (c[:n] >> np.uint32(8))
    out[order] = ~c
    return out


def same_bytes(flat: np.ndarray, lanes: np.ndarray, a: np.ndarray, a_length: np.ndarray, b: np.ndarray, b_length: np.ndarray) -> np.ndarray:
    """Whether the pieces at a and at b are equal, each with its neighbour in the other array."""
    same = a_length == b_length
    todo = np.flatnonzero(same)
    j = 0
    while len(todo) and j < 8:
        here = np.minimum(a_length[todo] - 8 * j, 8)
        same[todo] = ((lanes[a[todo] + 8 * j] ^ lanes[b[todo] + 8 * j]) & LOW[here]) == 0
        j += 1
        todo = todo[same[todo] & (a_length[todo] > 8 * j)]
    for i in todo.tolist():  # over 64 bytes
        n = int(a_length[i])
        same[i] = np.array_equal(flat[a[i] : a[i] + n], flat[b[i] : b[i] + n])
    return same
