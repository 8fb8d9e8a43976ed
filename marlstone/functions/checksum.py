"""A 64-bit checksum of blocks.

One step takes a byte b: the table's entry at (low byte of the sum) xor b, xor the sum moved up a byte. The
entry index depends on the indexes before it alone, and the table is linear over xor, so the indexes are
i[n] = xor over k of M^(n-k) b[k], where M maps a byte to the low byte of its entry. Powers of M repeat, so an
index is a numpy reduction over all bytes, and the sum is made of the last eight entries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Fixed value: the polynomial of ECMA-182.
POLYNOMIAL = 0x42F0E1EBA9EA3693
_MASK = (1 << 64) - 1


def _entry(byte: int) -> int:
    value = byte << 56
    for _ in range(8):
        value = (value << 1 ^ (POLYNOMIAL if value >> 63 else 0)) & _MASK
    return value


TABLE = [_entry(b) for b in range(256)]
_LOW = np.array([t & 0xFF for t in TABLE], dtype=np.uint8)


def _powers() -> np.ndarray:
    """_LOW applied 0, 1, 2... times, until it repeats."""
    rows, seen = [np.arange(256, dtype=np.uint8)], set()
    while rows[-1].tobytes() not in seen:
        seen.add(rows[-1].tobytes())
        rows.append(_LOW[rows[-1]])
    return np.array(rows[:-1])


_POWERS = _powers()


def plain(data: bytes, crc: int = 0) -> int:
    """The checksum byte by byte."""
    for b in data:
        crc = TABLE[(crc ^ b) & 0xFF] ^ (crc << 8 & _MASK)
    return crc


def checksum(data: bytes, crc: int = 0) -> int:
    """The checksum of data after that of what came before."""
    if len(data) <= 64 or not np.array_equal(_LOW[_POWERS[-1]], _POWERS[0]):
        return plain(data, crc)
    # The low byte of the sum before the last eight bytes is that of the entry at the index just before them.
    body = np.frombuffer(data, dtype=np.uint8, count=len(data) - 8)
    body = body.copy()
    body[0] ^= crc & 0xFF
    away = (len(body) - 1 - np.arange(len(body))) % len(_POWERS)
    index = int(np.bitwise_xor.reduce(_POWERS[away, body]))
    # Only the low byte of what came before reaches the sum: the rest has moved out of its 64 bits.
    return plain(data[-8:], TABLE[index])


def block_order(blocks: int, alternating: bool) -> Iterator[int]:
    """Numbers of the blocks: in order, or the first, the last, the second, the last but one and so on."""
    if not alternating:
        yield from range(blocks)
        return
    low, high = 0, blocks - 1
    while low <= high:
        yield low
        low += 1
        if low <= high:
            yield high
            high -= 1


def checksum_blocks(blocks: Iterable[bytes], size: int, crc: int = 0) -> tuple[int, int]:
    """Checksum and number of the blocks, each filled up with zero bytes."""
    count = 0
    for block in blocks:
        crc = checksum(block.ljust(size, b"\0"), crc)
        count += 1
    return crc, count
