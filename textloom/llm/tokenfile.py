"""A sorted-string-table file: keys in order, prefix-compressed blocks, sparse index, Bloom filter, footer.

    magic | block ... block | bloom | index | footer
    block   entries, then their crc32. entry: varints shared, unshared, bytes of value; key suffix; value
    index   per block: first key, offset, length, entries, tokens (varints; keys with their length)
    footer  offsets and lengths of bloom and index, hashes, width of a token, entries, tokens, magic
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np

MAGIC = b"TLSST001"
FOOTER = "<QQQQIIQQ8s"
BLOCK_BYTES = 1 << 16
BITS_PER_KEY, HASHES = 10, 7


def key_bytes(key: int | None) -> bytes:
    """Bytes in the order of the keys; null is first."""
    return b"\x00" if key is None else b"\x01" + struct.pack(">Q", key + (1 << 63))


def key_value(raw: bytes) -> int | None:
    return struct.unpack(">Q", raw[1:])[0] - (1 << 63) if raw[:1] == b"\x01" else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return n, at


def two_hashes(key: bytes) -> tuple[int, int]:
    """Of 62 bits, so that sums of HASHES of them stay within 64 bits once they are reduced."""
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return a >> 2, b >> 2


def places(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """The bits of keys with these hashes, a row for each of HASHES."""
    return (a % bits + np.arange(HASHES, dtype=np.uint64)[:, None] * (b % bits)) % bits


class Writer:
    """Writes entries that come in the order of their keys to a binary stream. It holds one block, and of every distinct
    key so far 16 bytes for the Bloom filter."""

    def __init__(self, stream, width: int):
        self.out, self.width, self.at = stream, width, len(MAGIC)
        self.block, self.first, self.last, self.held = bytearray(), b"", b"", [0, 0]
        self.index, self.entries, self.tokens = bytearray(), 0, 0
        self.hashes = array("Q")
        stream.write(MAGIC)

    def add(self, key: bytes, value: bytes) -> None:
        if self.block and len(self.block) >= BLOCK_BYTES:
            self.end_block()
        shared = 0
        if self.block:
            shared = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        else:
            self.first = key
        if key != self.last or not self.entries:
            self.hashes.extend(two_hashes(key))
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:]
        self.block += value
        self.last = key
        self.held[0] += 1
        self.held[1] += len(value) // self.width
        self.entries += 1
        self.tokens += len(value) // self.width

    def end_block(self) -> None:
        self.block += struct.pack("<I", zlib.crc32(self.block))
        self.out.write(self.block)
        self.index += varint(len(self.first)) + self.first + varint(self.at) + varint(len(self.block)) + varint(self.held[0]) + varint(self.held[1])
        self.at += len(self.block)
        self.block, self.held = bytearray(), [0, 0]

    def close(self) -> None:
        if self.block:
            self.end_block()
        pairs = np.frombuffer(self.hashes, np.uint64).reshape(-1, 2)
        bits = max(64, BITS_PER_KEY * len(pairs))
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for at in range(0, len(pairs), 1 << 16):
            spots = places(pairs[at : at + (1 << 16), 0], pairs[at : at + (1 << 16), 1], bits).ravel()
            np.bitwise_or.at(bloom, (spots >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (spots & np.uint64(7)).astype(np.uint8))
        packed = struct.pack("<Q", bits) + bloom.tobytes()
        self.out.write(packed)
        self.out.write(bytes(self.index))
        after = self.at + len(packed)
        self.out.write(struct.pack(FOOTER, self.at, len(packed), after, len(self.index), HASHES, self.width, self.entries, self.tokens, MAGIC))


class Reader:
    """Reads a file that offers seek() and read(); keeps index and Bloom filter, reads blocks as needed."""

    def __init__(self, stream, size: int):
        self.file = stream
        *where, _, self.width, self.entries, self.tokens, magic = struct.unpack(FOOTER, self.part(size - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError("not a token file")
        bloom = self.part(where[0], where[1])
        self.bits = struct.unpack("<Q", bloom[:8])[0]
        self.bloom = bloom[8:]
        raw, at = self.part(where[2], where[3]), 0
        self.firsts: list[bytes] = []
        self.blocks: list[tuple[int, int, int]] = []  # offset, length, tokens before
        before = 0
        while at < len(raw):
            n, at = read_varint(raw, at)
            self.firsts.append(raw[at : at + n])
            at += n
            offset, at = read_varint(raw, at)
            length, at = read_varint(raw, at)
            _, at = read_varint(raw, at)
            tokens, at = read_varint(raw, at)
            self.blocks.append((offset, length, before))
            before += tokens

    def part(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def block(self, i: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, tokens before it in this file, ids) of a block."""
        offset, length, before = self.blocks[i]
        data = self.part(offset, length)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        at, key, end = 0, b"", len(data) - 4
        while at < end:
            shared, at = read_varint(data, at)
            own, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            ids = np.frombuffer(data, f"<u{self.width}", size // self.width, at)
            yield key, before, ids
            at, before = at + size, before + len(ids)

    def __iter__(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every entry of the key: Bloom filter, binary search in the index, then its blocks."""
        a, b = two_hashes(key)
        spots = places(np.array([a], np.uint64), np.array([b], np.uint64), self.bits).ravel().tolist()
        if not all(self.bloom[x >> 3] & 128 >> (x & 7) for x in spots):
            return []
        found, i = [], max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.firsts) and self.firsts[i] <= key:
            found += [ids for k, _, ids in self.block(i) if k == key]
            i += 1
        return found
