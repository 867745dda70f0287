"""Sorted-string-table files of binary values, read and written through any pyarrow file system.

Layout of a file, integers little-endian unless said otherwise:

    blocks   entries (varint shared key bytes, varint new key bytes, varint value bytes, key rest, value), then the
             u32 offset of every RESTART-th entry, whose key is whole, then their u32 count
    index    per block: u32 key length, first key, u64 offset, u32 length, u32 crc32
    bloom    bits for double hashing of all keys
    footer   FOOTER: index offset and length, bloom offset and length, entries, value bytes, magic

Keys sort as bytes. Equal keys may stand side by side; get() returns all their values.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Iterator

from pyarrow import fs as pafs

MAGIC = b"NSSTBL01"
FOOTER = struct.Struct("<QQQQQQ8s")
RESTART = 16
BLOCK_BYTES = 64 * 1024
BLOOM_BITS, BLOOM_HASHES = 10, 7


def id_key(doc_id: int | None) -> bytes:
    """Sorts as the number does; null before all."""
    return bytes(9) if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def key_id(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _hashes(key: bytes) -> tuple[int, int]:
    digest = hashlib.blake2b(key, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little") | 1


class Writer:
    """Takes entries in key order; close() makes the file visible under its name in one move."""

    def __init__(self, path: str, attempt: str):
        self.fs, self.path = pafs.FileSystem.from_uri(path)
        self.partial = f"{self.path}.{attempt}.partial"
        self.out = self.fs.open_output_stream(self.partial)
        self.index, self.hashes = [], []
        self.offset = self.value_bytes = self.entries = 0
        self._open_block()

    def _open_block(self) -> None:
        self.block, self.restarts, self.first, self.last, self.in_block = bytearray(), [], b"", b"", 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.in_block % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        if not self.in_block:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.in_block += 1
        self.entries += 1
        self.value_bytes += len(value)
        self.hashes.append(_hashes(key))
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        if not self.in_block:
            return
        self.block += struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        self.out.write(bytes(self.block))
        self.index.append((self.first, self.offset, len(self.block), zlib.crc32(self.block)))
        self.offset += len(self.block)
        self._open_block()

    def close(self) -> None:
        self._close_block()
        index = b"".join(struct.pack("<I", len(k)) + k + struct.pack("<QII", *rest) for k, *rest in self.index)
        bits = max(64, BLOOM_BITS * len(self.hashes))
        bloom = bytearray(-(-bits // 8))
        for a, b in self.hashes:
            for i in range(BLOOM_HASHES):
                at = (a + i * b) % bits
                bloom[at >> 3] |= 1 << (at & 7)
        tail = struct.pack("<Q", bits) + bytes(bloom)
        self.out.write(index + tail + FOOTER.pack(self.offset, len(index), self.offset + len(index), len(tail), self.entries, self.value_bytes, MAGIC))
        self.out.close()
        self.fs.move(self.partial, self.path)


class Reader:
    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        index_at, index_n, bloom_at, bloom_n, self.entries, self.value_bytes, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no sorted-string table")
        raw, at, self.index = self.file.read_at(index_n, index_at), 0, []
        while at < len(raw):
            n = struct.unpack_from("<I", raw, at)[0]
            self.index.append((raw[at + 4 : at + 4 + n], *struct.unpack_from("<QII", raw, at + 4 + n)))
            at += 20 + n
        self.firsts = [x[0] for x in self.index]
        tail = self.file.read_at(bloom_n, bloom_at)
        self.bits, self.bloom = struct.unpack_from("<Q", tail)[0], tail[8:]

    def may_hold(self, key: bytes) -> bool:
        a, b = _hashes(key)
        return all(self.bloom[(x := (a + i * b) % self.bits) >> 3] >> (x & 7) & 1 for i in range(BLOOM_HASHES))

    def _block(self, i: int) -> bytes:
        _, offset, length, crc = self.index[i]
        data = self.file.read_at(length, offset)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {i} is damaged")
        return data

    @staticmethod
    def _entries(data: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        end = len(data) - 4 - 4 * struct.unpack_from("<I", data, len(data) - 4)[0]
        key = b""
        while at < end:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def get(self, key: bytes) -> list[bytes]:
        """Values of a key: Bloom filter, then binary search in the index, then among a block's restarts."""
        if not self.may_hold(key):
            return []
        found, i = [], max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.index) and self.firsts[i] <= key:
            data = self._block(i)
            n = struct.unpack_from("<I", data, len(data) - 4)[0]
            restarts = struct.unpack_from(f"<{n}I", data, len(data) - 4 - 4 * n)
            from_ = bisect.bisect_left(restarts, key, key=lambda at: next(self._entries(data, at))[0])
            for k, value in self._entries(data, restarts[max(0, from_ - 1)]):
                if k > key:
                    break
                if k == key:
                    found.append(value)
            i += 1
        return found

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self._entries(self._block(i), 0)

    def close(self) -> None:
        self.file.close()
