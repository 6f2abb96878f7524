"""BGZF, the blocked gzip of alignment files: blocks, and bytes that know which block they come from."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow.fs as pafs

#: A block's fixed start (gzip with an extra field), and the empty block that ends a file. Fixed values of the format.
MAGIC = b"\x1f\x8b\x08\x04"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bytes of a block before compression, and the most that a block may have in all.
PAYLOAD, MOST = 0xFF00, 0x10000


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files(path: str, suffix: str) -> list[tuple[str, int]]:
    """Paths and sizes of a file, or of the files of a directory with that suffix, in order of name."""
    fs, inner = located(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pafs.FileSelector(inner)) if info.type == pafs.FileType.Directory else [info]
    stem = path[: len(path) - len(inner)]
    return sorted((stem + f.path, f.size) for f in found if f.is_file and (f is info or f.path.endswith(suffix)))


def opened(path: str) -> BinaryIO:
    fs, inner = located(path)
    return fs.open_input_file(inner)


def block(data: bytes) -> bytes:
    """A block of at most PAYLOAD bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    if len(body) > MOST - 26:  # what can't be compressed is stored
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
    return MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def block_size(data: bytes, at: int = 0) -> int:
    """The size of the block that begins at a place, 0 if none does."""
    if data[at : at + 4] != MAGIC or len(data) < at + 18:
        return 0
    (extra,) = struct.unpack_from("<H", data, at + 10)
    i, stop = at + 12, min(at + 12 + extra, len(data))
    while i + 4 <= stop:
        first, second, n = struct.unpack_from("<BBH", data, i)
        if (first, second, n) == (66, 67, 2) and i + 6 <= stop:
            return struct.unpack_from("<H", data, i + 4)[0] + 1
        i += 4 + n
    return 0


def first_block(f: BinaryIO, at: int, size: int) -> int:
    """Where the first block at or after a place of a file of that size begins; its size if there is none."""
    f.seek(at)
    data = f.read(3 * MOST)
    p = data.find(MAGIC)
    while p >= 0:
        n = block_size(data, p)
        # Another block, or the file's end, follows a true one.
        if n and (at + p + n == size or block_size(data, p + n)):
            return at + p
        p = data.find(MAGIC, p + 1)
    return size


def blocks(f: BinaryIO, at: int) -> Iterator[tuple[int, int, bytes]]:
    """Place, size and content of the blocks from a block's place on."""
    f.seek(at)
    held = b""
    while True:
        while (n := block_size(held)) == 0 or len(held) < n:
            if held and not n and len(held) >= MOST:
                raise ValueError(f"no block begins at byte {at}")
            more = f.read(1 << 20)
            if not more:
                if held:
                    raise ValueError(f"the block at byte {at} is cut short")
                return
            held += more
        (extra,) = struct.unpack_from("<H", held, 10)
        data = zlib.decompress(held[12 + extra : n - 8], -15)
        crc, length = struct.unpack_from("<II", held, n - 8)
        if len(data) != length or zlib.crc32(data) != crc:
            raise ValueError(f"the block at byte {at} is damaged")
        yield at, n, data
        held, at = held[n:], at + n


class Bytes:
    """The content of blocks from a place on, read as it is asked for."""

    def __init__(self, f: BinaryIO, at: int, skip: int = 0):
        self.source, self.data, self.begun = blocks(f, at), b"", []  # begun: place in data and in the file of each block
        self.dropped, self.at = 0, 0
        self.more()
        self.at = skip

    def more(self) -> bool:
        """Adds a block; False at the end."""
        for place, _, data in self.source:
            if self.at > 1 << 20:
                self.data, self.dropped = self.data[self.at :], self.dropped + self.at
                self.begun = [b for i, b in enumerate(self.begun) if i + 1 == len(self.begun) or self.begun[i + 1][0] > self.dropped]
                self.at = 0
            self.begun.append((self.dropped + len(self.data), place))
            self.data += data
            return True
        return False

    def has(self, n: int) -> bool:
        """Whether n bytes follow the present place."""
        while len(self.data) - self.at < n:
            if not self.more():
                return False
        return True

    def take(self, n: int) -> bytes:
        if not self.has(n):
            raise ValueError("the file ends within a record")
        self.at += n
        return self.data[self.at - n : self.at]

    def place(self) -> tuple[int, int]:
        """The place in the file of the block that the next byte lies in, and the byte's place in the block's content."""
        self.has(1)
        here = self.dropped + self.at
        begin, place = next((b for b in reversed(self.begun) if b[0] <= here), self.begun[0])
        return place, here - begin
