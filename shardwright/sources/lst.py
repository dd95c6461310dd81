"""LST1 record files: codec in plain Python, and a Spark data source for reading and writing them.

A file is a header (magic, block multiplier, extension, optional metadata map) and blocks of 64 KiB times the
multiplier, counted from the end of the header.  A block holds physical records: masked CRC-32C, length, type; a
logical record is one of them, a part of an array record, or a chain of fragments.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.hashing import crc32c

MAGIC, BLOCK, HEAD = b"LST1\0", 65536, 9
FULL, FIRST, MIDDLE, ARRAY, LAST, COMPRESSED = 1, 2, 3, 4, 5, 0x10


class LstError(ValueError):
    """A damaged file under mode FAILFAST, or no LST file at all."""


def mask(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(b) or shift > 28:
            raise ValueError("varint")
        c = b[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


def lz4_block(src: bytes) -> bytes:
    """Decompress one LZ4 block (the public block format)."""
    out, at = bytearray(), 0

    def length(n):
        nonlocal at
        if n == 15:
            while True:
                n += src[at]
                at += 1
                if src[at - 1] != 255:
                    break
        return n

    while at < len(src):
        token = src[at]
        at += 1
        n = length(token >> 4)
        out += src[at : at + n]
        at += n
        if at >= len(src):
            break
        back = int.from_bytes(src[at : at + 2], "little")
        at += 2
        n = length(token & 15) + 4
        if not 0 < back <= len(out):
            raise ValueError("lz4 offset")
        for _ in range(-(-n // back)):
            piece = bytes(out[len(out) - back :])[:n]
            out += piece
            n -= len(piece)
            if not n:
                break
    return bytes(out)


def encode(records: Iterable[bytes], meta: dict[str, bytes] | None = None, multiplier: int = 1, compress: bool = False, level: int = 1) -> Iterator[bytes]:
    """The bytes of a file, in pieces; with compress, records that shrink by an eighth or more are stored by zlib."""
    head = MAGIC + bytes([multiplier, 1 if meta else 0])
    if meta:
        body = varint(len(meta)) + b"".join(varint(len(x)) + x for k, v in sorted(meta.items()) for x in (k.encode(), v if isinstance(v, bytes) else v.encode()))
        head += mask(crc32c(body)).to_bytes(4, "little") + len(body).to_bytes(4, "little") + body
    yield head
    size = BLOCK * multiplier
    left = size

    def physical(kind: int, data: bytes) -> bytes:
        nonlocal left
        if compress and len(data) > 64:
            packed = zlib.compress(data, level)
            if len(packed) < len(data) - len(data) // 8:
                kind, data = kind | COMPRESSED, b"\x02" + packed
        left -= HEAD + len(data)
        tail = bytes([kind]) + data
        return mask(crc32c(tail)).to_bytes(4, "little") + len(data).to_bytes(4, "little") + tail

    batch: list[bytes] = []
    room = 0

    def flush() -> bytes:
        if not batch:
            return b""
        data = varint(len(batch)) + b"".join(batch)
        batch.clear()
        return physical(ARRAY, data)

    for r in records:
        item = varint(len(r)) + r
        if batch:
            if len(item) <= room:
                batch.append(item)
                room -= len(item)
                continue
            yield flush()
        if left <= HEAD:
            yield bytes(left)
            left = size
        if len(item) + HEAD + 5 < left:
            batch.append(item)
            room = left - HEAD - 5 - len(item)
            continue
        if len(r) + HEAD <= left:
            yield physical(FULL, r)
            continue
        kind = FIRST
        while True:
            n = left - HEAD
            yield physical(kind if len(r) > n or kind == FIRST else LAST, r[:n])
            if kind != FIRST and len(r) <= n:
                break
            r, kind = r[n:], MIDDLE
            if left <= HEAD:
                yield bytes(left)
                left = size
    yield flush()


class Decoder:
    """Reads the bytes of one file; `dropped` tells of damage: [(bytes, reason)]."""

    def __init__(self, data: bytes, checksum: bool = True):
        self.data, self.checksum, self.dropped = data, checksum, []
        if data[:5] != MAGIC or len(data) < 7 or data[5] == 0:
            raise LstError("no LST1 header")
        self.size, self.meta, self.start = data[5] * BLOCK, {}, 7
        if data[6] == 1:
            crc, n = (int.from_bytes(data[k : k + 4], "little") for k in (7, 11))
            body = data[15 : 15 + n]
            if mask(crc32c(body)) != crc:
                raise LstError("metadata checksum")
            count, at = read_varint(body, 0)
            parts = []
            for _ in range(2 * count):
                k, at = read_varint(body, at)
                parts.append(body[at : at + k])
                at += k
            self.meta = {k.decode(): v for k, v in zip(parts[::2], parts[1::2], strict=True)}
            self.start = 15 + n

    def _drop(self, n: int, why: str):
        self.dropped.append((n, why))

    def _physical(self) -> Iterator[tuple[int, bytes]]:
        """(type, data) of each physical record; type 0 where something was lost."""
        for begin in range(self.start, len(self.data), self.size):
            at, end = begin, min(len(self.data), begin + self.size)
            while end - at > HEAD:
                crc, n, kind = int.from_bytes(self.data[at : at + 4], "little"), int.from_bytes(self.data[at + 4 : at + 8], "little"), self.data[at + 8]
                if n == 0 and kind == 0:
                    yield 0, b""
                    break
                if at + HEAD + n > end:
                    self._drop(end - at, "record length")
                    yield 0, b""
                    break
                data = self.data[at + HEAD : at + HEAD + n]
                if self.checksum and mask(crc32c(self.data[at + 8 : at + HEAD + n])) != crc:
                    self._drop(end - at, "checksum")
                    yield 0, b""
                    break
                at += HEAD + n
                if kind & COMPRESSED:
                    try:
                        data = zlib.decompress(data[1:]) if data[0] == 2 else lz4_block(data[1:]) if data[0] == 3 else None
                    except (zlib.error, ValueError, IndexError):
                        data = None
                    if data is None:
                        self._drop(n, "compression")
                        yield 0, b""
                        continue
                yield kind & 15, data
            else:
                if end == len(self.data) and 0 < end - at <= HEAD and end - begin < self.size:
                    self._drop(end - at, "truncated")

    def records(self) -> Iterator[bytes]:
        parts: list[bytes] | None = None
        for kind, data in self._physical():
            if kind in (FULL, FIRST, ARRAY) and parts is not None:
                self._drop(sum(map(len, parts)), "fragments without an end")
                parts = None
            if kind == FULL:
                yield data
            elif kind == FIRST:
                parts = [data]
            elif kind in (MIDDLE, LAST):
                if parts is None:
                    self._drop(len(data), "fragment without a start")
                    continue
                parts.append(data)
                if kind == LAST:
                    yield b"".join(parts)
                    parts = None
            elif kind == ARRAY:
                try:
                    count, at = read_varint(data, 0)
                    for _ in range(count):
                        n, at = read_varint(data, at)
                        if at + n > len(data):
                            raise ValueError("array")
                        yield data[at : at + n]
                        at += n
                except ValueError:
                    self._drop(len(data), "array record")
            else:
                if kind:
                    self._drop(len(data), "record type")
                if parts is not None:
                    self._drop(sum(map(len, parts)), "error inside a record")
                    parts = None
        if parts is not None:
            self._drop(sum(map(len, parts)), "fragments without an end")


class LstFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class LstSource(DataSource):
    """spark.read.format("lst").load(glob): record BINARY, file STRING, pos BIGINT.

    Options: mode FAILFAST (default) or DROPMALFORMED, checksum, skip (records of each file).  Writing: one file for
    each task, named part-<task>-<id>.lst; options compression (none or zlib) and meta.<key>.  Files lie on a path that
    driver and executors share; for other file systems read the bytes with read_lst(), which goes through Spark.
    """

    @classmethod
    def name(cls):
        return "lst"

    def schema(self):
        return "record binary, file string, pos bigint"

    def reader(self, schema):
        return LstReader(self.options)

    def writer(self, schema, overwrite):
        return LstWriter(self.options, overwrite)


class LstReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        import glob
        import os

        path = os.path.expanduser(self.options["path"].removeprefix("file://").removeprefix("file:"))
        found = sorted(p for p in (glob.glob(f"{path}/*.lst") if os.path.isdir(path) else glob.glob(path)) if os.path.isfile(p))
        return [LstFile(p) for p in sorted(found, key=os.path.getsize, reverse=True)]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            yield from decode_rows(f.read(), partition.path, self.options)


def decode_rows(data: bytes, path: str, options: dict):
    d = Decoder(data, str(options.get("checksum", "true")).lower() == "true")
    skip = int(options.get("skip", 0))
    for pos, r in enumerate(d.records()):
        if pos >= skip:
            yield (r, path, pos - skip)
        if d.dropped and options.get("mode", "FAILFAST").upper() == "FAILFAST":
            break
    if d.dropped and options.get("mode", "FAILFAST").upper() == "FAILFAST":
        raise LstError(f"{path}: {d.dropped[0]}")


class Written(WriterCommitMessage):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows


class LstWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.options, self.overwrite = dict(options), overwrite

    def write(self, iterator):
        import os
        import uuid

        from pyspark import TaskContext

        o = self.options
        root = o["path"].removeprefix("file://").removeprefix("file:")
        os.makedirs(root, exist_ok=True)
        path = f"{root}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.lst"
        n = 0

        def records():
            nonlocal n
            for row in iterator:
                n += 1
                v = row[0]
                yield bytes(v) if not isinstance(v, str) else v.encode()

        meta = {k[5:]: v for k, v in o.items() if k.startswith("meta.")}
        with open(path + ".tmp", "wb") as f:
            for piece in encode(records(), meta, compress=o.get("compression", "none") == "zlib"):
                f.write(piece)
        return Written(path, n)

    def commit(self, messages):
        import os

        for m in messages:
            if m is not None:
                os.replace(m.path + ".tmp", m.path)

    def abort(self, messages):
        import contextlib
        import os

        for m in messages:
            if m is not None:
                with contextlib.suppress(OSError):
                    os.remove(m.path + ".tmp")


def register(spark) -> None:
    spark.dataSource.register(LstSource)


def read_lst(spark, paths, mode: str = "FAILFAST", checksum: bool = True, skip: int = 0):
    """LST files on any file system that Spark reads: record, file, pos. One file is one task's unit of work."""
    options = {"mode": mode, "checksum": str(checksum), "skip": skip}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                for row in decode_rows(content, path, options):
                    rows.append(row)
                    size += len(row[0])
                    if len(rows) == 10_000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], kind)

    import pyarrow as pa

    names = ["record", "file", "pos"]
    kind = pa.schema([("record", pa.binary()), ("file", pa.string()), ("pos", pa.int64())])
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "record binary, file string, pos bigint")


def lst_metadata(spark, paths):
    """(file, key, value) of the files' headers."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(p, k, v) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, v in Decoder(c).meta.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())], ["file", "key", "value"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "file string, key string, value binary")
