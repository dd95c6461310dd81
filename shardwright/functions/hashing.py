"""Stable hashes that don't depend on Spark's seeds: vectorised where the JVM has no equal."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FINGERPRINT_SEED = 24061983


def fingerprint_of(data: bytes) -> int:
    """XXH64 under the library's seed; 0 and 1 are reserved and become 2."""
    import xxhash

    h = xxhash.xxh64_intdigest(data, FINGERPRINT_SEED)
    return 2 if h < 2 else h


def murmur3_many(values: list[bytes], seed: int):
    """MurmurHash3 (x86, 32 bits) of many strings by its public definition: one array step for each four bytes of the longest."""
    import numpy as np

    u = np.uint32
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    order = np.argsort(-sizes, kind="stable")  # the strings that are not over yet come first
    words, rest = sizes[order] // 4, sizes[order] % 4
    joined = np.frombuffer(b"".join(values) + bytes(4), np.uint8)
    starts = (np.cumsum(sizes) - sizes)[order]
    h = np.full(len(values), seed & 0xFFFFFFFF, u)
    turn = lambda x, r: x << u(r) | x >> u(32 - r)
    mix = lambda k: turn(k * u(0xCC9E2D51), 15) * u(0x1B873593)
    word = lambda at: sum((joined[at + j].astype(u) << u(8 * j) for j in range(1, 4)), joined[at].astype(u))
    with np.errstate(over="ignore"):
        for k in range(int(words[0]) if len(words) else 0):
            n = int(np.searchsorted(-words, -k, side="left"))
            h[:n] = turn(h[:n] ^ mix(word(starts[:n] + 4 * k)), 13) * u(5) + u(0xE6546B64)
        tail = word(starts + 4 * words) & ((u(1) << (u(8) * rest.astype(u))) - u(1))
        h ^= np.where(rest > 0, mix(tail), u(0)) ^ sizes[order].astype(u)
        for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ h >> u(shift)) * u(by)
        h ^= h >> u(16)
    out = np.empty_like(h)
    out[order] = h
    return out


def murmur3(data: bytes, seed: int) -> int:
    """MurmurHash3 (x86, 32 bits), unsigned."""
    return int(murmur3_many([data], seed)[0])


def _bytes(v):
    return v.encode() if isinstance(v, str) else bytes(v)


def fingerprint(c: Column) -> Column:
    """XXH64 of a string under FINGERPRINT_SEED as a signed 64-bit number; null stays null."""

    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        out = [None if v is None else fingerprint_of(_bytes(v)) for v in s]
        return pd.Series([None if h is None else h - (1 << 64) if h >> 63 else h for h in out], dtype="Int64")

    return run(c)


def fingerprint32(c: Column) -> Column:
    """The upper half of the fingerprint XOR its lower half, as an unsigned number."""
    h = fingerprint(c)
    return F.shiftrightunsigned(h, 32).bitwiseXOR(h).bitwiseAND(F.lit(0xFFFFFFFF))


def murmur3_32(c: Column, seed: int = 10) -> Column:
    """MurmurHash3 (x86, 32 bits) of a string as an unsigned number; null stays null."""

    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        out = pd.Series(murmur3_many([b"" if v is None else _bytes(v) for v in s], seed).astype("int64"), dtype="Int64", index=s.index)
        out[s.isna()] = pd.NA
        return out

    return run(c)


def xxh3_shard(c: Column, n: int) -> Column:
    """XXH3 (64 bits) of a line modulo n."""

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        import xxhash

        return pd.Series([None if v is None else xxhash.xxh3_64_intdigest(_bytes(v)) % n for v in s], dtype="Int32")

    return run(c)


#: Bytes of a row of crc32c()'s table of the data.
_ROW = 64


def crc32c(data: bytes, crc: int = 0) -> int:
    """CRC-32C (Castagnoli): rows of 64 bytes go through the byte table side by side, then neighbours are joined pair by pair.

    The sum is linear: the sum of two rows is that of the first, carried over the second's bytes, XOR that of the second.
    """
    import numpy as np

    table = _crc_table()
    rows = len(data) // _ROW
    crc ^= 0xFFFFFFFF
    if rows > 1:
        block = np.frombuffer(data, np.uint8, rows * _ROW).reshape(rows, _ROW)
        c = np.zeros(rows, np.uint32)
        c[0] = crc
        for k in range(_ROW):
            c = table[(c ^ block[:, k]) & 0xFF] ^ c >> np.uint32(8)
        step = 0
        while len(c) > 1:
            if len(c) % 2:  # rows of zeros in front change nothing
                c = np.concatenate([np.zeros(1, np.uint32), c])
            c = _carried(c[0::2], step) ^ c[1::2]
            step += 1
        crc, data = int(c[0]), data[rows * _ROW :]
    for b in data:
        crc = int(table[(crc ^ b) & 0xFF]) ^ crc >> 8
    return crc ^ 0xFFFFFFFF


_TABLES: dict = {}


def _crc_table():
    import numpy as np

    if "byte" not in _TABLES:
        t = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            t = np.where(t & 1, t >> np.uint32(1) ^ np.uint32(0x82F63B78), t >> np.uint32(1))
        _TABLES["byte"] = t
    return _TABLES["byte"]


def _carried(c, step: int):
    """Sums carried over _ROW * 2**step zero bytes: four tables, one for each byte of a sum, made by squaring."""
    import numpy as np

    if step not in _TABLES:
        if step:
            one = np.uint32(1) << np.arange(32, dtype=np.uint32)
            bits = _carried(_carried(one, step - 1), step - 1)
        else:
            bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
            for _ in range(_ROW):
                bits = _crc_table()[bits & 0xFF] ^ bits >> np.uint32(8)
        n = np.arange(256, dtype=np.uint32)
        _TABLES[step] = [np.bitwise_xor.reduce(np.where(n[:, None] >> np.arange(8, dtype=np.uint32) & 1, bits[8 * j : 8 * j + 8], np.uint32(0)), axis=1) for j in range(4)]
    t = _TABLES[step]
    return t[0][c & 0xFF] ^ t[1][c >> np.uint32(8) & 0xFF] ^ t[2][c >> np.uint32(16) & 0xFF] ^ t[3][c >> np.uint32(24)]


def xxh64_of(*columns, seed: int = FINGERPRINT_SEED) -> Column:
    """XXH64 of a tuple: each value's bytes (numbers as 8 little-endian bytes, strings as UTF-8), the sum of one being the seed of the next; null if any is null."""

    def run(*series: pd.Series) -> pd.Series:
        import struct

        import xxhash

        def one(values):
            h = seed
            for v in values:
                if v is None or v != v:
                    return None
                data = v.encode() if isinstance(v, str) else bytes(v) if isinstance(v, (bytes, bytearray)) else struct.pack("<d", v) if isinstance(v, float) else struct.pack("<q", int(v))
                h = xxhash.xxh64_intdigest(data, h)
            return h - (1 << 64) if h >> 63 else h

        return pd.Series([one(v) for v in zip(*(x.astype(object) for x in series), strict=True)], dtype="Int64")

    return F.pandas_udf(run, "bigint", functionType=200)(*columns)
