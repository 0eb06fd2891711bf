"""Codecs and digests of binary columns: zlib, lzma, zstd, bit shuffle, SHA-512, SHAKE."""

from __future__ import annotations

import hashlib
import lzma
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rows import packed_rows

#: A decoded value may have so many bytes at most, unless the caller says otherwise.
MOST_BYTES = 1 << 30


def _limited(raw: bytes, most: int, step: Callable[[bytes, int], bytes], name: str) -> bytes:
    out = step(raw, most + 1)
    if len(out) > most:
        raise ValueError(f"{name}: more than {most} bytes")
    return out


def _inflate(raw: bytes, most: int) -> bytes:
    d = zlib.decompressobj()
    out = d.decompress(raw, most)
    if not d.eof and len(out) < most:
        raise ValueError("zlib: cut short")
    return out


def _unlzma(raw: bytes, most: int) -> bytes:
    d = lzma.LZMADecompressor()
    out = d.decompress(raw, most)
    if not d.eof and len(out) < most:
        raise ValueError("lzma: cut short")
    return out


def _unzstd(raw: bytes, most: int) -> bytes:
    with zstandard.ZstdDecompressor().stream_reader(raw) as r:
        return r.read(most)


ENCODERS: dict[str, Callable[[bytes], bytes]] = {
    "none": bytes,
    "zlib": lambda b: zlib.compress(b, 6),
    "lzma": lambda b: lzma.compress(b, preset=6),
    "zstd": lambda b: zstandard.ZstdCompressor(level=3).compress(b),
}
DECODERS: dict[str, Callable[[bytes, int], bytes]] = {"none": lambda b, most: b, "zlib": _inflate, "lzma": _unlzma, "zstd": _unzstd}


def _each(f: Callable[[bytes], bytes]):
    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        return packed_rows(column, lambda x: f(x.as_py()), pa.binary())

    return run


def _known(name: str) -> str:
    if name not in ENCODERS:
        raise ValueError(f"no codec {name!r}")
    return name


def encode(column: Column, codec: str) -> Column:
    f = ENCODERS[_known(codec)]
    return _each(f)(column.cast("binary"))


def decode(column: Column, codec: str, most: int = MOST_BYTES) -> Column:
    """The bytes that were encoded; more than ``most`` of them are an error."""
    step = DECODERS[_known(codec)]
    return _each(lambda b: _limited(b, most, step, codec))(column.cast("binary"))


def shuffle_bits(raw: bytes, width: int) -> bytes:
    """All first bits of ``width``-byte elements, then all second bits, and so on; a rest stays as it is."""
    n = len(raw) // width // 8 * 8
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, n * width).reshape(n, width), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=None, bitorder="little").tobytes() + raw[n * width :]


def unshuffle_bits(raw: bytes, width: int) -> bytes:
    n = len(raw) // width // 8 * 8
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, n * width), bitorder="little").reshape(8 * width, n)
    return np.packbits(bits.T, axis=None, bitorder="little").tobytes() + raw[n * width :]


def bitshuffle(column: Column, width: int, back: bool = False) -> Column:
    """Bits of equal weight brought together, which codecs pack better; ``back`` undoes it."""
    f = unshuffle_bits if back else shuffle_bits
    return _each(lambda b: f(b, width))(column.cast("binary"))


def sha512(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 512)


def shake(column: Column, length: int = 32, bits: int = 256) -> Column:
    """SHAKE-128 or SHAKE-256 of ``length`` bytes, in hex."""
    make = {128: hashlib.shake_128, 256: hashlib.shake_256}[bits]

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else make(x).hexdigest(length) for x in values.to_pylist()], pa.string())

    return run(column.cast("binary"))
