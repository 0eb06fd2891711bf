"""GGUF files: header, metadata, and block formats.

Blocks decode by NumPy views; the layouts are the format's own.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np

_SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, form: str):
        n = struct.calcsize("<" + form)
        out = struct.unpack_from("<" + form, self.raw, self.at)[0]
        self.at += n
        return out

    def text(self) -> str:
        n = self.take("Q")
        self.at += n
        return bytes(self.raw[self.at - n : self.at]).decode()

    def value(self, kind: int) -> Any:
        if kind in _SCALARS:
            return self.take(_SCALARS[kind])
        if kind == 8:
            return self.text()
        if kind == 9:
            inner, n = self.take("I"), self.take("Q")
            return [self.value(inner) for _ in range(n)]
        raise ValueError(f"metadata type {kind}")


def _half(block: np.ndarray, at: int) -> np.ndarray:
    return block[:, at : at + 2].copy().view("<f2").astype(float)


def _nibbles(q: np.ndarray) -> np.ndarray:
    return np.concatenate([q & 15, q >> 4], axis=1).astype(float)


def _q4_0(b: np.ndarray) -> np.ndarray:
    return (_nibbles(b[:, 2:18]) - 8) * _half(b, 0)


def _q4_1(b: np.ndarray) -> np.ndarray:
    return _nibbles(b[:, 4:20]) * _half(b, 0) + _half(b, 2)


def _fifth(b: np.ndarray, at: int) -> np.ndarray:
    return np.unpackbits(b[:, at : at + 4], axis=1, bitorder="little").astype(float) * 16


def _q5_0(b: np.ndarray) -> np.ndarray:
    return (_nibbles(b[:, 6:22]) + _fifth(b, 2) - 16) * _half(b, 0)


def _q5_1(b: np.ndarray) -> np.ndarray:
    return (_nibbles(b[:, 8:24]) + _fifth(b, 4)) * _half(b, 0) + _half(b, 2)


def _q8_0(b: np.ndarray) -> np.ndarray:
    return b[:, 2:34].view(np.int8).astype(float) * _half(b, 0)


def _q8_1(b: np.ndarray) -> np.ndarray:
    return b[:, 4:36].view(np.int8).astype(float) * _half(b, 0)


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(x, n, axis=1)


def _pairs(b: np.ndarray) -> np.ndarray:
    """Two-bit fields of 64 bytes, in the order that 256 values take."""
    q = b.reshape(len(b), 2, 1, 32) >> np.array([0, 2, 4, 6], dtype=np.uint8).reshape(1, 1, 4, 1)
    return (q & 3).reshape(len(b), 256)


def _q2_k(b: np.ndarray) -> np.ndarray:
    s = b[:, :16]
    return _half(b, 80) * _spread((s & 15).astype(float), 16) * _pairs(b[:, 16:80]) - _half(b, 82) * _spread((s >> 4).astype(float), 16)


def _q3_k(b: np.ndarray) -> np.ndarray:
    high = b[:, :32].reshape(len(b), 1, 32) >> np.arange(8, dtype=np.uint8).reshape(1, 8, 1)
    high = (high & 1).reshape(len(b), 256).astype(float)
    raw = b[:, 96:108]
    low = np.concatenate([raw[:, :8] & 15, raw[:, :8] >> 4], axis=1)
    top = np.concatenate([(raw[:, 8:12] >> k) & 3 for k in (0, 2, 4, 6)], axis=1)
    s = (low | (top << 4)).astype(float) - 32
    return _half(b, 108) * _spread(s, 16) * (_pairs(b[:, 32:96]) + 4 * high - 4)


def _scales_k(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight six-bit scales and minima from twelve bytes."""
    a, m, t = raw[:, 0:4], raw[:, 4:8], raw[:, 8:12]
    s = np.concatenate([a & 63, (t & 15) | ((a >> 6) << 4)], axis=1)
    n = np.concatenate([m & 63, (t >> 4) | ((m >> 6) << 4)], axis=1)
    return s.astype(float), n.astype(float)


def _halves(q: np.ndarray) -> np.ndarray:
    """Nibbles of 128 bytes: of each 32 bytes the low ones, then the high ones."""
    q = q.reshape(len(q), 4, 32)
    return np.stack([q & 15, q >> 4], axis=2).reshape(len(q), 256).astype(float)


def _q4_k(b: np.ndarray) -> np.ndarray:
    s, m = _scales_k(b[:, 4:16])
    return _half(b, 0) * _spread(s, 32) * _halves(b[:, 16:144]) - _half(b, 2) * _spread(m, 32)


def _q5_k(b: np.ndarray) -> np.ndarray:
    s, m = _scales_k(b[:, 4:16])
    high = (b[:, 16:48].reshape(len(b), 1, 32) >> np.arange(8, dtype=np.uint8).reshape(1, 8, 1)) & 1
    q = _halves(b[:, 48:176]) + 16.0 * high.reshape(len(b), 256)
    return _half(b, 0) * _spread(s, 32) * q - _half(b, 2) * _spread(m, 32)


def _q6_k(b: np.ndarray) -> np.ndarray:
    low = b[:, :128].reshape(len(b), 2, 64)
    low = np.concatenate([low & 15, low >> 4], axis=2)
    high = b[:, 128:192].reshape(len(b), 2, 1, 32) >> np.array([0, 2, 4, 6], dtype=np.uint8).reshape(1, 1, 4, 1)
    q = (low | ((high & 3) << 4).reshape(len(b), 2, 128)).reshape(len(b), 256).astype(float) - 32
    return _half(b, 208) * _spread(b[:, 192:208].view(np.int8).astype(float), 16) * q


#: Code: (name, values of a block, bytes of a block, decoder).
BLOCKS: dict[int, tuple[str, int, int, Callable[[np.ndarray], np.ndarray]]] = {
    2: ("q4_0", 32, 18, _q4_0),
    3: ("q4_1", 32, 20, _q4_1),
    6: ("q5_0", 32, 22, _q5_0),
    7: ("q5_1", 32, 24, _q5_1),
    8: ("q8_0", 32, 34, _q8_0),
    9: ("q8_1", 32, 36, _q8_1),
    10: ("q2_k", 256, 84, _q2_k),
    11: ("q3_k", 256, 110, _q3_k),
    12: ("q4_k", 256, 144, _q4_k),
    13: ("q5_k", 256, 176, _q5_k),
    14: ("q6_k", 256, 210, _q6_k),
}
DENSE = {0: ("f32", "<f4"), 1: ("f16", "<f2"), 24: ("i8", "i1"), 25: ("i16", "<i2"), 26: ("i32", "<i4"), 27: ("i64", "<i8"), 28: ("f64", "<f8"), 30: ("bf16", "bf16")}


def dequantize(raw: bytes, code: int, n: int) -> np.ndarray:
    """The values of packed blocks; formats without a decoder are refused."""
    if code not in BLOCKS:
        raise ValueError(f"block format {code} is refused")
    _, per, width, f = BLOCKS[code]
    if n % per:
        raise ValueError(f"{n} values in blocks of {per}")
    return f(np.frombuffer(raw, np.uint8, n // per * width).reshape(-1, width)).ravel()


def parse(raw: bytes) -> Iterator[tuple[str, tuple[int, ...], str, np.ndarray]]:
    """Name, shape, type and values of each tensor."""
    r = _Reader(raw)
    if bytes(raw[:4]) != b"GGUF":
        raise ValueError("no GGUF file")
    r.at = 4
    if r.take("I") not in (2, 3):
        raise ValueError("version")
    tensors, entries = r.take("Q"), r.take("Q")
    meta = {}
    for _ in range(entries):
        key = r.text()
        meta[key] = r.value(r.take("I"))
    infos = []
    for _ in range(tensors):
        name = r.text()
        dims = [r.take("Q") for _ in range(r.take("I"))]
        infos.append((name, tuple(reversed(dims)), r.take("I"), r.take("Q")))
    align = meta.get("general.alignment", 32)
    base = -(-r.at // align) * align
    for name, shape, code, offset in infos:
        n = int(np.prod(shape, dtype=np.int64))
        if code in DENSE:
            label, kind = DENSE[code]
            width = 2 if kind == "bf16" else np.dtype(kind).itemsize
            part = raw[base + offset : base + offset + n * width]
            values = (np.frombuffer(part, "<u2").astype(np.uint32) << 16).view(np.float32).astype(float) if kind == "bf16" else np.frombuffer(part, kind).astype(float, copy=False)
        else:
            if code not in BLOCKS:
                raise ValueError(f"{name}: block format {code} is refused")
            label, per, width, _ = BLOCKS[code]
            values = dequantize(raw[base + offset : base + offset + n // per * width], code, n)
        yield name, shape, label, values


def head(shapes: dict[str, Sequence[int]], metadata: dict[str, str] | None = None) -> bytes:
    """All of a version 3 file of f32 tensors before its data; each tensor's data is padded to 32 bytes."""
    out, at = b"", 0
    meta = metadata or {}

    def text(s: str) -> bytes:
        return struct.pack("<Q", len(s.encode())) + s.encode()

    for k, v in sorted(meta.items()):
        out += text(k) + struct.pack("<I", 8) + text(v)
    for name, shape in sorted(shapes.items()):
        out += text(name) + struct.pack("<I", len(shape)) + b"".join(struct.pack("<Q", d) for d in reversed(shape)) + struct.pack("<IQ", 0, at)
        size = 4 * math.prod(shape)
        at += size + -size % 32
    out = b"GGUF" + struct.pack("<IQQ", 3, len(shapes), len(meta)) + out
    return out + b"\0" * (-len(out) % 32)


def write(tensors: dict[str, np.ndarray], metadata: dict[str, str] | None = None) -> bytes:
    """A version 3 file of f32 tensors."""
    out = [head({name: a.shape for name, a in tensors.items()}, metadata)]
    for _, a in sorted(tensors.items()):
        raw = np.ascontiguousarray(a, dtype="<f4").tobytes()
        out.append(raw + b"\0" * (-len(raw) % 32))
    return b"".join(out)
