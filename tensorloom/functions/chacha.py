"""Counter-mode random numbers: each element depends on seed and index alone.

The block function is ChaCha20 (RFC 8439), vectorised over blocks.
"""

from __future__ import annotations

import numpy as np

_U32 = np.uint32
#: "expand 32-byte k" (fixed values).
_SIGMA = (0x61707865, 0x3320646E, 0x79622D32, 0x6B206574)


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U32(n)) | (x >> _U32(32 - n))


def _quarter(s: list[np.ndarray], a: int, b: int, c: int, d: int) -> None:
    for x, y, z, n in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
        s[x] = s[x] + s[y]
        s[z] = _rotate(s[z] ^ s[x], n)


def blocks(key: bytes, counters: np.ndarray, nonce: bytes) -> np.ndarray:
    """The sixteen words of each block, [n, 16]."""
    n = len(counters)
    fixed = [*_SIGMA, *np.frombuffer(key, "<u4").tolist()]
    start = [np.full(n, w, dtype=_U32) for w in fixed] + [counters.astype(_U32)] + [np.full(n, w, dtype=_U32) for w in np.frombuffer(nonce, "<u4").tolist()]
    s = [x.copy() for x in start]
    for _ in range(10):
        for k in range(4):
            _quarter(s, k, 4 + k, 8 + k, 12 + k)
        for k in range(4):
            _quarter(s, k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4)
    return np.stack([a + b for a, b in zip(s, start, strict=True)], axis=1)


def words(seed: int, index: np.ndarray, stream: int = 0) -> np.ndarray:
    """Two 32-bit words of each index as one 64-bit number."""
    index = index.astype(np.uint64)
    key = int(seed).to_bytes(32, "little", signed=False)
    out = np.zeros(len(index), dtype=np.uint64)
    block = index // np.uint64(8)
    high = (block >> np.uint64(32)).astype(np.int64)
    for h in np.unique(high):
        own = np.flatnonzero(high == h)
        unique, back = np.unique(block[own] & np.uint64(0xFFFFFFFF), return_inverse=True)
        got = blocks(key, unique, int(h).to_bytes(4, "little") + int(stream).to_bytes(8, "little"))
        pairs = got.astype("<u4").view("<u8")
        out[own] = pairs[back, (index[own] % np.uint64(8)).astype(np.int64)]
    return out


def uniforms(seed: int, index: np.ndarray, stream: np.ndarray | None = None) -> np.ndarray:
    """Numbers in [0, 1) with 53 bits."""
    if stream is None:
        return (words(seed, index) >> np.uint64(11)) * 2.0**-53
    out = np.zeros(len(index))
    for s in np.unique(stream):
        own = stream == s
        out[own] = (words(seed, index[own], int(s)) >> np.uint64(11)) * 2.0**-53
    return out


def normals(seed: int, index: np.ndarray) -> np.ndarray:
    """Standard normal numbers by Box and Muller, two draws each."""
    u = uniforms(seed, np.concatenate([index * 2, index * 2 + 1]))
    a, b = u[: len(index)], u[len(index) :]
    return np.sqrt(-2 * np.log1p(-a)) * np.cos(2 * np.pi * b)


def random_tensor(spark, shape, seed: int, kind: str = "uniform", low: float = 0.0, high: float = 1.0, to: str = "f64"):
    """A tensor of addressable random numbers."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from ..tensor import generate

    if kind not in ("uniform", "normal"):
        raise ValueError(f"no distribution {kind!r}")

    @F.arrow_udf("double")
    def draw(pos: pa.Array) -> pa.Array:
        at = pos.to_numpy(zero_copy_only=False)
        return pa.array(uniforms(seed, at) * (high - low) + low if kind == "uniform" else normals(seed, at) * high + low)

    return generate(spark, shape, draw, to)
