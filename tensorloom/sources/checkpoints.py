"""Pickled checkpoints through an allow list, and adapters in the PEFT layout."""

from __future__ import annotations

import io
import pickle
import re
import zipfile
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np

from ..operators import merge, structure
from ..tensor import TensorRef
from .files import decode

#: Storage classes and how their bytes read (fixed values).
_STORAGES = {"FloatStorage": "<f4", "DoubleStorage": "<f8", "HalfStorage": "<f2", "BFloat16Storage": "bf16", "LongStorage": "<i8", "IntStorage": "<i4", "ShortStorage": "<i2", "CharStorage": "i1", "ByteStorage": "u1", "BoolStorage": "?"}


@dataclass(frozen=True)
class _Storage:
    kind: str


def _rebuild(storage, offset, size, stride, *_):
    kind, raw = storage
    flat = decode(raw, kind)
    if not size:
        return flat[offset : offset + 1].reshape(())
    step = flat.itemsize
    if offset < 0 or any(s < 0 for s in stride) or offset + sum((n - 1) * s for n, s in zip(size, stride, strict=True) if n) >= max(1, len(flat)) and 0 not in size:
        raise pickle.UnpicklingError("a tensor leaves its storage")
    return np.lib.stride_tricks.as_strided(flat[offset:], size, [s * step for s in stride]).copy()


def _parameter(data, *_):
    return data


class _Restricted(pickle.Unpickler):
    """Loads the names on its list and nothing else."""

    ALLOWED = {("collections", "OrderedDict"): OrderedDict, ("torch._utils", "_rebuild_tensor_v2"): _rebuild, ("torch._utils", "_rebuild_parameter"): _parameter}

    def __init__(self, file, archive: zipfile.ZipFile, prefix: str):
        super().__init__(file)
        self.archive, self.prefix = archive, prefix

    def find_class(self, module: str, name: str) -> Any:
        if (module, name) in self.ALLOWED:
            return self.ALLOWED[module, name]
        if module == "torch" and name in _STORAGES:
            return _Storage(_STORAGES[name])
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed")

    def persistent_load(self, pid: Any) -> Any:
        if not (isinstance(pid, tuple) and pid[0] == "storage" and isinstance(pid[1], _Storage)):
            raise pickle.UnpicklingError("not a storage")
        return pid[1].kind, self.archive.read(f"{self.prefix}/data/{pid[2]}")


def parse_pytorch(raw: bytes) -> Iterator[tuple[str, tuple[int, ...], str, np.ndarray]]:
    """Tensors of a zip checkpoint, nested dictionaries joined by dots."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        inside = next(n for n in z.namelist() if n.endswith("/data.pkl"))
        tree = _Restricted(io.BytesIO(z.read(inside)), z, inside.rsplit("/", 1)[0]).load()

    def walk(prefix: str, x: Any):
        if isinstance(x, dict):
            for k, v in x.items():
                yield from walk(f"{prefix}.{k}" if prefix else str(k), v)
        elif isinstance(x, np.ndarray):
            yield prefix, x.shape, "f64", x.ravel()

    yield from walk("", tree)


#: Settings of an adapter that a plain product of its factors cannot state.
_REFUSED = ("use_dora", "fan_in_fan_out", "rank_pattern", "alpha_pattern", "modules_to_save")


#: Names of each adapter type's factors after the module's name (fixed values).
_PARTS = {
    "LORA": ("lora_A", "lora_B"),
    "ADALORA": ("lora_A", "lora_B", "lora_E"),
    "LOHA": ("hada_w1_a", "hada_w1_b", "hada_w2_a", "hada_w2_b"),
    "VERA": ("vera_lambda_b", "vera_lambda_d"),
    "IA3": ("ia3_l",),
}


def apply_peft(base: dict[str, TensorRef], adapter: dict[str, TensorRef], config: dict[str, Any]) -> dict[str, TensorRef]:
    """Base weights with an adapter's change applied; types and settings out of reach are refused.

    LORA, ADALORA, LOHA and VERA add to a weight, IA3 scales its rows, or its
    columns where the module is named as feed-forward.
    """
    kind = config.get("peft_type")
    if kind not in _PARTS:
        raise ValueError(f"adapter type {kind!r}")
    for key in _REFUSED:
        if config.get(key):
            raise ValueError(f"{key} is refused")
    found: dict[str, dict[str, TensorRef]] = {}
    shared: dict[str, TensorRef] = {}
    for name, t in adapter.items():
        if kind == "VERA" and name.removesuffix(".default").rpartition(".")[2] in ("vera_A", "vera_B"):
            shared[name.removesuffix(".default").rpartition(".")[2]] = t
            continue
        m = re.fullmatch(rf"(?:base_model\.model\.)?(.+)\.({'|'.join(_PARTS[kind])})(?:\.default)?(?:\.weight)?", name)
        if not m:
            raise ValueError(f"{name} is no factor")
        found.setdefault(m[1], {})[m[2]] = t
    rank, alpha = config.get("r", 1), config.get("lora_alpha", config.get("alpha", config.get("r", 1)))
    if config.get("use_rslora"):
        alpha = alpha * rank**0.5
    if kind == "VERA" and set(shared) != {"vera_A", "vera_B"}:
        raise ValueError("vera needs its shared factors")
    out = dict(base)
    for name, p in found.items():
        target = f"{name}.weight"
        if target not in base or set(p) != set(_PARTS[kind]):
            raise ValueError(f"{name}: no base weight, or parts of {kind} are missing")
        w = base[target]
        match kind:
            case "LORA":
                out[target] = merge.lora(w, p["lora_A"], p["lora_B"], alpha, rank)
            case "ADALORA":
                scaled = p["lora_E"].map(lambda v: v * (alpha / (rank + 1e-5)))
                out[target] = merge.adalora(w, p["lora_B"], scaled, p["lora_A"])
            case "LOHA":
                out[target] = merge.loha(w, p["hada_w1_b"], p["hada_w1_a"], p["hada_w2_b"], p["hada_w2_a"], alpha, rank)
            case "VERA":
                d, b = p["vera_lambda_d"], p["vera_lambda_b"]
                a_part = structure.slice_(shared["vera_A"], [0, 0], [d.shape[0], w.shape[1]])
                b_part = structure.slice_(shared["vera_B"], [0, 0], [w.shape[0], d.shape[0]])
                out[target] = merge.vera(w, a_part, b_part, d, b)
            case "IA3":
                wide = any(name == m or name.endswith(f".{m}") for m in config.get("feedforward_modules") or ())
                out[target] = merge.ia3(w, structure.reshape(p["ia3_l"], (-1,)), rows=not wide)
    return out
