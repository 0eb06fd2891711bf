"""Memory that Python workers keep after their work: they live on beside a full JVM."""

import ctypes
import re
import subprocess
import sys

import numpy as np
import pytest

_HELD = r"""
import re
import numpy as np, pyarrow as pa
from tensorloom.llm.common import slices

def mb():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def task():
    batch = pa.RecordBatch.from_pydict({"text": ["a"]})
    for _ in slices([batch], "text"):
        blocks = [np.ones(8_000) for _ in range(1_600)]  # 64 KB each
        kept.append(np.ones(8_000))  # above them, so the heap's end does not move
        del blocks

kept, before = [], mb()
task()
print(before, mb())
"""


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="needs glibc")
def test_freed_memory_goes_back():
    out = subprocess.run([sys.executable, "-c", _HELD], capture_output=True, text=True, check=True, timeout=60).stdout
    before, after = map(float, re.findall(r"[\d.]+", out))
    assert after < before + 30  # 100 MB were allocated and freed


def test_encoder_keeps_chunks_only():
    from tensorloom.llm.tokens import Encoder, tokenizer_path

    encoder = Encoder(tokenizer_path())
    texts = ["q" + "".join(chr(97 + int(d)) for d in str(k)) + ", and so on" for k in range(2_000)]
    first = encoder.encode(texts)
    kept = [v for v in vars(encoder).values() if isinstance(v, dict)]
    assert not any(len(d) > 100 for d in kept)
    assert first == encoder.encode(texts)
    assert first[7] == np.asarray(encoder.tokenizer.encode(texts[7], add_special_tokens=False).ids, dtype="<u4").tobytes()
