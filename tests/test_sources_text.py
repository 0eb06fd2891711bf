"""File formats, templates, tokenizers and patterns."""

import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.functions import chacha, patterns, template, tokenizer
from tensorloom.operators import quant
from tensorloom.sources import files, gguf, packed
from tensorloom.tensor import collect, literal

RNG = np.random.default_rng(0)


def test_files_round_trip(spark, tmp_path):
    a, b = RNG.normal(size=(3, 5)).astype(np.float32).astype(float), np.arange(4.0)
    tensors = {"a": literal(spark, a, to="f32"), "b": literal(spark, b, to="i32"), "c": literal(spark, np.round(b), to="bf16")}
    raw = files.to_safetensors(tensors)
    assert raw == files.to_safetensors(tensors)
    (tmp_path / "m.safetensors").write_bytes(raw)
    (tmp_path / "n.npy").write_bytes(files.to_npy(tensors["a"]))
    (tmp_path / "z.npz").write_bytes(files.to_npz({"q": tensors["b"]}))
    (tmp_path / "g.gguf").write_bytes(gguf.write({"t": a.astype(np.float32)}, {"general.name": "x"}))
    for name, key, want in (("m.safetensors", "a", a), ("m.safetensors", "c", b), ("n.npy", "n", a), ("z.npz", "q", b), ("g.gguf", "t", a)):
        blocks = files.read(spark, str(tmp_path / name), block=4)
        assert np.array_equal(collect(files.cells(blocks, key, want.shape, block=4)), want)
    assert {r.name: r.elements for r in files.tensors(files.read(spark, str(tmp_path / "m.safetensors"))).collect()} == {"a": 15, "b": 4, "c": 4}
    files.write_model(tensors, str(tmp_path / "model"), block=4)
    assert np.array_equal(collect(files.cells(files.read_model(spark, str(tmp_path / "model")), "a", (3, 5), block=4)), a)


def test_fortran_order_and_refusals():
    out = io.BytesIO()
    np.save(out, np.asfortranarray(np.arange(6.0).reshape(2, 3)))
    assert next(files.parse_npy(out.getvalue(), "x"))[3].tolist() == [0, 1, 2, 3, 4, 5]
    out = io.BytesIO()
    np.save(out, np.array([{}], dtype=object), allow_pickle=True)
    with pytest.raises(ValueError):
        next(files.parse_npy(out.getvalue(), "x"))
    head = json.dumps({"x": {"dtype": "F32", "shape": [1], "data_offsets": [4, 8]}}).encode()
    with pytest.raises(ValueError):
        next(files.parse_safetensors(struct.pack("<Q", len(head)) + head + b"\0" * 8))
    with pytest.raises(ValueError):
        gguf.dequantize(b"\0" * 100, 16, 256)
    with zipfile.ZipFile(io.BytesIO(), "w"):
        pass


def _half(x):
    return np.float16(x).tobytes()


def test_block_formats_by_their_definition():
    q = RNG.integers(0, 16, 32)
    low = bytes(int(q[i]) | int(q[i + 16]) << 4 for i in range(16))
    assert np.allclose(gguf.dequantize(_half(0.5) + low, 2, 32), (q - 8) * 0.5)
    assert np.allclose(gguf.dequantize(_half(0.5) + _half(3) + low, 3, 32), q * 0.5 + 3)
    q5 = RNG.integers(0, 32, 32)
    low = bytes(int(q5[i] & 15) | int(q5[i + 16] & 15) << 4 for i in range(16))
    high = sum(int(q5[i] >> 4) << i for i in range(32)).to_bytes(4, "little")
    assert np.allclose(gguf.dequantize(_half(2) + high + low, 6, 32), (q5 - 16) * 2)
    assert np.allclose(gguf.dequantize(_half(2) + _half(1) + high + low, 7, 32), q5 * 2 + 1)
    q8 = RNG.integers(-128, 128, 32).astype(np.int8)
    assert np.allclose(gguf.dequantize(_half(0.25) + q8.tobytes(), 8, 32), q8 * 0.25)
    q6 = RNG.integers(0, 64, 256)
    ql, qh = np.zeros(128, np.uint8), np.zeros(64, np.uint8)
    for half in range(2):
        for i in range(32):
            v = [int(q6[128 * half + 32 * k + i]) for k in range(4)]
            ql[64 * half + i] = v[0] & 15 | (v[2] & 15) << 4
            ql[64 * half + 32 + i] = v[1] & 15 | (v[3] & 15) << 4
            qh[32 * half + i] = v[0] >> 4 | v[1] >> 4 << 2 | v[2] >> 4 << 4 | v[3] >> 4 << 6
    s = RNG.integers(-20, 20, 16).astype(np.int8)
    raw = ql.tobytes() + qh.tobytes() + s.tobytes() + _half(0.5)
    assert np.allclose(gguf.dequantize(raw, 14, 256), (q6 - 32) * np.repeat(s, 16) * 0.5)
    q4 = RNG.integers(0, 16, 256)
    body = bytes(int(q4[64 * b + i]) | int(q4[64 * b + 32 + i]) << 4 for b in range(4) for i in range(32))
    sc, mn = RNG.integers(0, 64, 8), RNG.integers(0, 64, 8)
    packed_scales = bytes([*(int(sc[j]) | int(sc[j + 4]) >> 4 << 6 for j in range(4)), *(int(mn[j]) | int(mn[j + 4]) >> 4 << 6 for j in range(4)), *(int(sc[j + 4]) & 15 | (int(mn[j + 4]) & 15) << 4 for j in range(4))])
    assert np.allclose(gguf.dequantize(_half(1) + _half(2) + packed_scales + body, 12, 256), q4 * np.repeat(sc, 32) - 2 * np.repeat(mn, 32))


def test_packed_checkpoints(spark):
    q, z, s = RNG.integers(0, 16, (16, 8)), RNG.integers(1, 16, (2, 8)), RNG.normal(size=(2, 8))
    words = np.zeros((2, 8), np.int64)
    for k in range(8):
        words |= q[k::8].astype(np.int64) << (4 * k)
    zeros = np.zeros((2, 1), np.int64)
    for k in range(8):
        zeros[:, 0] |= (z[:, k].astype(np.int64) - 1) << (4 * k)
    signed = [np.where(x >= 1 << 31, x - (1 << 32), x).astype(float) for x in (words, zeros)]
    got = packed.gptq(literal(spark, signed[0]), literal(spark, signed[1]), literal(spark, s), group=8)
    assert np.allclose(collect(got), (q - np.repeat(z, 8, 0)) * np.repeat(s, 8, 0))
    book = np.array(quant.normal_float(4))
    ids = RNG.integers(0, 16, 12)
    raw = [float(ids[2 * i] << 4 | ids[2 * i + 1]) for i in range(6)]
    got = packed.nf4(literal(spark, raw), literal(spark, [2.0, 3.0, 4.0]), (3, 4), block=4)
    assert np.allclose(collect(got), (book[ids] * np.repeat([2, 3, 4], 4)).reshape(3, 4))


def test_chacha_block():
    """The block of RFC 8439, section 2.3.2."""
    got = chacha.blocks(bytes(range(32)), np.array([1]), bytes.fromhex("000000090000004a00000000"))[0]
    assert [hex(x) for x in got[:4]] == ["0xe4e7f110", "0x15593bd1", "0x1fdd0f50", "0xc47120a3"]
    u = chacha.uniforms(5, np.arange(4000))
    assert np.array_equal(chacha.uniforms(5, np.array([77, 3])), u[[77, 3]]) and 0.48 < u.mean() < 0.52
    n = chacha.normals(5, np.arange(4000))
    assert abs(n.mean()) < 0.06 and abs(n.std() - 1) < 0.05


VECTORS = [
    ("{{ a | upper }}-{{ b|default('z') }}", {"a": "x"}, "X-z"),
    ("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% else %}none{% endfor %}", {"xs": ["a", "b"]}, "1a,2b"),
    ("{% for x in xs %}{{ x }}{% else %}none{% endfor %}", {"xs": []}, "none"),
    ("{% set k = 1 %}{% for x in xs %}{% set k = x %}{% endfor %}{{ k }}", {"xs": [5]}, "1"),
    ("{{ 'abcdef'[-3:] }}{{ xs[1] }}{{ m.k }}{{ 'a' in 'cat' }}", {"xs": [1, 2], "m": {"k": "v"}}, "def2vtrue"),
    ("{%- if a == 1 -%} one {%- elif a > 1 -%} many {%- else -%} few {%- endif -%}", {"a": 3}, "many"),
    ("{{ m | tojson }}{{ 7 % 4 + 2 * 3 }}{{ 'x' ~ 1 }}", {"m": {"b": 1, "a": "é"}}, '{"a":"é","b":1}9x1'),
    ("{{ 'foo-bar (baz)' | title }}|{{ 'hELLO' | capitalize }}", {}, "Foo-Bar (Baz)|Hello"),
    ("{{ 0 | strftime('%Y-%m-%d') }} {{ ' 12 ' | int + 1 }} {{ -3 | abs }}", {}, "1970-01-01 13 -3"),
    ("{{ xs | first }}{{ xs | last }}{{ xs | length }}{{ xs | join('+') }}{{ 'a,b' | split(',') | join }}", {"xs": ["p", "q"]}, "pq2p+qab"),
    ("{{ m | keys | join }}{{ m | values | join }}{{ 'aXa' | replace('a', 'b') }}{{ a is defined }}", {"m": {"b": "2", "a": "1"}}, "ab12bXbfalse"),
    ("{{ 'yes' if a else 'no' }}{# note #}", {"a": 0}, "no"),
]


@pytest.mark.parametrize("source,inputs,want", VECTORS)
def test_templates(source, inputs, want):
    assert template.render_one(source, inputs) == want


def test_templates_on_columns(spark):
    df = spark.createDataFrame([(json.dumps(i),) for _, i, _ in VECTORS[:1]] + [(None,)], "input string")
    got = [r.o for r in df.select(template.render(VECTORS[0][0])("input").alias("o")).collect()]
    assert got == ["X-z", None]
    assert template.free_vars("{% for m in ms %}{{ m.x ~ y }}{{ loop.index }}{% endfor %}{% set z = 1 %}{{ z }}") == {"ms", "y"}
    assert template.translate("{% macro f() %}{% endmacro %}")[0] == "refused" and template.translate("{{ a }}") == ("translated", "")
    with pytest.raises(template.TemplateError):
        template.render_one("{{ [] | first }}", {})
    row = spark.sql("select 'foo-bar BAZ (qux)' as s, '  x\t' as t").select(template.title(F.col("s")), template.trim(F.col("t"))).first()
    assert tuple(row) == ("Foo-Bar Baz (Qux)", "x")


def test_tokenizers():
    t = tokenizer.Tokenizer("bpe", {"a": 0, "b": 1, "ab": 2, "abb": 3, "?": 9}, merges=[("a", "b"), ("ab", "b")], unknown="?")
    assert t.encode("abbab") == [3, 2] and t.encode("xa") == [9, 0]
    with pytest.raises(tokenizer.TokenError):
        tokenizer.Tokenizer("bpe", {"a": 0, "b": 1}, merges=[("a", "b")]).encode("ab")
    w = tokenizer.Tokenizer("wordpiece", {"un": 0, "##aff": 1, "##able": 2, "[UNK]": 3}, pretokenizer="whitespace", unknown="[UNK]")
    assert w.encode("unaffable zz") == [0, 1, 2, 3] and w.decode([0, 1, 2]) == "unaffable"
    u = tokenizer.Tokenizer("unigram", {"a": 0, "b": 1, "ab": 2, "?": 3}, scores={"a": -1.0, "b": -1.0, "ab": -1.5}, unknown="?")
    assert u.encode("abb") == [2, 1]
    added = tokenizer.Tokenizer("char", {"a": 0, "b": 1}, added={"<x>": 7, "<x><y>": 8})
    assert added.encode("a<x><y>b<x>") == [0, 8, 1, 7]
    m = tokenizer.Tokenizer("wordlevel", {"▁hi": 0, "▁you": 1}, pretokenizer="metaspace")
    assert m.encode("hi you") == [0, 1] and m.decode([0, 1]) == "hi you"
    fall = tokenizer.Tokenizer("char", {f"<0x{b:02X}>": b for b in range(256)}, byte_fallback=True)
    assert fall.decode(fall.encode("é!")) == "é!"
    by = tokenizer.Tokenizer("bpe", {c: b for b, c in tokenizer.byte_alphabet().items()}, pretokenizer="byte-level")
    assert by.decode(by.encode("naïve 日")) == "naïve 日"
    with pytest.raises(tokenizer.TokenError):
        tokenizer.Tokenizer("char", {}, normalizers=("nfc",))


def test_patterns(spark):
    df = spark.createDataFrame([("layers.3.attn.q",), ("layers.3.x.attn.q",), ("head",)], "n string")
    got = df.select(patterns.substitute(F.col("n"), "layers.*.attn.?", "l{1}/{2}").alias("s")).collect()
    assert [r.s for r in got] == ["l3/q", None, None]
    assert df.where(patterns.matches(F.col("n"), "layers.**.q")).count() == 2
    with pytest.raises(ValueError):
        patterns.checked_regex(r"(?=a)b")
    with pytest.raises(ValueError):
        patterns.substitute(F.col("n"), "*", "{2}")
