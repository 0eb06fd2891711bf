import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tensorloom.llm import order, packing, queries_output, tokens, warc

from .edge import SF, TEXTS, clashing, documents


def _ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    return [np.asarray([*e.ids, 1], dtype="<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoder_equals_the_library(spark):
    texts = [t or "" for _, t in TEXTS] + ["it's 'tis we'll DON'T 12²³ ½ a_b--c ''s", "a\x0bb\x1cc", "É́ Å K ſ", "x" * 3000, "º ª µ ß Ÿ"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = tokens.Encoder(tokens.tokenizer_path()).encode(texts)
    assert got == [x[:-1].tobytes() for x in _ids(texts)]


def _thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_chunks_of_equal_hash_keep_their_own_ids(n):
    one, other = _thue_morse(n, "a", "b"), _thue_morse(n, "b", "a")
    texts = [one, "x", other, f"{other} {one}", f"x {one}", other]
    assert tokens.Encoder(tokens.tokenizer_path()).encode(texts) == [x[:-1].tobytes() for x in _ids(texts)]
    encoder = tokens.Encoder(tokens.tokenizer_path())
    assert [encoder.encode([t])[0] for t in texts] == [x[:-1].tobytes() for x in _ids(texts)]


def test_encoder_equals_the_library_on_random_texts():
    rng = np.random.default_rng(4)
    encoder = tokens.Encoder(tokens.tokenizer_path())
    for _ in range(5):
        texts = ["".join(rng.choice(list("abcde fg'1.\té½"), int(rng.integers(0, 200)))) for _ in range(200)]
        assert encoder.encode(texts) == [x[:-1].tobytes() for x in _ids(texts)]


def _check_packing(got, rows):
    ids = _ids([t for _, t in rows])
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    want = defaultdict(list)
    for (doc, _), x in zip(rows, ids, strict=True):
        want[doc].append(x)
    for doc, xs in want.items():
        own = sorted(pieces[doc], key=lambda r: r.start)
        assert sum(r.length for r in own) == sum(map(len, xs))
        if len(xs) == 1:
            at = 0
            for r in own:
                assert r.start == at and r.ids_crc32 == zlib.crc32(xs[0][at : at + r.length].tobytes()) and r.doc_tokens == len(xs[0])
                at += r.length
    short = 0
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW and own[0].padded_to == (at if at & (at - 1) == 0 else packing.WINDOW)
        short += at < packing.WINDOW
    return short


def test_packing(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert _check_packing(queries_output.op2_packing(spark, SF).collect(), rows) <= 1
    assert _check_packing(packing.pack(clashing(documents(spark).repartition(3))).collect(), TEXTS) <= 1
    assert packing.pack(documents(spark, [])).count() == 0


def test_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(0)
    p = packing.Packer(16)
    for _ in range(300):
        size = int(rng.integers(1, 16))
        h = p.level(size)
        counts = p.count.copy()

        def cost(level, counts=counts, size=size):
            n = counts.copy()
            if level:
                n[level] -= 1
            if level + size < 16:
                n[level + size] += 1
            return int((n[1:16] ** 2).sum())

        usable = [0] + [k for k in range(1, 17 - size) if counts[k] > 0]
        assert h in usable and cost(h) == min(map(cost, usable))
        p.place((0, 0, size, b"\0" * 4 * size))


PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "http://c/\r\nx: y", ""), (5, "u", "é" * 50_000), (5, "u", "é" * 50_000), (6, "v", "<p>x</p>"), (None, "n", "<p>x</p>"), (None, "n", "alone"), (-9, "w", "y\r\n\r\nWARC/1.1\r\n")]


def _brute_warc(rows):
    least = {}
    for i, _, h in rows:
        h = h or ""
        if h not in least or (i is not None and (least[h] is None or i < least[h])):
            least[h] = i
    out, used = [], set()
    for i, _, h in rows:
        h = h or ""
        first = least[h] == i and h not in used
        if first:
            used.add(h)
        data = h.encode()
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else least[h]))
    return sorted(out, key=str)


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    target = warc.write(clashing(pages))
    got = warc.read(spark, target).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == _brute_warc(PAGES)
    bodies = {(r.page_id, bytes(r.payload).decode()) for r in got if r.record_type == "response"}
    assert (5, "é" * 50_000) in bodies and (-9, "y\r\n\r\nWARC/1.1\r\n") in bodies


def _files(spark, target):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{target}/data").select("path", "content").collect()
    return sorted((f.path.split("/data/")[1].rsplit("/", 1)[0], hashlib.sha256(f.content).hexdigest()) for f in files)


def test_warc_is_deterministic_and_rolls(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    a, b = (warc.write(p, roll_bytes=2000) for p in (pages, pages.repartition(7)))
    assert _files(spark, a) == _files(spark, b) and len(_files(spark, a)) > len({x[0].split("/")[0] for x in _files(spark, a)})
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    got = warc.read(spark, a, payload=False).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == _brute_warc(rows)


def test_query_op1_against_brute_force(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = queries_output.op1_warc(spark, SF).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == _brute_warc(rows)


def test_warc_splits_hot_ids(spark, monkeypatch):
    """A null id and one id with most rows; equal payloads meet in one shard, and record names are all different."""
    rng = np.random.default_rng(6)
    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, f"u{k % 7}", f"page {rng.integers(0, 60)} " + "x" * 50) for k in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(warc, "LEAST_SHARDS", 16)
    a, b = (warc.write(p) for p in (pages, pages.repartition(5)))
    assert _files(spark, a) == _files(spark, b)
    got = warc.read(spark, a, payload=False).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == _brute_warc(rows)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{a}/data").collect()
    fields = [warc.parse(m)[0] for f in files for m in warc._records(bytes(f.content))]
    names = [f["WARC-Record-ID"] for f in fields if f["WARC-Type"] != "warcinfo"]
    responses = {f["WARC-Record-ID"] for f in fields if f["WARC-Type"] == "response"}
    assert len(set(names)) == len(names) == 600 and {f["WARC-Refers-To"] for f in fields if f["WARC-Type"] == "revisit"} <= responses
    sizes = [len(f.content) for f in files]
    assert max(sizes) < 0.25 * sum(sizes)


def test_warc_edges(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(spark, warc.write(empty)).count() == 0
    far = spark.createDataFrame([(-(1 << 62), "a", "1"), ((1 << 62), "b", "2"), (0, "c", "3")], "page_id long, url string, html string")
    assert warc.read(spark, warc.write(far)).count() == 3
    big = warc.member(b"a" * (1 << 24))
    assert big[-1] == 0 and b"".join(warc._records(big)) == b"a" * (1 << 24)
    with pytest.raises(Exception):  # noqa: B017  without its manifest an archive is not there
        warc.read(spark, "/nowhere/archive").count()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_feistel_is_a_permutation(n):
    f = order.Feistel(n, key=5)
    slots = f.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and np.array_equal(f.number(slots), np.arange(n))


def test_order_round_trip(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = order.write(documents(spark, rows).coalesce(1), length=256)
    head = order.manifest(spark, target)
    got = sorted(order.read(spark, target).collect(), key=lambda r: r.number)
    assert [r.slot for r in sorted(got, key=lambda r: r.slot)] == list(range(head["sequences"]))
    stream = b"".join(bytes(r.ids) for r in got)
    assert stream == np.concatenate(_ids([t for _, t in rows])).astype("<u2").tobytes()
    assert all(r.byte_offset == r.slot % head["slots_per_shard"] * head["stride"] and r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in got)
    late = order.read(spark, target, start=100).collect()
    assert sorted(r.slot for r in late) == list(range(100, head["sequences"]))
    assert order.read(spark, order.write(documents(spark, []))).count() == 0
    assert order.read(spark, order.write(clashing(documents(spark)))).count() > 0


def test_query_op4_against_the_library(spark):
    rows = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries_output.op4_order(spark, SF).collect()
    n = len(got)
    assert sorted(r.slot for r in got) == list(range(n)) == sorted(r.number for r in got)
    assert sum(r.n_ids for r in got) == sum(map(len, _ids(rows))) and all(0 < r.n_ids <= order.LENGTH for r in got)
    f = order.Feistel(n)
    assert np.array_equal(f.slot(np.array([r.number for r in got])), np.array([r.slot for r in got]))


def test_order_keeps_repeats_and_clashing_columns(spark):
    rows = [*TEXTS, *TEXTS]
    given = clashing(documents(spark, rows)).coalesce(1)
    got = sorted(order.read(spark, order.write(given, length=64)).collect(), key=lambda r: r.number)
    stream = b"".join(bytes(r.ids) for r in got)
    assert stream == np.concatenate(_ids([t for _, t in rows])).astype("<u2").tobytes()
