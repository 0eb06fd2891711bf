import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tensorloom.llm import components, exactdup, queries_dedup, simhash

from .edge import SF, TEXTS, clashing, documents


def test_filters_merge_without_loss():
    rng = np.random.default_rng(0)
    total, filters = Counter(), []
    for k in range(5):
        values = np.sort(rng.choice(rng.integers(0, 1 << 59, 900, dtype=np.uint64), 600))
        unique, counts = np.unique(values, return_counts=True)
        total.update(dict(zip(unique.tolist(), counts.tolist(), strict=True)))
        f = exactdup.QuotientFilter.build(unique, counts)
        got = exactdup.QuotientFilter.from_bytes(f.to_bytes()).entries()
        assert np.array_equal(got[0], unique) and np.array_equal(got[1], counts), k
        filters.append(f)
    values, counts = exactdup.QuotientFilter.merge(filters).entries()
    assert dict(zip(values.tolist(), counts.tolist(), strict=True)) == total


def test_filter_of_one_and_of_runs():
    for values in ([5], [0, 1, 2, (1 << 64) - 1], list(range(1 << 41, (1 << 41) + 50))):
        v = np.array(values, dtype=np.uint64)
        got = exactdup.QuotientFilter.from_bytes(exactdup.QuotientFilter.build(v, np.ones(len(v), np.int64)).to_bytes()).entries()
        assert np.array_equal(got[0], v)


def _brute_exact(rows):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[text or ""].append((doc, i))
    return {(t, d): (max((x for x, _ in g if x is not None), default=None), len(g)) for t, g in groups.items() for d, _ in g}


@pytest.mark.parametrize("wrap", [lambda d: d, clashing])
def test_exact_edges(spark, wrap):
    got = exactdup.groups(wrap(documents(spark))).collect()
    assert len(got) == len(TEXTS)
    want = _brute_exact(TEXTS)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): t for t, _ in want}
    kept = Counter()
    for r in got:
        t = by_hash[r.text_sha256]
        assert (r.keep_id, r.group_size) == want[(t, r.doc_id)]
        kept[t] += r.kept
    assert set(kept.values()) == {1}


def test_exact_survivors(spark):
    got = exactdup.survivors(documents(spark)).collect()
    assert len(got) == len({t or "" for _, t in TEXTS})
    assert exactdup.survivors(documents(spark, [])).count() == 0 and exactdup.groups(documents(spark, [])).count() == 0


def _components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def _brute_fingerprint(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_words_two_bits_apart_share_a_key():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 1 << 23, 500).astype(np.int32)
    for flips in (0, 1, 2):
        other = w.copy()
        for i in range(len(other)):
            for bit in rng.choice(23, flips, replace=False):
                other[i] ^= 1 << int(bit)
        sets = []
        for words in (w, other):
            rows, index = simhash.golay_keys(words)
            own = defaultdict(set)
            for r, k in zip(rows.tolist(), index.tolist(), strict=True):
                own[r].add(k)
            sets.append(own)
        assert all(sets[0][i] & sets[1][i] for i in range(len(w)))


@pytest.mark.parametrize("limit", [128, 2])
def test_links_of_crowded_fingerprints(spark, monkeypatch, limit):
    """Chains and balls around one point, through both ways of large groups."""
    monkeypatch.setattr(simhash, "GROUP_ROWS", limit)
    rng = np.random.default_rng(2)
    fps = {0}
    for _ in range(6):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(25):
            fps.add(x)
            x ^= 1 << int(rng.integers(64))
            if rng.random() < 0.3:
                x ^= 1 << int(rng.integers(64))
    fps |= {3 << 62, 1 << 63}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    labels = {r.node % (1 << 64): r.root for r in components.components(simhash.links(df)).collect()}
    roots = _components(fps)
    for i in range(len(fps)):
        for j in range(i):
            same = fps[i] in labels and fps[j] in labels and labels[fps[i]] == labels[fps[j]]
            assert same == (roots[i] == roots[j])


@pytest.mark.parametrize("chunk", [components.CHUNK_EDGES, 20])
def test_components_of_a_long_chain(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK_EDGES", chunk)
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_simhash_edges(spark):
    got = simhash.classes(clashing(documents(spark)), shingle=3).collect()
    assert len(got) == len(TEXTS)
    want = {}
    fps = [_brute_fingerprint(t, 3) for _, t in TEXTS]
    roots = _components(fps)
    for r in set(roots):
        own = [TEXTS[i][0] for i in range(len(TEXTS)) if roots[i] == r]
        for i in range(len(TEXTS)):
            if roots[i] == r:
                want[fps[i]] = min((d for d in own if d is not None), default=None)
    for r in got:
        assert r.component_id == want[r.fp % (1 << 64)]
    assert simhash.classes(documents(spark, [])).count() == 0


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = [_brute_fingerprint(r.text, 3) for r in rows]
    roots = _components(fps)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        least[root] = min(least.get(root, r.doc_id), r.doc_id)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries_dedup.op3_simhash(spark, SF).collect()}
    assert got == {r.doc_id: (format(f, "016x"), least[root]) for r, f, root in zip(rows, fps, roots, strict=True)}


def test_near_copies_are_caught_and_others_left(spark):
    rng = np.random.default_rng(3)
    rows, groups = [], {}
    for g in range(30):
        words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
        for c in range(1 + 2 * (g % 2)):
            copy = list(words)
            for at in rng.choice(400, c, replace=False):
                copy[at] = f"changed{g}x{c}"
            rows.append((len(rows), " ".join(copy)))
            groups[len(rows) - 1] = g
    kept = [r.doc_id for r in simhash.survivors(documents(spark, rows)).collect()]
    assert Counter(groups[d] for d in kept) == Counter(range(30))


def _shingles(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def _brute_near(rows):
    """The smallest doc_id of each row's component of pairs at a Jaccard similarity of 0.8 or more."""
    sets, root = [_shingles(t) for _, t in rows], list(range(len(rows)))
    by_shingle = defaultdict(list)
    for i, own in enumerate(sets):
        for x in own:
            by_shingle[x].append(i)
    shared = Counter((i, j) for at in by_shingle.values() for i in at for j in at if i < j)
    links = {(i, j): n / (len(sets[i]) + len(sets[j]) - n) for (i, j), n in shared.items()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), n in shared.items():
        if 9 * n >= 4 * (len(sets[i]) + len(sets[j])):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}, links


def _edited(rng, words, changes, tag):
    out = list(words)
    for at in rng.choice(len(out), changes, replace=False):
        out[at] = f"{tag}x{at}"
    return out


def _random_words(rng, n):
    return ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)]


def _near(spark, rows):
    return {r.doc_id: r.component_id for r in simhash.near_classes(documents(spark, rows)).collect()}


def test_near_copies_at_the_threshold_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(80):
        base = _random_words(rng, 300)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(_edited(rng, base, 5 + g % 4, f"g{g}")))]
    want, links = _brute_near(rows)
    assert sum(0.8 <= j < 0.85 for j in links.values()) > 20
    assert _near(spark, rows) == want


def test_texts_below_the_threshold_are_not_dropped(spark):
    rng = np.random.default_rng(6)
    line, rows = "one line that many texts repeat again and again", []
    for g in range(80):
        base = _random_words(rng, 300)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(_edited(rng, base, 7 + g % 4, f"g{g}")))]
    for _ in range(6):  # the line's shingles count once each, however often it comes
        rows.append((len(rows), " ".join([line] * 200 + _random_words(rng, 60))))
    want, links = _brute_near(rows)
    assert sum(0.72 <= j < 0.8 for j in links.values()) > 20
    assert _near(spark, rows) == want
    assert {r.doc_id for r in simhash.survivors(documents(spark, rows)).collect()} == set(want.values())


def test_links_of_a_group_over_many_partitions(spark):
    """Copies of one text that are about 0.8 alike among each other, the text itself left out."""
    rng = np.random.default_rng(7)
    base = _random_words(rng, 300)
    rows = [(i, " ".join(_edited(rng, base, 3 + i % 4, f"c{i}"))) for i in range(150)]
    rows += [(150 + i, " ".join(_edited(rng, base, 8, f"f{i}"))) for i in range(20)]  # joined by few others or none
    want, _ = _brute_near(rows)
    assert 20 < len(set(want.values())) < 100
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert _near(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_links_between_blocks_of_a_family(spark, monkeypatch):
    """A family of many blocks: pivots join most of it, the rest is held against every block."""
    monkeypatch.setattr(simhash, "BLOCK_SETS", 16)
    monkeypatch.setattr(simhash, "HAND_SETS", 4)
    rng = np.random.default_rng(8)
    rows = []
    for g in range(2):
        base = _random_words(rng, 300)
        rows += [(len(rows) + i, " ".join(_edited(rng, base, 3 + i % 5, f"g{g}c{i}"))) for i in range(90)]
        rows += [(len(rows) + i, " ".join(_edited(rng, base, 8, f"g{g}f{i}"))) for i in range(15)]
    want, _ = _brute_near(rows)
    assert 20 < len(set(want.values())) < 150
    assert _near(spark, rows) == want


def test_rows_of_one_doc_id_are_told_apart(spark):
    rng = np.random.default_rng(9)
    a, b = (" ".join(_random_words(rng, 60)) for _ in range(2))
    rows = [(1, a), (5, a), (5, b), (None, a + " end"), (None, "alone"), (7, None), (8, "")]
    got = {(r.doc_id, r.text) for r in simhash.survivors(documents(spark, rows)).collect()}
    assert got == {(1, a), (5, b), (None, "alone"), (7, None)}


@pytest.mark.parametrize("keep", [exactdup.survivors, simhash.survivors])
def test_survivors_keep_columns_and_values(spark, keep):
    df = clashing(documents(spark)).withColumnRenamed("labels", "sha").withColumnRenamed("spans", "own_th")
    got = keep(df)
    assert got.columns == df.columns
    rows, given = [tuple(r) for r in got.collect()], {tuple(r) for r in df.collect()}
    assert rows and set(rows) <= given
    assert keep(df.limit(0)).count() == 0
    plain = keep(documents(spark))
    assert sorted(r[:2] for r in rows if r[0] is not None) == sorted(tuple(r) for r in plain.collect() if r[0] is not None)


@pytest.mark.parametrize("shared,own", [(160, 20), (170, 15), (180, 10), (190, 5)])
def test_recall_of_planted_pairs(shared, own):
    """Of 1,250 pairs each at 0.8, 0.85, 0.9 and 0.95 all meet in a band and pass the sketch."""
    rng = np.random.default_rng(shared)
    met = near = 0
    for _ in range(1250):
        h = rng.integers(0, 1 << 64, shared + 2 * own, dtype=np.uint64)
        a, b = (simhash.minima(np.concatenate([h[:shared], part])) for part in (h[shared : shared + own], h[shared + own :]))
        met += bool((simhash.band_keys(a) == simhash.band_keys(b)).any())
        near += int((a == b).sum()) >= simhash.SKETCH_LEAST
    assert met == 1250 and near >= 1249
