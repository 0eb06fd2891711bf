"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments.  Two fingerprints that differ
in two bits at most agree wholly in one segment (pigeonhole), and in another
one they differ in two bits at most.  The binary Golay code turns the latter
into equal keys: a 23-bit word's keys are the index of the codeword that it
decodes to and those of its neighbours at one bit, one or six in all, and
words two bits apart share one.  So each fingerprint gets keys of (whole
segment, codeword index of the next segment), and fingerprints that link meet
under one.

Keys are dealt out by range of (key, fingerprint), so that no key is bound to
one task.  Groups of up to ``GROUP_ROWS`` are verified by their bits where they
lie and leave a spanning forest of true links.  Fingerprints of larger groups,
and of groups that a partition's edge cuts, take an exact other way: two
fingerprints link if and only if they share a point at one bit from both, and
at most 65 fingerprints lie around a point.

Near copies (:func:`near_classes`) are pairs whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more.  At that distance two fingerprints differ in
some ten of 64 bits, beyond what Golay keys reach, so links of fingerprints are
only one source of candidates; the other is minima of the sets' hashes, grouped
in ``BANDS`` bands of ``BAND_ROWS``.  A pair at exactly 0.8 agrees in no band with
a probability of 5e-7, a more similar one with less.  Candidates are joined to
families by their keys, and never listed pair by pair.  Families are cut into
blocks of bounded size; a task holds one block's sets against each other, or
against a few of another block, and leaves a spanning forest of true links.
Every two members of a family that are not connected otherwise are compared:
first by a sketch of all minima (at 0.8 it falls below ``SKETCH_LEAST`` with a
probability of 3e-7), then exactly.

Defined cases: null and empty texts have fingerprint zero, linked like any
other; as sets of shingles all of them are one text.  Components hold all rows
of a fingerprint; a component's id is its smallest doc_id, nulls aside.  A very
long text is hashed whole.  Ties don't arise: the smallest doc_id is one number,
and of one doc_id's texts the one of the smallest hash ranks first.  Repeated
rows get equal results.  An empty table gives an empty result.  Other columns
play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import mix
from .common import Tables, screened, slices, staged, without
from .components import components

U64 = np.uint64
SHINGLE = 5
#: Largest number of differing bits that links two fingerprints.
DISTANCE = 2
#: (shift, width) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Minima of shingles that find candidates for near copies: bands, and minima in each.
BANDS, BAND_ROWS = 48, 6
#: Bands that are joined first, so that later ones meet joined copies as one.
PILOT_BANDS = 8
#: Of all minima so many must agree before two sets are compared.
SKETCH_LEAST = 196
#: Sets, and hashes, of a block at most (a longer set is a block by itself), and sets of a hand of pivots.
BLOCK_SETS, BLOCK_HASHES, HAND_SETS = 512, 1 << 18, 64
#: Keys of a fingerprint, on average.
KEYS = 16
#: Groups up to this size are compared in place; larger ones take the other exact way.
GROUP_ROWS = 128

# -- the binary Golay code (23, 12) ------------------------------------------------

#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
_GENERATOR = 0b101011100011


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator polynomial."""
    rest = words.astype(np.int32).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where((rest >> bit) & 1, np.int32(_GENERATOR << (bit - 11)), np.int32(0))
    return rest


def _leaders() -> np.ndarray:
    """For each syndrome the error pattern of weight three at most; the code is perfect."""
    bits = [1 << i for i in range(23)]
    patterns = [0, *bits]
    patterns += [a | b for i, a in enumerate(bits) for b in bits[i + 1 :]]
    patterns += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[i + 1 :], i + 1) for c in bits[j + 1 :]]
    patterns = np.asarray(patterns, dtype=np.int32)
    out = np.zeros(2048, dtype=np.int32)
    out[_syndromes(patterns)] = patterns
    return out


_LEADER = _leaders()


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    words = words.astype(np.int32)
    return (words ^ _LEADER[_syndromes(words)]) >> 11


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and codeword indices: of each word and of its neighbours at one bit."""
    around = np.empty((len(words), 24), dtype=np.int32)
    around[:, 0] = decode(words)
    for bit in range(23):
        around[:, bit + 1] = decode(words ^ (1 << bit))
    around.sort(axis=1)
    new = np.ones(around.shape, dtype=bool)
    new[:, 1:] = around[:, 1:] != around[:, :-1]
    return np.nonzero(new)[0], around[new]


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and 64-bit keys of each fingerprint."""
    parts = [((fingerprints >> U64(s)) & U64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    rows, out = [], []
    for i, own in enumerate(parts):
        at, index = golay_keys(parts[(i + 1) % 3].astype(np.int32))
        rows.append(at)
        out.append((np.int64(i) << np.int64(60)) | (own[at] << np.int64(12)) | index.astype(np.int64))
    return np.concatenate(rows), np.concatenate(out)


# -- fingerprints -------------------------------------------------------------------


def _majority(h: np.ndarray) -> int:
    """The number whose bits are set in over half of ``h``."""
    counts = np.zeros(64, dtype=np.int64)
    lanes = U64(0x0101010101010101)
    for begin in range(0, len(h), 255 * 256):
        part = h[begin : begin + 255 * 256]
        edges = np.arange(0, len(part), 255)
        for shift in range(8):
            sums = np.add.reduceat((part >> U64(shift)) & lanes, edges)  # eight counters of a byte each
            counts[shift::8] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in range(64) if 2 * counts[b] > len(h)))


def hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of all shingles of ``size`` words; a shorter text is one shingle, no word gives none."""
    joined = b" ".join((text or "").encode().lower().split())
    if not joined:
        return np.zeros(0, dtype=U64)
    space = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = np.concatenate([[0], space + 1])
    ends = np.concatenate([space, [len(joined)]])
    n = max(1, len(starts) - size + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[min(size, len(starts)) - 1 :]
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last[:n].tolist(), strict=True)), U64, n)


def fingerprint(text: str | None, size: int) -> int:
    """Majority bits of the hashes of all shingles of ``size`` words."""
    h = hashes(text, size)
    return _majority(h) if len(h) else 0


def fingerprints(documents: DataFrame, *, ident: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (a signed 64-bit number) of every row's whole text."""

    def run(batches):
        for batch in slices(batches, "text"):
            values = np.fromiter((fingerprint(t, shingle) for t in batch.column("text").to_pylist()), U64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    rows = documents.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


# -- links --------------------------------------------------------------------------


def _forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what is linked among a few distinct fingerprints."""
    differ = values[:, None] ^ values[None, :]
    a, b = np.nonzero(np.triu(np.bitwise_count(differ) <= DISTANCE, 1))
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            parent[q] = p
            out.append((int(values[x]), int(values[y])))
    return out


def links(distinct: DataFrame, *, column: str = "fp", count: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly what links connect.

    ``count`` is the number of fingerprints, where known.
    """

    def emit(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 20_000):
                values = batch.column(0).slice(begin, 20_000).to_numpy(zero_copy_only=False)
                rows, out = keys(values.view(U64))
                yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(values[rows])], ["key", "fp"])

    def meet(batches):
        def pack(edges, hot):
            a = [e[0] for e in edges] + hot
            b = [e[1] for e in edges] + [None] * len(hot)
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, dtype=U64).view(np.int64)), pa.array([None if x is None else x - (1 << 64) if x >= 1 << 63 else x for x in b], pa.int64())], ["a", "b"])

        held, now, first, hot_now = np.zeros(0, dtype=U64), None, True, False
        for batch in batches:
            all_keys = batch.column(0).to_numpy(zero_copy_only=False)
            values = batch.column(1).to_numpy(zero_copy_only=False).view(U64)
            cuts = np.flatnonzero(np.append(True, all_keys[1:] != all_keys[:-1])) if len(all_keys) else []
            edges: list[tuple[int, int]] = []
            hot: list[int] = []
            sizes = np.diff(np.append(cuts, len(all_keys)))
            for c, n in zip(np.asarray(cuts).tolist(), sizes.tolist(), strict=True):
                key = int(all_keys[c])
                if key != now:
                    if now is not None:
                        if first:  # the partition's edge may cut it
                            hot += held.tolist()
                        elif 1 < len(held) and not hot_now:
                            edges += _forest(held)
                        first = False
                    held, now, hot_now = values[c : c + n], key, False
                else:
                    held = np.concatenate([held, values[c : c + n]])
                if len(held) > GROUP_ROWS:
                    hot += held.tolist()
                    held, hot_now = np.zeros(0, dtype=U64), True
                elif hot_now and len(held):
                    hot += held.tolist()
                    held = np.zeros(0, dtype=U64)
            yield pack(edges, hot)
        yield pack([], held.tolist())  # the last group may be cut, too

    rows = distinct.select(F.col(column).alias("fp")).mapInArrow(emit, "key long, fp long")
    dealt = rows.repartitionByRange("key", "fp").sortWithinPartitions("key", "fp")
    met = staged(dealt.mapInArrow(meet, "a long, b long"), "links", rows=None if count is None else KEYS * count)
    near = met.where("b is not null").distinct()
    hot = met.where("b is null").select("a").distinct()
    point = F.explode(F.array(F.col("a"), *(F.col("a").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64))))
    around = hot.select("a", point.alias("point"))
    centre = around.groupBy("point").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1")
    # A point has at most 65 fingerprints around it, all of which link.
    far = around.join(centre, "point").where("a <> b").select("a", "b").distinct()
    return near.unionByName(far)


# -- near copies: texts that share most of their shingles ------------------------------

#: An odd factor for each minimum: a permutation of the hashes.
_FACTORS = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=U64)) | U64(1)


def shingle_set(h: np.ndarray) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; no word gives the set of zero."""
    return np.unique(h) if len(h) else np.zeros(1, dtype=U64)


def set_number(h: np.ndarray) -> int:
    """One 64-bit number for a set, as :func:`shingle_set` gives it."""
    return xxhash.xxh64_intdigest(h.tobytes(), 42)


def minima(h: np.ndarray) -> np.ndarray:
    """The least hash of a set under each permutation."""
    least = np.full(len(_FACTORS), U64(0xFFFFFFFFFFFFFFFF))
    for begin in range(0, len(h), 1024):
        least = np.minimum(least, np.multiply.outer(_FACTORS, h[begin : begin + 1024]).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band, of its minima."""
    out = np.arange(1, BANDS + 1, dtype=U64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        out = mix(out + row)
    return out


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=U64).view(np.int64))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(r) for r in rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(np.concatenate(rows)))


def signatures(documents: DataFrame, *, ident: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per input row.

    doc_id, th (a hash of the text), fp (the number of its set of shingles), sh
    (its fingerprint), n (the set's size), keys (of the bands) and sketch (a
    byte of each minimum).
    """

    def run(batches):
        for batch in slices(batches, "text"):
            every = [hashes(t, shingle) for t in batch.column("text").to_pylist()]
            sets = [shingle_set(h) for h in every]
            least = [minima(h) for h in sets]
            columns = [_signed([set_number(h) for h in sets]), _signed([_majority(h) if len(h) else 0 for h in every]), pa.array([len(h) for h in sets], pa.int64())]
            columns += [_lists([band_keys(x) for x in least]), pa.array([mix(x).astype(np.uint8).tobytes() for x in least], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *columns], ["doc_id", "th", "fp", "sh", "n", "keys", "sketch"])

    rows = documents.select(F.col(ident).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, fp long, sh long, n long, keys array<long>, sketch binary")


def _spread(rows: DataFrame, first: int, last: int) -> DataFrame:
    """key and node of each band from ``first`` to ``last``; equal ones of a batch are given once."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("keys").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, BANDS)[:, first:last]
            nodes = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), last - first)
            pairs = np.unique(np.stack([keys.ravel(), nodes], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["key", "node"])

    return rows.select("node", "keys").mapInArrow(run, "key long, node long")


def _starred(keyed: DataFrame, rows: int, use: Tables) -> DataFrame:
    """Edges (a, b) that connect the nodes of each key.

    Rows are dealt by range of (key, node), so a key may lie in many
    partitions: each joins its own part to its first node, and the first nodes
    of keys at the partitions' edges are joined afterwards, two a partition.
    """

    def run(batches):
        now = head = None
        first = True
        marks: list[tuple[int, int]] = []
        for batch in batches:
            keys, nodes = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            if not len(keys):
                continue
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            heads = nodes[starts]
            if now == keys[0]:
                heads[0] = head
            elif first:
                marks.append((int(keys[0]), int(heads[0])))
            first, now, head = False, keys[-1], heads[-1]
            each = np.repeat(heads, np.diff(np.append(starts, len(keys))))
            pairs = np.unique(np.stack([each, nodes], axis=1)[each != nodes], axis=0)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["key", "a", "b"])
        if not first:
            marks.append((int(now), int(head)))
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in marks]), pa.array([m[1] for m in marks]), pa.nulls(len(marks), pa.int64())], ["key", "a", "b"])

    dealt = keyed.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    met = use.staged(dealt.mapInArrow(run, "key long, a long, b long"), "met", rows=rows)
    marks = met.where("b is null").select("key", "a")
    least = marks.groupBy("key").agg(F.min("a").alias("b"))
    return met.where("b is not null").select("a", "b").unionByName(marks.join(least, "key").where("a <> b").select("a", "b"))


def _families(distinct: DataFrame, count: int, use: Tables) -> DataFrame:
    """fp and family of every set that may have a near copy.

    Fingerprints that link, and keys of the first bands, join most copies; the
    other bands then meet each joined group as one node.
    """
    nodes = distinct.withColumn("node", F.col("fp"))
    prints = use.staged(distinct.groupBy("sh").agg(F.min("fp").alias("head")), "prints", rows=count)
    same = distinct.join(prints, "sh").where("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    one, other = (prints.select(F.col("sh").alias(c), F.col("head").alias(f"{c}_head")) for c in "ab")
    close = links(prints, column="sh", count=count).join(one, "a").join(other, "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    met = _starred(_spread(nodes, 0, PILOT_BANDS), PILOT_BANDS * count, use)
    pilot = use.staged(components(same.unionByName(close).unionByName(met), nodes=count), "pilot", rows=count)
    named = nodes.join(pilot.withColumnRenamed("root", "held"), "node", "left").withColumn("node", F.coalesce("held", "node"))
    more = components(_starred(_spread(named, PILOT_BANDS, BANDS), (BANDS - PILOT_BANDS) * count, use), nodes=count)
    more = use.staged(more, "families", rows=count)
    # A group of the first step is in more than one place only under its root.
    moved = pilot.join(more.withColumnRenamed("node", "own").withColumnRenamed("root", "top"), F.col("root") == F.col("own"), "left")
    moved = moved.select(F.col("node").alias("fp"), F.coalesce("top", "root").alias("family"))
    rest = more.join(pilot.select("node"), "node", "left_anti").select(F.col("node").alias("fp"), F.col("root").alias("family"))
    return use.staged(moved.unionByName(rest), "family-members", rows=count)


_ROW = "family long, block int, blocks int, home int, fp long, sketch binary, set binary"
_PACK = "family long, block int, blocks int, homes binary, fps binary, sketches binary, sizes binary, sets binary"


def _rows(documents: DataFrame, members: DataFrame, *, text: str, shingle: int) -> DataFrame:
    """Members with their sets, from one text each."""

    def run(batches):
        kept = ["family", "block", "blocks", "block", "fp", "sketch"]
        for batch in slices(batches, "text"):
            sets = [shingle_set(hashes(t, shingle)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sets, pa.binary())], [f.split()[0] for f in _ROW.split(", ")])

    texts = documents.select(F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    texts = screened(texts, F.col("th"), members.select("th"), F.col("th"), "maybe").where("maybe").drop("maybe")
    return texts.join(members.select("th"), "th", "left_semi").dropDuplicates(["th"]).join(members, "th").select("family", "block", "blocks", "fp", "sketch", "text").mapInArrow(run, _ROW)


def _packs(rows: DataFrame, most: int | None = None) -> DataFrame:
    """One row per (family, block), of ``most`` members at most where given."""

    def run(batches):
        def pack(key, held):
            homes, fps, sketches, sets = zip(*held, strict=True)
            sizes = np.array([len(s) // 8 for s in sets], np.int64)
            values = [*key, np.array(homes, np.int32).tobytes(), np.array(fps, np.int64).tobytes(), b"".join(sketches), sizes.tobytes(), b"".join(sets)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [f.split()[0] for f in _PACK.split(", ")])

        now, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["family"], r["block"], r["blocks"])
                if held and key != now:
                    yield pack(now, held)
                    held = []
                now = key
                if most is None or len(held) < most:
                    held.append((r["home"], r["fp"], r["sketch"], r["set"]))
        if held:
            yield pack(now, held)

    return rows.repartition("family", "block").sortWithinPartitions("family", "block", "fp").mapInArrow(run, _PACK)


class _Block:
    """A pack in memory."""

    def __init__(self, r: dict, prefix: str = ""):
        self.homes, self.fps = np.frombuffer(r[f"{prefix}homes"], np.int32), np.frombuffer(r[f"{prefix}fps"], np.int64)
        self.sketches = np.frombuffer(r[f"{prefix}sketches"], np.uint8).reshape(len(self.fps), -1)
        self.sizes, values = np.frombuffer(r[f"{prefix}sizes"], np.int64), np.frombuffer(r[f"{prefix}sets"], U64)
        self.sets = np.split(values, np.cumsum(self.sizes)[:-1])

    def alike(self, i: int, other: _Block, places: np.ndarray) -> np.ndarray:
        """Those places of ``other`` whose size and sketch allow a similarity of 0.8 to member i."""
        near = places[(5 * other.sizes[places] >= 4 * self.sizes[i]) & (5 * self.sizes[i] >= 4 * other.sizes[places])]
        return near[np.count_nonzero(other.sketches[near] == self.sketches[i], axis=1) >= SKETCH_LEAST]

    def linked(self, i: int, other: _Block, j: int) -> bool:
        """Whether the sets have a Jaccard similarity of 0.8 or more."""
        a, b = self.sets[i], other.sets[j]
        shared = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
        return bool(9 * shared >= 4 * (len(a) + len(b)))  # shared / (sizes - shared) >= 4 / 5


def _forest_of(hand: _Block, block: _Block | None = None) -> list[tuple[int, int]]:
    """Edges that join what is linked within ``hand``, or between it and ``block``."""
    m, n = len(hand.fps), 0 if block is None else len(block.fps)
    other, base = (hand, 0) if block is None else (block, m)
    root, out = np.arange(m + n), []
    for i in range(m):
        places = np.arange(i + 1, m) if block is None else np.flatnonzero((block.fps != hand.fps[i]) & (block.homes != hand.homes[i]))
        left = hand.alike(i, other, places[root[base + places] != root[i]])
        while len(left):
            j, left = int(left[0]), left[1:]
            if hand.linked(i, other, j):
                out.append((int(hand.fps[i]), int(other.fps[j])))
                root[root == root[base + j]] = root[i]
                left = left[root[base + left] != root[i]]
    return out


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], ["a", "b"])


def _within(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield _edges(_forest_of(_Block(batch.slice(k, 1).to_pylist()[0])))


def _between(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            yield _edges(_forest_of(_Block(r, "p_"), _Block(r)))


def _met(hands: DataFrame, packs: DataFrame) -> DataFrame:
    """Links between each hand of pivots and all blocks of its family; hands are few beside a block's members."""
    names = [f.split()[0] for f in _PACK.split(", ")[3:]]
    each = hands.select("family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *(F.col(c).alias(f"p_{c}") for c in names))
    return each.join(packs.select("family", "block", *names), ["family", "block"]).select(*(f"p_{c}" for c in names), *names).mapInArrow(_between, "a long, b long")


def _picked(batches):
    """The members of a pack that ``picked`` names, dealt into hands."""
    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            block = _Block(r)
            at = np.flatnonzero(np.isin(block.fps, np.array(r["picked"], np.int64)))
            n = len(at)
            hand = pa.array((mix(block.fps[at].view(U64)) % U64(r["hands"])).astype(np.int32))
            columns = [pa.array([r["family"]] * n, pa.int64()), hand, pa.array([r["blocks"]] * n, pa.int32()), pa.array(block.homes[at]), pa.array(block.fps[at])]
            columns += [pa.array([block.sketches[i].tobytes() for i in at], pa.binary()), pa.array([block.sets[i].tobytes() for i in at], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _ROW.split(", ")])


def near_links(documents: DataFrame, distinct: DataFrame, count: int, use: Tables, *, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Edges (a, b) between distinct sets that connect what pairs of a similarity of 0.8 connect.

    ``distinct`` has ``count`` rows of fp, th, sh, n, keys and sketch.  Within a block all pairs
    are compared.  In a family of several blocks a hand of pivots is held
    against all of them, which joins most members of a real group.  Then every
    member outside the family's largest group is held against all its blocks,
    so two members that stay apart have been compared.
    """
    families = _families(distinct, count, use)
    sized = distinct.select("fp", "th", "n", "sketch").join(families, "fp")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_HASHES)).cast("int")
    counts = use.staged(sized.groupBy("family").agg(blocks.alias("blocks")), "family-sizes", rows=count)
    members = sized.join(counts, "family").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    members = use.staged(members.select("family", "block", "blocks", "fp", "th", "sketch"), "members", rows=count)
    packs = use.staged(_packs(_rows(documents, members, text=text, shingle=shingle)), "packs")
    found = use.staged(packs.select(*packs.columns[3:]).mapInArrow(_within, "a long, b long"), "block-links")
    many = packs.where("blocks > 1")
    if counts.where("blocks > 1").isEmpty():
        return found
    first = many.groupBy("family").agg(F.min("block").alias("block"))
    hands = many.join(first, ["family", "block"]).mapInArrow(_first_hand, _PACK)
    found = found.unionByName(use.staged(_met(hands, many), "pivot-links"))
    roots = components(found, nodes=count).select(F.col("node").alias("fp"), "root")
    named = use.staged(members.where("blocks > 1").select("family", "block", "fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named", rows=count)
    top = named.groupBy("family", "root").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.max("n").alias("most"))
    top = top.select("family", "top", F.ceil((F.col("n") - F.col("most")) / HAND_SETS).cast("int").alias("hands")).where("hands > 0")
    apart = named.join(top, "family").where("root <> top").groupBy("family", "block").agg(F.collect_list("fp").alias("picked"), F.first("hands").alias("hands"))
    pivots = many.join(apart, ["family", "block"]).mapInArrow(_picked, _ROW)
    return found.unionByName(use.staged(_met(_packs(pivots), many), "other-links"))


def _first_hand(batches):
    """The first members of each pack."""
    for batch in batches:
        for r in batch.to_pylist():
            sizes = np.frombuffer(r["sizes"], np.int64)
            n = min(HAND_SETS, len(sizes))
            wide = len(r["sketches"]) // len(sizes)
            values = [r["family"], r["block"], r["blocks"], r["homes"][: 4 * n], r["fps"][: 8 * n], r["sketches"][: wide * n], r["sizes"][: 8 * n], r["sets"][: 8 * int(sizes[:n].sum())]]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, batch.schema.types, strict=True)], batch.schema.names)


def _classes(rows: DataFrame, distinct: DataFrame, labels: DataFrame, count: int) -> DataFrame:
    named = distinct.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    moved = named.where("root <> fp").select("root").distinct()
    # Only components of several fingerprints need another minimum.
    several = staged(named.join(moved, "root", "left_semi").select("fp", "root", "least"), "members", rows=count)
    least = several.groupBy("root").agg(F.min("least").alias("least"))
    found = staged(several.select("fp", "root").join(least, "root").select("fp", F.col("least").alias("found")), "classes", rows=count)
    by_print = staged(distinct.join(found, "fp", "left").select("fp", F.coalesce("found", "least").alias("least")), "by-print", rows=count)
    return rows.join(by_print, "fp")


def classes(documents: DataFrame, *, ident: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (its smallest doc_id).

    Fingerprints link at ``DISTANCE`` bits, and no link is missed.
    """
    rows = staged(fingerprints(documents, ident=ident, text=text, shingle=shingle), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    count = distinct.count()
    return _classes(rows, distinct, components(links(distinct, count=count), nodes=count), count).select("doc_id", "fp", F.col("least").alias("component_id"))


def near_classes(documents: DataFrame, *, ident: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Like :func:`classes`, with links between texts that share 0.8 of their shingles.

    fp is the number of a set; th is a hash of the text, keep_th that of the
    component's first row.
    """
    rows = staged(signatures(documents, ident=ident, text=text, shingle=shingle), "signatures")
    # Rows of one doc_id rank by a hash of their text, rows without one after all others.
    rank = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "th")
    distinct = rows.groupBy("fp").agg(F.min(rank).alias("least"), F.min(F.struct("th", "sh", "n", "keys", "sketch")).alias("own"))
    distinct = staged(distinct.select("fp", "least", "own.*"), "distinct")
    count, use = distinct.count(), Tables()
    labels = components(near_links(documents, distinct, count, use, text=text, shingle=shingle), nodes=count)
    use.release()
    got = _classes(rows.select("doc_id", "th", "fp"), distinct.select("fp", "least"), labels, count)
    return got.select("doc_id", "th", "fp", F.col("least.doc_id").alias("component_id"), F.col("least.th").alias("keep_th"))


def survivors(documents: DataFrame, *, ident: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The input's rows and columns, one document for each component of near copies.

    The one of the smallest doc_id stays, rows without a doc_id ranking last;
    rows are told apart by doc_id and text, so repeats of what stays stay.
    """
    got = near_classes(documents, ident=ident, text=text, shingle=shingle)
    gone = got.where(~(F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("th").eqNullSafe(F.col("keep_th")))).select("doc_id", "th").distinct()
    gone = staged(gone, "gone")
    return without(documents, gone, {"doc_id": F.col(f"`{ident}`").cast("long"), "th": F.xxhash64(F.col(f"`{text}`"))})
