"""Exact dedup with counting quotient filters.

Every partition of the fingerprint ledger builds counting quotient filters,
one for each range of quotients.  A fingerprint's top bits are its quotient,
which names a home slot; its low bits are the remainder, kept in a run of
sorted remainders with its count.  Filters of one range merge without loss by
merging sorted remainders, so after the merge each fingerprint's count is that
over all rows.  Fingerprints with a count above one route their texts to
verification by bytes: those texts, and only those, are grouped by their whole
bytes.

Defined cases: a null text counts as empty; all empty texts are equal.  Of
equal texts the row with the largest doc_id stays; a null doc_id ranks below
every other; of rows that repeat both doc_id and text exactly one stays, so ties
are broken by the row.  A very long text is one text like any other: it is
hashed whole, and moves only where its fingerprint repeats.  An empty table
gives an empty result.  Other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, screened, staged, without

U64 = np.uint64
#: Bits of a remainder, and of a quotient within one range.
REMAINDER_BITS = 40
#: About so many fingerprints meet in one filter after the merge.
RANGE_ROWS = 1 << 18
#: Fingerprints that a task holds at most before it gives out filters.
HELD_ROWS = 1 << 20


@dataclass
class QuotientFilter:
    """Counting quotient filter over the fingerprints of one range.

    ``occupied`` marks home slots that have a run; ``run_end`` marks the last
    slot of each run; ``remainders`` and ``counts`` are by slot, a count of
    zero being a free slot.
    """

    quotient_bits: int
    occupied: np.ndarray
    run_end: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray
    base: int = 0

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray, remainder_bits: int = REMAINDER_BITS, load: float = 0.75) -> QuotientFilter:
        """From distinct sorted fingerprints, whose bits above quotient and remainder are equal."""
        n = len(fingerprints)
        need = max(1, math.ceil(math.log2(max(2, n / load))))
        span = int(fingerprints[-1] >> U64(remainder_bits)) - int(fingerprints[0] >> U64(remainder_bits)) if n else 0
        shift = max(0, span.bit_length() - need)  # the low quotient bits that join the remainder
        low = remainder_bits + shift
        quotient = (fingerprints >> U64(low)).astype(np.int64)
        quotient -= quotient[0] if n else 0
        order = np.arange(n)
        # Linear probing over sorted input: each entry takes its home slot or the next free one.
        slot = np.maximum.accumulate(quotient - order) + order if n else order
        size = int(slot[-1]) + 1 if n else 0
        occupied, run_end = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        remainders, held = np.zeros(size, dtype=U64), np.zeros(size, dtype=np.int64)
        if n:
            occupied[quotient] = True
            run_end[slot[np.append(quotient[1:] != quotient[:-1], True)]] = True
            remainders[slot] = fingerprints & U64((1 << low) - 1)
            held[slot] = counts
        return cls(low, occupied, run_end, remainders, held, int(fingerprints[0] >> U64(low)) if n else 0)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted fingerprints and counts: the k-th run belongs to the k-th occupied home."""
        used = np.flatnonzero(self.counts)
        homes = np.flatnonzero(self.occupied)
        run = np.cumsum(self.run_end[used]) - self.run_end[used]
        quotient = (homes[run] + self.base).astype(U64)
        return (quotient << U64(self.quotient_bits)) | self.remainders[used], self.counts[used]

    def to_bytes(self) -> bytes:
        """Bit vectors, then only the used slots' remainders and counts."""
        used = np.flatnonzero(self.counts)
        head = np.array([self.quotient_bits, self.base, len(self.counts), len(used)], dtype=np.int64)
        taken = np.packbits(self.counts > 0)
        width = (self.quotient_bits + 7) // 8
        low = self.remainders[used].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        big = np.flatnonzero(self.counts[used] > 1)
        return b"".join(x.tobytes() for x in (head, np.packbits(self.occupied), np.packbits(self.run_end), taken, np.ascontiguousarray(low), np.array([len(big)]), big, self.counts[used][big]))

    @classmethod
    def from_bytes(cls, raw: bytes) -> QuotientFilter:
        bits, base, size, n = np.frombuffer(raw, np.int64, 4).tolist()
        at, flags = 32, []
        for _ in range(3):
            flags.append(np.unpackbits(np.frombuffer(raw, np.uint8, (size + 7) // 8, at))[:size].astype(bool))
            at += (size + 7) // 8
        width = (bits + 7) // 8
        wide = np.zeros((n, 8), dtype=np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        m = int.from_bytes(raw[at : at + 8], "little")
        big = np.frombuffer(raw[at + 8 : at + 8 + 16 * m], np.int64)
        used = np.flatnonzero(flags[2])
        remainders, counts = np.zeros(size, dtype=U64), np.zeros(size, dtype=np.int64)
        remainders[used] = wide.view("<u8").ravel()
        one = np.ones(n, dtype=np.int64)
        one[big[:m]] = big[m:]
        counts[used] = one
        return cls(bits, flags[0], flags[1], remainders, counts, base)

    @classmethod
    def merge(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """Merge sorted remainders; counts of equal fingerprints add up."""
        parts = [f.entries() for f in filters]
        values = np.concatenate([p[0] for p in parts])
        counts = np.concatenate([p[1] for p in parts])
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, dtype=np.int64)
        return cls.build(values[first], np.add.reduceat(counts, first) if len(first) else counts)


def repeated(fingerprints: DataFrame, rows: int, *, column: str = "fp") -> DataFrame:
    """The fingerprints whose merged count is above one, with that count.

    ``rows`` sizes the ranges of quotients: each holds about ``RANGE_ROWS``
    fingerprints at any input size, since fingerprints are uniform.  Equal ones
    collapse to one counted entry in each partition before the shuffle.
    """
    bits = max(0, math.ceil(math.log2(max(1, rows / RANGE_ROWS))))
    bits = max(bits, 5)

    def build(batches):
        def cut(values, counts):
            top = (values >> U64(64 - bits)).astype(np.int64)
            edges = np.append(np.flatnonzero(np.append(True, top[1:] != top[:-1])), len(top))
            out = [(int(top[a]), QuotientFilter.build(values[a:b], counts[a:b]).to_bytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["range", "filter"])

        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(U64).copy())
            n += len(held[-1])
            if n >= HELD_ROWS:  # bounds a task's memory; the merge takes any number of filters
                yield cut(*np.unique(np.concatenate(held), return_counts=True))
                held, n = [], 0
        if n:
            yield cut(*np.unique(np.concatenate(held), return_counts=True))

    def merge(batches):
        def out(merged):
            values, counts = merged.entries()
            many = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(counts[many])], [column, "n"])

        now, merged = None, None
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = QuotientFilter.from_bytes(raw)
                if key != now and merged is not None:
                    yield out(QuotientFilter.merge(merged))
                    merged = None
                now, merged = key, [*(merged or []), new]
                if len(merged) >= 64:
                    merged = [QuotientFilter.merge(merged)]
        if merged is not None:
            yield out(QuotientFilter.merge(merged))

    filters = fingerprints.select(column).mapInArrow(build, "range int, filter binary")
    dealt = filters.repartition("range").sortWithinPartitions("range")
    return dealt.mapInArrow(merge, f"{column} long, n long")


def groups(documents: DataFrame, *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, row_no, keep_id, group_size, kept, text_sha256."""
    body = F.coalesce(F.col(text), F.lit(""))
    ledger = staged(
        documents.select(F.col(ident).alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.xxhash64(body).alias("fp"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("sha")),
        "ledger",
    )
    rows_in = ledger.count()
    again = staged(repeated(ledger, rows_in).select("fp"), "repeated", rows=rows_in)
    # Verification by bytes: equal whole texts, of the fingerprints that repeat.
    texts = documents.select(body.alias("body"), F.xxhash64(body).alias("fp"))
    checked = (
        screened(texts, F.col("fp"), again, F.col("fp"), "maybe")
        .where("maybe")  # a text whose fingerprint does not repeat has a group of one
        .groupBy("fp", "body")
        .agg(F.count("*").alias("group_size"))
        .select("fp", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("sha"), "group_size")
        .where("group_size > 1")
    )
    rows = ledger.join(again, "fp", "left_semi")
    stays = rows.groupBy("fp", "sha").agg(F.max(F.struct("doc_id", (-F.col("row_no")).alias("rank"))).alias("stay"))
    found = staged(checked.join(stays, ["fp", "sha"]), "groups", rows=rows_in)
    return ledger.join(found, ["fp", "sha"], "left").select(
        "doc_id",
        "row_no",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("stay.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | (F.col("stay.rank") == -F.col("row_no"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def survivors(documents: DataFrame, *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's own columns and rows, without the copies that don't stay.

    A row is dropped where a row of the same text with a larger doc_id exists.
    Repeats of one doc_id and text collapse to one row.
    """
    dropped = groups(documents, ident=ident, text=text).where("not kept").select("doc_id", F.unhex("text_sha256").alias("sha"), F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("same"))
    gone = staged(dropped, "dropped")
    keys = {"doc_id": F.col(f"`{ident}`"), "sha": F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256))}
    out = without(documents, staged(gone.where("not same").select("doc_id", "sha").distinct(), "copies"), keys)
    repeats = staged(gone.where("same").select("doc_id", "sha").distinct(), "repeats")
    if repeats.isEmpty():
        return out
    # One row of each repeated pair, whichever a partition sees first.
    ident_key, sha_key, row = free_names(out, "ident", "sha", "row")
    marked = out.withColumns({ident_key: keys["doc_id"], sha_key: keys["sha"]})
    listed = repeats.withColumnsRenamed({"doc_id": f"{ident_key}r", "sha": f"{sha_key}r"})
    twice = marked.join(listed, F.col(ident_key).eqNullSafe(F.col(f"{ident_key}r")) & (F.col(sha_key) == F.col(f"{sha_key}r")), "left_semi")
    one = twice.groupBy(ident_key, sha_key).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in out.columns))).alias(row))
    return without(out, repeats, keys).union(one.select(*(F.col(row).getField(c).alias(c) for c in out.columns)))
