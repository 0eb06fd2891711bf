"""Packing by the sum-of-squares rule.

Documents are cut into whole windows and one remainder.  A remainder is placed
online into the fill level that makes the sum of squared counts of partially
filled windows smallest: an array holds, for each level, how many windows are
filled to it, and placing ``size`` tokens at level ``h`` moves one window from
``h`` to ``h + size``.  Every input partition packs its own documents, without
a shuffle.  What is still partly filled at a partition's end is poured together
by cutting documents once more, and the one window that each partition has left
is packed with those of other partitions in a second, small pass.

Defined cases: a null or empty text is its end id alone, one token.  Repeated
rows are packed each for itself.  Very long texts give whole windows and a
remainder.  Of fill levels with equal sums of squares the fullest is taken.  An
empty table gives an empty result.  Other columns play no part, whatever their
names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged
from .tokens import END_ID, Encoder, tokenizer_path

WINDOW = 2048
#: Left windows of so many partitions meet in a task of the second pass.
LEFT_TOGETHER = 256

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, ids binary"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


class Packer:
    """Windows by fill level; a piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.at: list[list[list]] = [[] for _ in range(window + 1)]
        self._h = np.arange(window + 1)

    def level(self, size: int) -> int:
        """The fill level to place ``size`` at; zero opens a window.

        The sum of squares changes by the two levels that a window leaves and
        enters; level zero and the full level don't count.
        """
        room = self.window - size
        n = self.count
        enter = 2 * n[size : self.window + 1] + 1
        leave = 1 - 2 * n[: room + 1]
        change = enter + leave
        change[0] = enter[0]  # a new window leaves no level
        change[room] -= enter[room]  # a filled window enters none
        usable = n[: room + 1] > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        best = change.min()
        return int(np.flatnonzero(change == best)[-1])  # ties: the fullest

    def place(self, piece: tuple) -> list | None:
        """Place a piece; the window's pieces are returned when it is full."""
        size = len(piece[3]) // 4
        h = self.level(size)
        held = self.at[h].pop() if h else []
        if h:
            self.count[h] -= 1
        held.append(piece)
        if h + size == self.window:
            return held
        self.at[h + size].append(held)
        self.count[h + size] += 1
        return None

    def pour(self) -> tuple[list[list], list | None]:
        """Cut what is left into whole windows and one rest."""
        whole, now, fill = [], [], 0
        for h in range(self.window - 1, 0, -1):
            for held in self.at[h]:
                for doc_id, start, total, ids in held:
                    while fill + len(ids) // 4 >= self.window:
                        cut = (self.window - fill) * 4
                        now.append((doc_id, start, total, ids[:cut]))
                        whole.append(now)
                        now, fill = [], 0
                        start, ids = start + cut // 4, ids[cut:]
                    if ids:
                        now.append((doc_id, start, total, ids))
                        fill += len(ids) // 4
            self.at[h] = []
        self.count[:] = 0
        return whole, now or None


def _emit(windows: list[tuple[int, list]], keep_ids: bool = False) -> pa.RecordBatch:
    rows = []
    for number, pieces in windows:
        offset = 0
        for doc_id, start, total, ids in pieces:
            rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, number, offset, ids if keep_ids else None))
            offset += len(ids) // 4
    columns = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.binary())], _NAMES)


def pack(documents: DataFrame, *, ident: str = "doc_id", text: str = "text", window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to.

    ``padded_to`` is the length that the sequence is padded to: its own if
    that is a power of two, else ``window``.
    """
    path = tokenizer or tokenizer_path()
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def first(batches):
        encoder, packer = Encoder.of(path), Packer(window)
        base = TaskContext.get().partitionId() << 32
        number = 0
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            done: list[tuple[int, list]] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                ids += end
                total = len(ids) // 4
                whole = total - total % window
                full = [[(doc_id, at, total, ids[4 * at : 4 * (at + window)])] for at in range(0, whole, window)]
                if whole < total and (held := packer.place((doc_id, whole, total, ids[4 * whole :]))):
                    full.append(held)
                done += [(base + number + k, w) for k, w in enumerate(full)]
                number += len(full)
            yield _emit(done)
        whole, rest = packer.pour()
        yield _emit([(base + number + k, w) for k, w in enumerate(whole)])
        if rest:
            yield _emit([(base + number + len(whole), rest)], keep_ids=True)

    def second(batches):
        packer = Packer(window)
        number, done = None, []
        for batch in batches:
            for r in batch.to_pylist():
                number = r["sequence_id"] if number is None else min(number, r["sequence_id"])
                if held := packer.place((r["doc_id"], r["start"], r["doc_tokens"], r["ids"])):
                    done.append(held)
        whole, rest = packer.pour()
        done += whole + ([rest] if rest else [])
        if number is not None:
            base = number | 1 << 31  # numbers that the first pass can't have given
            yield _emit([(base + k, w) for k, w in enumerate(done)])

    rows = documents.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    once = staged(rows.mapInArrow(first, _SCHEMA), "packed")
    left = once.where("ids is not null").withColumn("group", F.shiftright("sequence_id", 32).cast("long") % F.lit(1 << 20))
    dealt = left.repartition(F.floor(F.col("group") / LEFT_TOGETHER)).sortWithinPartitions("sequence_id", "offset").drop("group")
    again = staged(dealt.mapInArrow(second, _SCHEMA), "packed-left")
    pieces = once.where("ids is null").unionByName(again).drop("ids")
    fills = again.groupBy("sequence_id").agg(F.sum("length").alias("fill")).where(F.col("fill") < window)
    power = F.col("fill").bitwiseAND(F.col("fill") - 1) == 0
    padded = F.when(F.col("fill").isNotNull() & power, F.col("fill")).otherwise(window).cast("long")
    return pieces.join(fills, "sequence_id", "left").withColumn("padded_to", padded).drop("fill")
