"""Packing of token sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .encode import encoder, ids_bytes
from .shared import pick, slices

PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, at most counts[l] of each l, whose sum comes closest to capacity from below.

    Bit s of an integer says that sum s can be reached.  A count is split into
    powers of two, each a shift; the bits before each shift are kept, and
    walking back over them tells how often each length is used.
    """
    reach, steps, goal = 1, [], 1 << capacity
    full = (goal << 1) - 1
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left > 0:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= (reach << length * part) & full
            left, part = left - part, 2 * part
        if reach & goal:
            break
    total, used = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            total -= length * part
            used[length] = used.get(length, 0) + part
    return used


class Packer:
    """Fills sequences of `size` ids from documents that come one after another.

    A document's whole windows of `size` ids become sequences of their own;
    what remains waits by length.  A window takes the longest waiting rest and
    the multiset of others that fills it closest; the same multiset is used as
    often as the counts allow.  A gap that no multiset fills is closed by
    cutting a rest.  What waits in the end, fewer ids than a window, is cut
    into sequences of powers of two.  So no sequence needs padding, and no more
    waits between calls of `pack` than a window holds.
    """

    def __init__(self, size: int, first: int):
        self.size, self.sequence = size, first
        self.waiting: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def piece(self, rest: tuple, sequence: int, offset: int, length: int) -> None:
        doc_id, tokens, start, ids = rest
        self.rows.append((doc_id, start, length, zlib.crc32(ids[: 4 * length]), tokens, sequence, offset))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        tokens, whole = len(ids) // 4, len(ids) // 4 // self.size * self.size
        for start in range(0, whole, self.size):
            self.piece((doc_id, tokens, start, ids[4 * start : 4 * (start + self.size)]), self.sequence, 0, self.size)
            self.sequence += 1
        if tokens > whole:
            self.waiting.setdefault(tokens - whole, []).append((doc_id, tokens, whole, ids[4 * whole :]))

    def close(self, used: dict[int, int]) -> None:
        offset = 0
        for length, n in used.items():
            for _ in range(n):
                self.piece(self.take(length), self.sequence, offset, length)
                offset += length
        self.sequence += 1

    def take(self, length: int) -> tuple:
        rest = self.waiting[length].pop()
        if not self.waiting[length]:
            del self.waiting[length]
        return rest

    def cut(self, at: int) -> None:
        """Cut the shortest waiting rest that is longer than `at` after `at` ids."""
        length = min(x for x in self.waiting if x > at)
        doc_id, tokens, start, ids = self.take(length)
        self.waiting.setdefault(at, []).append((doc_id, tokens, start, ids[: 4 * at]))
        self.waiting.setdefault(length - at, []).append((doc_id, tokens, start + at, ids[4 * at :]))

    def pack(self) -> None:
        """Close windows until what waits is less than one."""
        while self.waiting:
            longest = max(self.waiting)
            counts = {k: len(v) - (k == longest) for k, v in self.waiting.items() if len(v) > (k == longest)}
            used = fill(counts, self.size - longest)
            used[longest] = used.get(longest, 0) + 1
            gap = self.size - sum(k * n for k, n in used.items())
            if not gap:
                for _ in range(min(len(self.waiting[k]) // n for k, n in used.items())):
                    self.close(used)
                continue
            # the fill being closest, whatever it leaves over is longer than the gap
            spare = {k for k, v in self.waiting.items() if len(v) > used.get(k, 0)}
            if not spare:
                break
            self.cut_spare(used, gap)

    def cut_spare(self, used: dict[int, int], gap: int) -> None:
        """Close `used` with `gap` ids cut off the shortest rest that it leaves over."""
        held = {k: [self.take(k) for _ in range(n)] for k, n in used.items()}
        self.cut(gap)
        for k, v in held.items():
            self.waiting.setdefault(k, []).extend(v)
        self.close({k: used.get(k, 0) + (k == gap) for k in {*used, gap}})

    def tail(self) -> None:
        """Lay out what waits end to end: whole windows, then powers of two."""
        rests = [x for k in sorted(self.waiting, reverse=True) for x in self.waiting[k]]
        self.waiting = {}
        left = sum(len(x[3]) // 4 for x in rests)
        room = offset = 0
        for doc_id, tokens, start, ids in rests:
            while ids:
                if not room:
                    room, offset = min(self.size, 1 << left.bit_length() - 1), 0
                n = min(room, len(ids) // 4)
                self.piece((doc_id, tokens, start, ids), self.sequence, offset, n)
                ids, start, room, offset, left = ids[4 * n :], start + n, room - n, offset + n, left - n
                self.sequence += not room


def pack(docs: DataFrame, *, tokenizer: str, end_id: int = 0, size: int = 1024, window: int = 4096) -> DataFrame:
    """Pieces of documents in sequences of `size` ids (a power of two), without padding.

    Input: `doc_id` (integer) and `text`; further columns are ignored.  A null
    text counts as empty: a document of `end_id` alone.  Repeated rows are
    packed as often as they occur; an empty table gives no pieces.  Output: one
    row a piece, with the place of its ids in the document (start, length,
    doc_tokens), their crc32 and their place in a sequence (sequence_id,
    offset).  A sequence holds `size` ids, or fewer by a power of two.

    Each input partition packs its own documents, a window of `window`
    documents at a time, in bounded memory, with sequence ids of its own; so
    nothing is shuffled and a lost task is simply run again.  Only a
    partition's last ids, fewer than `size`, form shorter sequences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, 300_000), ids_bytes([end_id])
        packer, n = Packer(size, TaskContext.get().partitionId() << 40), 0
        for batch in slices(batches, "text", 1_500_000):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text")), strict=True):
                packer.add(doc_id, ids + end)
            n += batch.num_rows
            if n >= window:
                packer.pack()
                n = 0
            yield from _rows(packer)
        packer.pack()
        packer.tail()
        yield from _rows(packer)

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, PIECE_SCHEMA)


def _rows(packer: Packer) -> Iterator[pa.RecordBatch]:
    rows, packer.rows = packer.rows, []
    if rows:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)
