"""Best-fit packing of token sequences: online, with a fixed number of open bins in a bitset keyed by free space.

A piece goes to the open bin with the least free space that holds it. Where none does and all `open_bins` are open, the
fullest bin closes and a new one opens. A piece as long as a sequence takes one of its own.

Null text: as empty (one id, the end id). Repeated doc_ids: each row is packed. No documents: an empty result. Other columns
are ignored. Texts of any length are cut into whole pieces; nothing is dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, texts, written
from .tokenizing import cached, default_path

_PIECES = ("doc_id", "piece", "start", "length", "ids_crc32")
_PIECE_TYPES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PLACED = pa.schema([*_PIECE_TYPES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Bins:
    """Open bins by free space; bit f of `mask` is set where a bin with f free tokens is open."""

    def __init__(self, capacity: int, open_bins: int, first: int = 0):
        self.capacity, self.open_bins, self.next, self.n_open = capacity, open_bins, first, 0
        self.mask, self.by_free = 0, [[] for _ in range(capacity + 1)]

    def _put(self, free: int, number: int) -> None:
        self.by_free[free].append(number)
        self.mask |= 1 << free
        self.n_open += 1

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask &= ~(1 << free)
        self.n_open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.mask & -self.mask).bit_length() - 1)
            free, number, self.next = self.capacity, self.next, self.next + 1
        if free > length:
            self._put(free - length, number)
        return number, self.capacity - free


def pieces(docs: DataFrame, capacity: int, end_id: int, tokenizer: str) -> DataFrame:
    """The pieces of each document with the crc of their ids; no shuffle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, step = cached(tokenizer), end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            out = []
            for doc_id, text in rows_of(batch):
                raw = words.encode(text) + end
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), _PIECE_TYPES.types)], schema=_PIECE_TYPES)

    return texts(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, open_bins: int = 1024, group_tokens: int = 1 << 26, max_groups: int = 20_000) -> DataFrame:
    """A row per piece with sequence_id and offset.

    Texts are tokenized where they are read; only the pieces' numbers (some 30 bytes each) are written and shuffled. Pieces
    are dealt by a hash into groups of about `group_tokens` tokens, packed apart, so each group leaves at most `open_bins`
    sequences unfilled; memory is that of the open bins. The number of groups grows with the tokens up to `max_groups`; beyond
    that (1.3e12 tokens) groups grow instead, and only take longer: a group is a stream past the open bins.
    """
    cut = written(pieces(docs, capacity, end_id, tokenizer or default_path()), "pieces")
    total = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, min(max_groups, round(total / group_tokens)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bins = None, None
        for batch in batches:
            out = []
            for row in rows_of(batch):
                if row[5] != group:
                    group, bins = row[5], Bins(capacity, open_bins, row[5] << 40)
                out.append((*row[:5], *bins.place(row[3])))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), _PLACED.types)], schema=_PLACED)

    mixed = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = cut.withColumn("grp", F.pmod(mixed, F.lit(groups)).cast("long")).withColumn("ord", F.xxhash64(mixed))
    ordered = dealt.repartition(groups, "grp").sortWithinPartitions("grp", "ord", "doc_id", "piece", "start", "ids_crc32")
    return ordered.select(*_PIECES, "grp").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
