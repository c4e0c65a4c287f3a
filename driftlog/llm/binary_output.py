"""Token ids in Arrow files of fixed-size-list batches: equal-length sequences and masks with random access.

Each shard holds one ascending range of documents. `ids-N.arrow` is an Arrow IPC file (record batches with a footer, not
compressed, so a memory map serves any sequence without a copy) with the columns `ids` (fixed-size list of `seq_len`
unsigned integers, 16 bits wide where the vocabulary allows) and `mask` (fixed-size list of booleans, false only in the
padding of the shard's last sequence). `docs-N.arrow` has doc_id and n_tokens in the same order.

Null text: as empty (its one id is the end id). Null doc_id: first. Repeated doc_ids: each row is written, in the order of
their texts. No documents: no shards and an empty result. Other columns are ignored. Long texts are whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import new_path, rows_of, texts
from .tokenizing import cached, default_path

_SHARD = "shard string, docs string, first_id long, n_docs long, n_ids long"
_DOCS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Shard:
    """Writes one shard under names of its own attempt, then renames: a task that runs again replaces the files."""

    def __init__(self, root: str, number: int, attempt: int, seq_len: int, width: int, rows: int = 64):
        self.files, base = _store(root)
        self.files.create_dir(base, recursive=True)
        self.to = [f"{base}/{kind}-{number:06d}.arrow" for kind in ("ids", "docs")]
        self.tmp = [f"{p}.{attempt}" for p in self.to]
        self.kind, self.seq_len, self.width, self.room = (pa.uint16() if width == 2 else pa.uint32()), seq_len, width, rows * seq_len * width
        self.schema = pa.schema([("ids", pa.list_(self.kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.out = [self.files.open_output_stream(p) for p in self.tmp]
        self.ids, self.docs = (pa.ipc.new_file(o, s) for o, s in zip(self.out, (self.schema, _DOCS)))
        self.buffer, self.index, self.n_docs, self.n_ids, self.first = bytearray(), [], 0, 0, None

    def _batch(self, raw: bytes, n: int) -> None:
        import numpy as np

        values = pa.Array.from_buffers(self.kind, len(raw) // self.width, [None, pa.py_buffer(raw)])
        mask = pa.array(np.arange(len(values)) < n)
        self.ids.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(x, self.seq_len) for x in (values, mask)], schema=self.schema))

    def add(self, doc_id: int, ids) -> None:
        self.buffer += ids.astype(f"<u{self.width}").tobytes()
        self.first = doc_id if self.first is None else self.first
        self.n_docs, self.n_ids = self.n_docs + 1, self.n_ids + len(ids)
        self.index.append((doc_id, len(ids)))
        if len(self.index) >= 8192:
            self._docs()
        while len(self.buffer) >= self.room:
            self._batch(bytes(self.buffer[: self.room]), self.room // self.width)
            del self.buffer[: self.room]

    def _docs(self) -> None:
        self.docs.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*self.index)], schema=_DOCS))
        self.index = []

    def close(self) -> tuple:
        if self.buffer:
            n, step = len(self.buffer) // self.width, self.seq_len * self.width
            self._batch(bytes(self.buffer) + b"\0" * (-len(self.buffer) % step), n)
        if self.index:
            self._docs()
        for x in (self.ids, self.docs, *self.out):
            x.close()
        for a, b in zip(self.tmp, self.to):
            self.files.move(a, b)
        return (*self.to, self.first, self.n_docs, self.n_ids)


def write_ids(docs: DataFrame, root: str, tokenizer: str, end_id: int = 2, seq_len: int = 1024) -> DataFrame:
    """Writes the shards; a row for each: its two files, first doc_id, documents and ids. Run it once: it has side effects.

    One range shuffle of the texts puts documents in ascending order; ids are never shuffled.
    """
    width = 2 if max(cached(tokenizer).size, end_id + 1) <= 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        words, shard, task = cached(tokenizer), None, TaskContext.get()
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for doc_id, text in rows_of(batch):
                if shard is None:
                    shard = _Shard(root, task.partitionId(), task.taskAttemptId(), seq_len, width)
                shard.add(doc_id, np.frombuffer(words.encode(text) + end, "<u4"))
        if shard is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "docs", "first_id", "n_docs", "n_ids"), shard.close()))], pa.schema([("shard", pa.string()), ("docs", pa.string()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, _SHARD)


def read_documents(shard: str, index: str) -> Iterator[tuple[int, "np.ndarray"]]:
    """(doc_id, ids) of a shard in order, batch by batch; a shard on a local disk is memory-mapped."""
    import numpy as np

    def opened(path: str):
        files, name = _store(path)
        return pa.memory_map(name) if files.type_name == "local" else files.open_input_file(name)

    with opened(shard) as a, opened(index) as b:
        ids, docs = pa.ipc.open_file(a), pa.ipc.open_file(b)
        rest, at = np.empty(0, "<u4"), 0
        for k in range(docs.num_record_batches):
            for doc_id, n in rows_of(docs.get_batch(k)):
                parts = [rest]
                have = len(rest)
                while have < n:
                    batch = ids.get_batch(at)
                    at += 1
                    mask = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                    parts.append(batch.column(0).flatten().to_numpy()[mask].astype("<u4"))
                    have += len(parts[-1])
                rest = np.concatenate(parts) if len(parts) > 1 else rest
                yield doc_id, rest[:n]
                rest = rest[n:]


def read_ids(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the shards' files.

    The shard rows (one per partition) come to the driver for the running total of ids; documents do not.
    """
    spark, start, rows = shards.sparkSession, 0, []
    for r in sorted(shards.collect(), key=lambda r: r["shard"]):
        rows.append((r["shard"], r["docs"], start))
        start += r["n_ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, index, begin in rows_of(batch):
                out = []
                for doc_id, ids in read_documents(shard, index):
                    out.append((doc_id, begin, len(ids), zlib.crc32(ids.tobytes())))
                    begin += len(ids)
                    if len(out) >= 8192:
                        yield _result(out)
                        out = []
                if out:
                    yield _result(out)

    frame = spark.createDataFrame(rows, "shard string, docs string, start long")
    return frame.repartition(max(1, len(rows))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _result(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def encode_to_files(docs: DataFrame, tokenizer: str | None = None, root: str | None = None, end_id: int = 2, seq_len: int = 1024) -> DataFrame:
    """Encodes, writes and reads back: one row per document from the files in `root` (a new shared folder if not given)."""
    root = root or new_path(docs.sparkSession, "token-ids")
    return read_ids(write_ids(docs, root, tokenizer or default_path(), end_id, seq_len))
