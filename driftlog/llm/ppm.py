"""Language-model scores by prediction by partial matching over the bytes of whole texts.

A text is its tokens: words (runs of bytes other than ASCII white space, A-Z lower-cased) with a blank between two of them, and
an end mark, a line feed. Contexts are the `order` bytes before a byte, across words; before the text stand end marks. The
trie has all contexts of the training rows and is counted over every byte of them: at the full order by occurrences, and in
each shorter context by the longer contexts in which the byte occurred (update exclusion). A byte is coded at the longest
context that training has. With count c of n there, and q distinct bytes, it takes (2c - 1) / 2n; else the escape q / 2n leads
to the context one byte shorter, where the bytes of the longer one are excluded from n and q. Below the empty context all bytes
left are alike. A context without bytes left is passed by. So probabilities add up to one in every context. The model is
pretrained on the rows whose crc32(doc_id) mod 5 is not 1 and does not adapt; every row is scored, by all of its bytes.

Rows are copied into chunks (the tasks that read them). A chunk sends each of its distinct grams (context and byte) once, with
its count. The counts of a gram are added up, the codes of grams whose contexts end alike are worked out together, and each
chunk gets the codes of its own grams, as files in the shared folder: no task needs the whole trie, and what is shuffled are
the distinct grams of chunks, never texts. Trie and vocabulary grow with the corpus; nothing is pruned.

The word counts of the base score stand in a table; those of the `head` most frequent words (at most 64 bytes long) go with
the tasks, other words of a row are joined with the table.

Null text: as empty (one token, the end). Null ids: as an empty id text, so they train. Repeated rows: each counts and is
scored. No documents: an empty result; no training rows: every byte has 1/256. Other columns are ignored. Texts of any length
are worked on in pieces of `PIECE` bytes with the context before them.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binary_output import _store
from .common import discard, id_crc, new_path, rows_of, texts, written

END = b"\n"
PIECE = 1 << 20
_WORD = pa.schema([("word", pa.binary()), ("c", pa.int64())])
_SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rest", pa.list_(pa.struct([("word", pa.binary()), ("m", pa.int64())])))])


def tokens(text: str) -> list[bytes]:
    """The words of a text; the end token is not among them."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def pieces(words: list[bytes], order: int) -> list[bytes]:
    """The bytes of a text in pieces, each after the `order` bytes before it."""
    line = END * order + b" ".join(words) + END
    return [line[at : at + PIECE + order] for at in range(0, len(line) - order, PIECE)]


def grams(parts: list[bytes], order: int):
    """Each byte of the pieces behind its context, as one integer, and how many a piece has; numpy."""
    import numpy as np

    sizes = np.array([len(p) for p in parts])
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    out = raw.copy()
    for j in range(1, order + 1):
        out[j:] |= raw[:-j] << np.uint64(8 * j)
    inside = np.ones(len(raw), bool)
    inside[(np.cumsum(sizes) - sizes)[:, None] + np.arange(order)] = False
    return out[inside], sizes - order


def _added(keys: list, counts: list):
    """(distinct keys in order, sums of their counts) of arrays of keys and counts; numpy."""
    import numpy as np

    key, n = np.concatenate(keys), np.concatenate(counts)
    rank = np.argsort(key)
    key, n = key[rank], n[rank]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def counted(docs: DataFrame, order: int, most: int = 2_000_000) -> DataFrame:
    """g, n and chunk: the distinct grams of each chunk with their occurrences in training rows; about `most` are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        keys, counts, held, chunk = [], [], [[], []], None

        def count():
            for kind in (0, 1):
                if held[kind]:
                    found = np.sort(grams(held[kind], order)[0])
                    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
                    keys.append(found[first])
                    counts.append(np.diff(np.append(first, len(found))) * kind)
                    held[kind] = []
            if sum(map(len, keys)) > most and len(keys) > 1:
                keys[:], counts[:] = ([x] for x in _added(keys, counts))

        def out():
            count()
            if keys:
                key, n = _added(keys, counts)
                for i in range(0, len(key), 100_000):
                    yield pa.record_batch([pa.array(key[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000]), pa.array(np.full(len(key[i : i + 100_000]), chunk, np.int32))], names=["g", "n", "chunk"])
                keys.clear(), counts.clear()

        size = 0
        for batch in batches:
            for text, held_out, own in rows_of(batch):
                if own != chunk:
                    yield from out()
                    chunk = own
                parts = pieces(tokens(text), order)
                held[not held_out] += parts
                size += sum(map(len, parts))
                if size > PIECE:
                    count()
                    size = 0
        yield from out()

    return docs.select("text", "held_out", "chunk").mapInArrow(run, "g long, n long, chunk int")


class Level:
    """The contexts of `k` bytes: counts of their grams, in numpy. `lower` is the level below, with all grams that end these."""

    def __init__(self, k: int, keys, counts, lower: "Level | None"):
        import numpy as np

        self.k, self.keys, self.counts = k, keys, counts
        context = keys >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.empty(0, np.int64)
        self.contexts = context[first]
        self.n = np.add.reduceat(counts, first) if len(keys) else counts
        self.q = np.diff(np.append(first, len(keys)))
        # the count that this context's bytes have one level below, where they are excluded
        self.out = np.add.reduceat(lower.count(keys), first) if lower is not None and len(keys) else np.zeros(len(first), np.int64)

    def below(self):
        """Grams one byte shorter, each counted by the grams here that end with it."""
        import numpy as np

        return np.unique(self.keys & np.uint64((1 << 8 * self.k) - 1), return_counts=True)

    def _find(self, values, among):
        import numpy as np

        if not len(among):
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(among, values), len(among) - 1)
        return at, among[at] == values

    def count(self, grams_):
        """The counts here of grams of any length, by their last bytes."""
        import numpy as np

        at, hit = self._find(grams_ & np.uint64((1 << 8 * (self.k + 1)) - 1), self.keys)
        return np.where(hit, self.counts[at], 0) if len(self.keys) else np.zeros(len(grams_), np.int64)

    def context(self, grams_):
        """(n, q, excluded below) of the contexts of grams; zeros where training has none."""
        import numpy as np

        at, hit = self._find((grams_ >> np.uint64(8)) & np.uint64((1 << 8 * self.k) - 1), self.contexts)
        return tuple(np.where(hit, x[at], 0) if len(self.contexts) else np.zeros(len(grams_), np.int64) for x in (self.n, self.q, self.out))


def levels(keys, counts, order: int, low: dict) -> list[Level]:
    """The levels of `order` to 0 from the trained grams `keys`; those in `low` (k -> keys, counts) are complete there."""
    found = {order: (keys, counts)}
    for k in range(order, 0, -1):
        found[k - 1] = low[k - 1] if k - 1 in low else Level(k, *found[k], None).below()
    out: list[Level] = []
    for k in range(order + 1):
        out.append(Level(k, *found[k], out[-1] if out else None))
    return out


def code(asked, by_order: list[Level]):
    """log10 of the probability of the last byte of each gram after the bytes before it; numpy."""
    import numpy as np

    out, open_ = np.zeros(len(asked)), np.ones(len(asked), bool)
    gone = np.zeros(len(asked), np.int64)  # bytes and their count that a longer context excludes
    gone_n = np.zeros(len(asked), np.int64)
    for level in reversed(by_order):
        n, q, next_n = level.context(asked)
        c, total, left = level.count(asked), n - gone_n, q - gone
        live = open_ & (total > 0)
        hit = live & (c > 0)
        out[hit] += np.log10((2 * c[hit] - 1) / (2 * total[hit]))
        miss = live & ~hit
        out[miss] += np.log10(left[miss] / (2 * total[miss]))
        open_ &= ~hit
        gone, gone_n = q, next_n
    out[open_] -= np.log10(256 - gone[open_])
    return out


def codes(counts: DataFrame, order: int, most_low: int = 1_000_000, buffer: int = 300_000) -> DataFrame:
    """g and its code, from the counts of all grams.

    Grams whose contexts end in the same `near` bytes have all their longer contexts to themselves, and are worked out together,
    some `buffer` rows at a time. The counts of shorter contexts go with the tasks: of two bytes and less if they are at most
    `most_low` (12 bytes each), else of one byte and less, which are 65,792 at most; the codes are the same.
    """
    n, trained = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), counts.where("n > 0")
    ends = lambda c, size: F.col(c).bitwiseAND(F.lit((1 << 8 * size) - 1))
    for near in (3, 2):
        near = min(near, order)
        long = trained.select(ends("g", near + 1).alias("g"))
        shorter = long.distinct().groupBy(ends("g", near).alias("g")).agg(F.count("*").alias("n")) if near else long.limit(0).withColumn("n", F.lit(0))
        if near <= 2 or shorter.count() <= most_low:
            break
    table = shorter.orderBy("g").toArrow()
    first = (table.column("g").to_numpy(), table.column("n").to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        low, at = {}, near - 1
        found = first[0].astype(np.uint64), first[1].astype(np.int64)
        while at >= 0:
            low[at] = found
            found = Level(at, *found, None).below() if at else found
            at -= 1

        def out(keys, counts_):
            held = counts_ > 0
            return pa.record_batch([pa.array(keys.view(np.int64)), pa.array(code(keys, levels(keys[held], counts_[held], order, low)))], names=["g", "code"])

        keys, counts_ = np.empty(0, np.uint64), np.empty(0, np.int64)
        kept, size = [], 0
        for batch in batches:
            kept.append((batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy().astype(np.int64)))
            size += batch.num_rows
            if size < buffer:
                continue
            keys, counts_ = (np.concatenate(x) for x in zip(*kept))
            group = (keys >> np.uint64(8)) & np.uint64((1 << 8 * near) - 1)
            end = int(np.argmax(group == group[-1]))  # the last group may go on
            kept, size = [(keys[end:], counts_[end:])], len(keys) - end
            if end:
                rank = np.argsort(keys[:end])
                yield out(keys[:end][rank], counts_[:end][rank])
        if size:
            keys, counts_ = (np.concatenate(x) for x in zip(*kept))
            rank = np.argsort(keys)
            yield out(keys[rank], counts_[rank])

    group = F.shiftright("g", 8).bitwiseAND(F.lit((1 << 8 * near) - 1))
    return counts.select("g", "n", group.alias("near")).repartition(n, "near").sortWithinPartitions("near").select("g", "n").mapInArrow(run, "g long, code double")


def vocabulary(docs: DataFrame, most: int = 250_000) -> DataFrame:
    """word and c, its count in training rows (0 for words of other rows only); the end token is a line feed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        other: set = set()

        def out():
            rows = [*seen.items(), *((w, 0) for w in other if w not in seen)]
            for i in range(0, len(rows), 50_000):
                yield _batch(rows[i : i + 50_000], _WORD)
            seen.clear(), other.clear()

        for batch in batches:
            for text, held_out in rows_of(batch):
                own = tokens(text)
                own.append(END)
                (other if held_out else seen).update(own)
                if len(seen) + len(other) > most:
                    yield from out()
        yield from out()

    return docs.select("text", "held_out").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _codes_of(path: str, chunk: int):
    """(grams in order, their codes) of a chunk; numpy."""
    import numpy as np
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, base = _store(path)
    keys, values = [np.empty(0, np.uint64)], [np.empty(0)]
    for f in files.get_file_info(fs.FileSelector(f"{base}/chunk={chunk}")):
        if f.path.endswith(".parquet"):
            table = pq.ParquetFile(files.open_input_file(f.path)).read(["g", "code"])
            keys.append(table.column("g").to_numpy().astype(np.uint64))
            values.append(table.column("code").to_numpy())
    keys, values = np.concatenate(keys), np.concatenate(values)
    rank = np.argsort(keys)
    return keys[rank], values[rank]


def ppm_scores(docs: DataFrame, order: int = 5, head: int = 300_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document; `order` is 0 to 6."""
    if not 0 <= order <= 6:
        raise ValueError("order is 0 to 6: a gram and a number of its document share 64 bits")
    spark = docs.sparkSession
    held_out = F.pmod(id_crc(F.col("doc_id")), F.lit(5)) == 1
    rows = written(texts(docs).select("doc_id", "text", held_out.alias("held_out"), F.spark_partition_id().alias("chunk")), "chunks")
    words = written(vocabulary(rows), "words")
    own = written(counted(rows, order), "grams")
    counts = written(own.groupBy("g").agg(F.sum("n").alias("n")), "counts")
    coded = written(codes(counts, order), "codes")
    path, n = new_path(spark, "chunk-codes"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    own.select("g", "chunk").join(coded, "g").repartition(n, "chunk").write.partitionBy("chunk").parquet(path)
    discard(own, counts, coded)

    total, v = words.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    total, token = total or 0, uuid.uuid4().hex
    whole = total + 0.5 * (v + 1)
    top = words.where("c > 0").where(F.length("word") <= 64).orderBy(F.desc("c"), "word").limit(head).toArrow()
    shared = spark.sparkContext.broadcast(top.to_batches())  # at most `head` rows of 64 bytes and a number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from . import ppm

        kept = ppm.__dict__.setdefault("_kept", {})
        if token not in kept:
            kept.clear()
            kept[token] = {w: math.log10((c + 0.5) / whole) for b in shared.value for w, c in rows_of(b)}
        get, number = kept[token].get, TaskContext.get().partitionId() << 40
        bits, chunk, keys, values = 64 - 8 * (order + 1), None, None, None
        held: list = []  # rows without their score
        parts: list = []  # their pieces
        of: list = []  # and the row of each piece

        def out() -> pa.RecordBatch:
            found, sizes = grams(parts, order)
            mark = np.uint64((1 << bits) - 1)
            # sorted by gram, so that each distinct one is looked up once and in order
            both = np.sort((found << np.uint64(bits)) | np.repeat(np.array(of, np.uint64), sizes))
            gram = both >> np.uint64(bits)
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            value = values[np.searchsorted(keys, gram[first])]
            sums = np.bincount((both & mark).astype(np.int64), np.repeat(value, np.diff(np.append(first, len(both)))), len(held))
            batch = _batch([(*r[:6], s, r[6]) for r, s in zip(held, sums.tolist())], _SCORED)
            held.clear(), parts.clear(), of.clear()
            return batch

        size = 0
        for batch in batches:
            for doc_id, text, held_out, its in rows_of(batch):
                if its != chunk:
                    if held:
                        yield out()
                        size = 0
                    chunk = its
                    keys, values = _codes_of(path, chunk)
                line = tokens(text)
                parts_ = pieces(line, order)
                line.append(END)
                got = list(map(get, line))
                lost = Counter(w for w, x in zip(line, got) if x is None) if None in got else {}
                if lost:
                    got = [x for x in got if x is not None]
                of.extend([len(held)] * len(parts_))
                parts.extend(parts_)
                held.append((number, doc_id, held_out, len(line), len(got), math.fsum(got), [{"word": w, "m": m} for w, m in lost.items()]))
                number += 1
                size += sum(map(len, parts_))
                if size > PIECE or len(held) == 1 << bits:
                    yield out()
                    size = 0
        if held:
            yield out()

    scored = rows.select("doc_id", "text", "held_out", "chunk").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<struct<word:binary,m:long>>")
    done = written(scored, "scored")
    discard(rows)
    asked = done.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.m").join(words, "word")
    more = asked.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("more"), F.sum(F.col("m") * F.log10((F.col("c") + 0.5) / F.lit(whole))).alias("base_more"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return done.drop("rest").join(more, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + zero("base_more")).alias("base_score"), "score")
