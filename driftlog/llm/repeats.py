"""Repeated passages by sorted hashes at sampled suffixes; in place of a suffix array, suffixes are not sorted by their words.

Of each document's suffixes (by words) only those at minimisers stay: the smallest hash of `anchor` words in every window of
`window` places, the rightmost on ties. Two equal passages of anchor + window - 1 words (50) keep a suffix at the same place
in both. The kept suffixes are range-sorted by the hash of their first words, document and place; equal neighbours form
runs. Each member of a run is matched with the first of the run, also where the run crosses tasks (the tasks' first rows
tell), and the match is extended left and right, word by word.

Members of a run may agree with each other in more words than with the first. A match that holds all passages of `least`
words which have the member as their minimiser settles the member: what equals it there equals the first too. Of all other
members, and of further places of a first document, the passages of `least` words are sorted in the same way, and each is
matched with the first of its own run. So every passage of `least` words that an earlier document has is found, for any split
into tasks, if `least` is anchor + window - 1 or more.

Words are text between white space, as it is. Matches within one document are no repeats. Null text: as empty. Null ids come
first in order and stay null. Repeated rows (equal id and text) are one document; an id with several texts has a result for
each. Documents without repeats have no rows. Empty tables: an empty result. Other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import WordHashes, compare, discard, mix, packed, pick_texts, rows_of, small, texts, written

ANCHOR, WINDOW, LEAST = 40, 11, 50
_WORD = re.compile(r"\S+")


def _grams(hashes, size: int):
    """Hashes of the runs of `size` words; numpy."""
    import numpy as np

    n = len(hashes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    # sums of windows by powers of an odd base: all arithmetic is modulo 2**64, where such a base has an inverse
    base = 0x9E3779B97F4A7C15
    power = np.full(len(hashes), base, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * power, dtype=np.uint64)])
    return mix((total[size:] - total[:-size]) * inverse)


def _minimisers(grams, window: int):
    """The place of the minimiser of each window, by the window's first place."""
    import numpy as np

    span, n = min(window, len(grams)), len(grams)
    view = np.lib.stride_tricks.sliding_window_view(grams[::-1], span)
    return (n - 1 - (np.arange(len(view)) + view.argmin(1)))[::-1]


def suffixes(hashes, anchor: int, window: int):
    """(places, hashes of `anchor` words there) of the minimisers; numpy."""
    import numpy as np

    grams = _grams(hashes, anchor)
    if not len(grams):
        return np.empty(0, np.int64), grams
    places = np.unique(_minimisers(grams, window))
    return places, grams[places]


def passages(hashes, ats, anchor: int, window: int, least: int):
    """(places, hashes of `least` words there) of the passages whose first window has its minimiser among `ats`; numpy."""
    import numpy as np

    grams = _grams(hashes, least)
    if not len(grams):
        return np.empty(0, np.int64), grams
    own = _minimisers(_grams(hashes, anchor), window)
    places = np.flatnonzero(np.isin(own[np.minimum(np.arange(len(grams)), len(own) - 1)], ats))
    return places, grams[places]


def _key(doc_id: str = "doc_id", text: str = "text"):
    """Orders documents by id, nulls first, then tells texts of one id apart; a column."""
    number = F.lpad(F.hex(F.col(doc_id).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("1"), number), F.lit("0" * 17)), F.lpad(F.hex(F.xxhash64(F.coalesce(F.col(text), F.lit("")))), 16, "0"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_key().alias("key"), "text")


def kept_suffixes(docs: DataFrame, anchor: int, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hashes = WordHashes()
        for batch in batches:
            keys, at, grams = [], [], []
            for key, text in rows_of(batch):
                places, own = suffixes(hashes.array(text.split()), anchor, window)
                if len(places):
                    keys += [key] * len(places)
                    at.append(places)
                    grams.append(own.view(np.int64))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(grams)), pa.array(keys, pa.string()), pa.array(np.concatenate(at).astype(np.int32))], names=["g", "key", "at"])

    return _keyed(docs).mapInArrow(run, "g long, key string, at int")


def long_passages(found: DataFrame, anchor: int, window: int, least: int) -> DataFrame:
    """The passages of `least` words of rows key, text, ats (places of suffixes in runs), as rows like those of suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hashes = WordHashes()
        for batch in batches:
            for i in range(batch.num_rows):  # one text at a time as Python values
                key, text, ats = (c[i].as_py() for c in batch.columns)
                places, own = passages(hashes.array(text.split()), np.array(ats), anchor, window, least)
                if len(places):
                    keys = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(places), np.int32)), pa.array([key], pa.string())).cast(pa.string())
                    yield pa.record_batch([pa.array(own.view(np.int64)), keys, pa.array(places.astype(np.int32))], names=["g", "key", "at"])

    return found.mapInArrow(run, "g long, key string, at int")


_MATCH = "g long, key string, at int, first string, first_at int"
_SPAN = "key string, first_key string, start long, end long, first_start long"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted suffixes: each that is not the first of its run with that first; and, without a first, the task's first row
    and the first row of its last run, which may go on in later tasks.
    """
    import numpy as np

    last, names = None, ["g", "key", "at", "first", "first_at"]
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32())
    edge = lambda row: pa.record_batch([pa.array([c], t) for c, t in zip((*row, None, None), kinds)], names=names)
    for batch in batches:
        g, keys, at = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
        if not len(g):
            continue
        row = lambda i: (int(g[i]), keys[i].as_py(), at[i].as_py())  # noqa: B023, E731
        new = np.concatenate([[last is None or g[0] != last[0]], g[1:] != g[:-1]])
        if last is None:
            yield edge(row(0))
        start = np.maximum.accumulate(np.where(new, np.arange(len(g)), -1))
        inside = np.flatnonzero(~new)
        n = int((start[inside] < 0).sum())  # in a run that began in an earlier batch
        if n:
            yield pa.record_batch([batch.column(0)[:n], keys[:n], at[:n], pa.array([last[1]] * n, kinds[3]), pa.array([last[2]] * n, kinds[4])], names=names)
        inside = inside[n:]
        if len(inside):
            members, firsts = batch.take(pa.array(inside)), batch.take(pa.array(start[inside]))
            yield pa.record_batch([*(members.column(i).cast(kinds[i]) for i in range(3)), firsts.column(1).cast(kinds[3]), firsts.column(2).cast(kinds[4])], names=names)
        if start[-1] >= 0:
            last = row(int(start[-1]))
    if last is not None:
        yield edge(last)


def _matched(rows: DataFrame, name: str) -> DataFrame:
    """key, at, first, first_at: the rows g, key, at with the first of equal g, wherever there are several; written."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = written(rows.repartitionByRange(n, "g", "key", "at").sortWithinPartitions("g", "key", "at").mapInArrow(_neighbours, _MATCH), name + "-runs")
    # a run that crosses tasks began at the least of their first rows and of the first rows of their last runs: two rows a task
    starts = written(runs.where("first is null").groupBy("g").agg(F.min(F.struct("key", "at")).alias("f")), name + "-starts")
    side = F.broadcast(starts) if small(starts, 128) else starts
    met = runs.join(side, "g", "left").select("key", "at", F.coalesce("f.key", "first").alias("first"), F.coalesce("f.at", "first_at").alias("first_at"))
    out = written(met.where("key != first or at != first_at"), name)
    discard(runs, starts)
    return out


class _Extend:
    """Matches of a member with the center, grown left and right from the matched places.

    A row (key, first_key, start, end, first_start) for each match of `least` words, and a row (key, null, place, ...) for each
    place that is not settled: where some passage that has it as its minimiser ends beyond the match.
    """

    def __init__(self, size: int, least: int, window: int):
        self.size, self.least, self.window = size, least, window

    def center(self, text: str) -> None:
        self.words = text.split()

    def member(self, a, b, payload, text):
        mine, other, found = text.split(), self.words, {}
        for part in payload.split(" "):
            at, there = map(int, part.split(":"))
            shift = at - there
            lo, hi = found.get(shift, (0, -1))
            if at + self.size > hi:
                if mine[at : at + self.size] != other[there : there + self.size]:  # equal hashes of other words
                    yield b, None, at, at, at
                    continue
                lo, hi = at, at + self.size
                stop = max(0, shift)
                while lo > stop and mine[lo - 1] == other[lo - 1 - shift]:
                    lo -= 1
                stop = min(len(mine), len(other) + shift)
                while hi < stop and mine[hi] == other[hi - shift]:
                    hi += 1
                found[shift] = lo, hi
                if hi - lo >= self.least:
                    yield b, a, lo, hi, lo - shift
            if max(0, at - self.window + 1) < lo or min(len(mine), at + self.least) > hi:
                yield b, None, at, at, at


def _extended(matched: DataFrame, found: DataFrame, size: int, least: int, window: int, name: str) -> DataFrame:
    """The rows of _Extend for the matches (key, at, first, first_at) of different documents, written."""
    # of neighbours at one distance only the first is kept where places follow each other by one word: its extension has the
    # others; the distance stands in the upper half, so that the hashes of long values in a set do not meet
    place = F.shiftleft((F.col("at") - F.col("first_at")).cast("long"), 32) + F.col("at")
    pairs = matched.where("first != key").groupBy(F.col("first").alias("a"), F.col("key").alias("b")).agg(F.collect_list(place).alias("p"))
    alone = F.col("p") if window > 1 else F.array_except("p", F.transform("p", lambda x: x + 1))
    alone = F.array_sort(F.transform(alone, lambda x: F.struct(x.bitwiseAND(F.lit((1 << 32) - 1)).alias("at"), F.shiftright(x, 32).alias("shift"))))
    pairs = pairs.select("a", "b", F.array_join(F.transform(alone, lambda x: F.concat(x["at"].cast("string"), F.lit(":"), (x["at"] - x["shift"]).cast("string"))), " ").alias("payload"))
    pairs = written(pairs, name + "-pairs")
    out = written(compare(pairs, found, lambda: _Extend(size, least, window), _SPAN), name)
    discard(pairs)
    return out


def repeats(docs: DataFrame, anchor: int = ANCHOR, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """key, first_key, start, end, first_start: words start..end of a document stand in an earlier one (by id) at first_start.

    Shuffled are the kept suffixes (about a sixth of the words, some 30 bytes each), the texts with matches, and the passages of
    `least` words around the suffixes that the first match does not settle.
    """
    docs = texts(docs)
    kept = written(kept_suffixes(docs, anchor, window), "suffixes")
    met = _matched(kept, "matches")
    keys = written(met.select("key").union(met.select("first")).distinct(), "keys")
    found = pick_texts(_keyed(docs), keys, F.col("key"))
    spans = _extended(met, found, anchor, least, window, "spans")
    # members that are still open, the places of their firsts, and further places of a first document
    open_ = spans.where("first_key is null").select("key", F.col("start").cast("int").alias("at"))
    again = met.where("first = key").select("key", "at")
    ats = written(open_.union(again).groupBy("key").agg(F.collect_set("at").alias("ats")), "places")
    longer = written(long_passages(found.join(ats, "key").select("key", "text", "ats"), anchor, window, least), "passages")
    more = _matched(longer, "passage-matches")
    late = _extended(more, found, least, least, 1, "late-spans")
    discard(kept, met, keys, found, ats, longer, more)
    # of matches with the same bounds the earliest document counts
    both = spans.union(late).where("first_key is not null").groupBy("key", "start", "end").agg(F.min(F.struct("first_key", "first_start")).alias("f"))
    return both.select("key", "f.first_key", "start", "end", "f.first_start")


def _id(key: str):
    """The doc_id of a key."""
    number = F.conv(F.substring(key, 2, 16), 16, 10).cast("decimal(20,0)") - F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(F.substring(key, 1, 1) == "1", number.cast("long"))


def repeated_passages(docs: DataFrame, **params) -> DataFrame:
    """doc_id, first_doc_id, start, n_words, first_start of each repeated passage, by words; the earlier place is the first."""
    spans = repeats(docs, **params)
    return spans.select(_id("key").alias("doc_id"), _id("first_key").alias("first_doc_id"), "start", (F.col("end") - F.col("start")).alias("n_words"), "first_start")


def without_repeats(docs: DataFrame, **params) -> DataFrame:
    """`docs` with repeated passages cut out of all but their first documents; n_chars follows if there is one.

    A document left without words goes. Text around a cut stays as it is.
    """
    spans = repeats(docs, **params)
    cuts = spans.groupBy(F.col("key").alias("cut_key")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts"))
    names, at_text = docs.columns, docs.columns.index("text")

    def cut_text(text: str, spans_: list) -> str:
        at = [m.start() for m in _WORD.finditer(text)] + [len(text)]
        parts, begin = [], 0
        for s in spans_:
            if at[s["start"]] > begin:
                parts.append(text[begin : at[s["start"]]])
            begin = max(begin, at[s["end"]])
        return "".join(parts) + text[begin:]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                fields, spans_ = batch.column(0).flatten(), batch.column(1).to_pylist()
                out = [cut_text(t, s) if s else t for t, s in zip(fields[at_text].to_pylist(), spans_)]
                keep = pa.array([not s or bool(t.split()) for t, s in zip(out, spans_)], pa.bool_())
                fields[at_text] = pa.array(out, pa.string())
                row = pa.StructArray.from_arrays(fields, fields=list(batch.schema.field(0).type))
                yield pa.record_batch([row], names=["row"]).filter(keep)

    keyed = packed(docs, _key().alias("key"))
    joined = keyed.join(cuts, F.col("key") == F.col("cut_key"), "left").select("row", "cuts")
    out = joined.mapInArrow(cut, StructType([StructField("row", docs.schema)])).select("row.*")
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out
