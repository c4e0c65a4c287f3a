"""Near-duplicate classes by BagMinHash: weighted-Jaccard signatures, banding, and an exact check of multiset overlap.

A document is the multiset of its five-word shingles. The weights (counts) are discretised to whole levels, and the levels of
a shingle are split into dyadic blocks (0,1], (1,2], (2,4], ...; each block is a Poisson process whose rate is its width.
A point falls on a component of the signature and on a level of its block, and counts if the document's weight reaches that
level. The first time per component is the signature: two documents agree in a component with a probability equal to their
weighted Jaccard similarity. Points are drawn in order up to a time by which all components have one (doubled where not), so
a document costs its shingles and a fixed number of points.

Equal texts collapse first. Texts that agree in a band are candidates. In each band the text with the most company is the
center; members are compared with it exactly. Then only pairs in a band from different components are still open. Their
signatures (no texts) are compared in blocks of rows, in the first band that they share; the rows of a block with a partner
whose agreement is not four standard deviations below that of the threshold get their texts, and such pairs are compared
exactly there, unless links found before join them. Groups of copies are never expanded into rows of pairs. A pair of
similarity 0.8 is lost with a probability below 0.0001 (bands and agreement together).

Words are lower-cased text between white space. Texts of fewer than five words are one shingle. Null text: as empty; empty
texts are equal texts. Null ids get the class id of their class (null if it has no other). Repeated rows: a row each. Empty
tables: an empty result. Other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, compare, discard, mix, packed, pick_texts, rolled, rows_of, spread, texts, written
from .components import components

SHINGLE = 5


def signatures(shingles: list, m: int):
    """(documents x m) first times of the multisets, each an array of shingle hashes with at least one; all at once in numpy."""
    import numpy as np

    sizes = np.array([len(s) for s in shingles])
    of = np.repeat(np.arange(len(shingles)), sizes)
    flat = np.concatenate(shingles)
    _, first, weight = np.unique(flat ^ mix(of.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
    doc, shingle = of[first], flat[first]
    top = np.ceil(np.log2(weight)).astype(np.int64)  # the block that the weight ends in
    row = np.repeat(np.arange(len(doc)), top + 1)
    block = np.arange(len(row)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    doc, shingle, weight = doc[row], shingle[row], weight[row]
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)  # levels low+1 .. low+width
    width = np.maximum(low, 1)
    seed = mix(shingle + block.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    out = np.full((len(shingles), m), np.inf)
    until = (np.log(m) + 4) / sizes
    todo = np.ones(len(shingles), bool)
    while todo.any():
        at = np.flatnonzero(todo[doc])
        time, k = np.zeros(len(at)), 0
        while len(at):
            k += 1
            x = mix(seed[at] + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * width[at])
            stay = time <= until[doc[at]]
            at, time, x = at[stay], time[stay], x[stay]
            y = mix(x ^ np.uint64(0xA0761D6478BD642F))
            level = low[at] + 1 + ((y >> np.uint64(32)) % width[at].astype(np.uint64)).astype(np.int64)
            held = level <= weight[at]
            place = doc[at][held] * m + ((y & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)[held]
            np.minimum.at(out.reshape(-1), place, time[held])
        todo = np.isinf(out).any(1)
        until = until * 2
    return out


def banded(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, th, n (shingles) and band keys of each document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hashes = WordHashes()
        turn = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)).reshape(bands, rows)

        def out(part: list) -> pa.RecordBatch:
            full = [i for i, p in enumerate(part) if len(p[2])]
            keys: list = [[] for _ in part]
            short = [b""] * len(part)
            if full:
                bits = signatures([part[i][2] for i in full], bands * rows).view(np.uint64).reshape(-1, bands, rows)
                own = mix(mix(bits ^ turn).sum(2, dtype=np.uint64) + turn[:, 0]).view(np.int64)
                low = mix(bits).astype("<u2").reshape(len(full), -1)
                for i, k, x in zip(full, own, low):
                    keys[i], short[i] = k.tolist(), x.tobytes()
            return pa.record_batch([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.binary()), pa.array([len(p[2]) for p in part], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(short, pa.binary())], names=["doc_id", "th", "n", "bands", "sig"])

        for batch in batches:
            part, held = [], 0
            for doc_id, text, th in rows_of(batch):
                s = rolled(hashes.array(text.lower().split()), SHINGLE)
                part.append((doc_id, th, s))
                held += len(s)
                if held > 50_000:
                    yield out(part)
                    part, held = [], 0
            if part:
                yield out(part)

    return docs.mapInArrow(run, "doc_id long, th binary, n long, bands array<long>, sig binary")


class _Overlap:
    """Whether the multiset overlap of a member with the center is `threshold` or more."""

    def __init__(self, threshold: float):
        self.threshold, self.hashes = threshold, WordHashes()

    def bag_of(self, text: str):
        import numpy as np

        return np.unique(rolled(self.hashes.array(text.lower().split()), SHINGLE), return_counts=True)

    def holds(self, x, y) -> bool:
        import numpy as np

        if not len(x[0]) or not len(y[0]):
            return False
        at = np.searchsorted(x[0], y[0])
        at[at == len(x[0])] = 0
        same = x[0][at] == y[0]
        both = int(np.minimum(x[1][at], y[1])[same].sum())
        return both >= self.threshold * (int(x[1].sum()) + int(y[1].sum()) - both)

    def center(self, text: str) -> None:
        self.bag = self.bag_of(text)

    def member(self, a, b, payload, text):
        if self.holds(self.bag, self.bag_of(text)):
            yield a, b


_OPEN = ["band", "key", "i", "j", "own", "th", "n", "root", "sig", "bands"]


def _candidates(rows: list, threshold: float, m: int):
    """Of the rows (of _OPEN) of two blocks, or one with itself: both sides, and the places of the pairs in them that may hold: of
    different roots, of sizes and signatures that allow it, in the first band that they share."""
    import numpy as np

    band, _, i, j = rows[0][:4]
    sides = [[r for r in rows if r[4] == x] for x in (i, j)]
    if not all(sides):
        return sides, ()
    number: dict = {}
    size, root, sig, keys = zip(*((np.array([r[6] for r in s], float), np.array([number.setdefault(r[7], len(number)) for r in s]), np.frombuffer(b"".join(r[8] for r in s), "<u2").reshape(len(s), -1), np.array([r[9] for r in s])) for s in sides))
    open_ = root[0][:, None] != root[1][None, :]
    open_ &= np.minimum(size[0][:, None], size[1][None, :]) >= threshold * np.maximum(size[0][:, None], size[1][None, :])
    if i == j:
        open_ &= np.arange(len(size[0]))[:, None] < np.arange(len(size[1]))[None, :]
    if not open_.any():
        return sides, ()
    same = np.zeros(open_.shape, np.int16)
    for c in range(m):
        same += sig[0][:, c][:, None] == sig[1][:, c][None, :]
    x, y = np.nonzero(open_ & (same >= threshold * m - 4 * (m * threshold * (1 - threshold)) ** 0.5))
    first = np.concatenate([np.empty(0, bool), *((keys[0][x[k : k + 10_000]] == keys[1][y[k : k + 10_000]]).argmax(1) == band for k in range(0, len(x), 10_000))])
    return sides, list(zip(x[first].tolist(), y[first].tolist()))


def _blocks(batches: Iterator[pa.RecordBatch], each) -> Iterator[pa.RecordBatch]:
    """each(rows) for the rows of each pair of blocks, which stand together."""
    at, held = None, []
    for batch in batches:
        for row in rows_of(batch):
            if row[:4] != at:
                if held:
                    yield from each(held)
                at, held = row[:4], []
            held.append(row)
    if held:
        yield from each(held)


def _close(members: DataFrame, found: DataFrame, threshold: float, m: int, share: int = 200_000) -> DataFrame:
    """Pairs (a, b) that hold, of a band's members (band, key, th, n, root, sig, bands) with different roots; written.

    A band's members are dealt into blocks of about `share` shingles, and a task holds two blocks at a time. A member goes to a
    task for each block of its band without its text (some 400 bytes), and with it only where it may have a partner.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, _ = spread(members, ["band", "key"], "th", share, F.col("n") + 100)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("band", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), F.col("part").alias("own"), "th", "n", "root", "sig", "bands")
    met = lambda df: df.repartition(n, "band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")

    def may(rows: list) -> Iterator[pa.RecordBatch]:
        sides, hits = _candidates(rows, threshold, m)
        kept = {side[at][5]: side[at] for k, side in enumerate(sides) for at in {h[k] for h in hits}}
        if kept:
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*kept.values()), kinds)], names=_OPEN)

    kept = written(met(dealt).mapInArrow(lambda batches: _blocks(batches, may), "band int, key long, i int, j int, own int, th binary, n long, root binary, sig binary, bands array<long>"), "kept")

    def hold(rows: list) -> Iterator[pa.RecordBatch]:
        judge, bags, above = _Overlap(threshold), {}, {}
        sides, hits = _candidates(rows, threshold, m)

        def root(x):
            while x in above:
                x = above[x]
            return x

        def bag(r):
            if r[5] not in bags:
                bags[r[5]] = judge.bag_of(r[10])
            return bags[r[5]]

        out = []
        for x, y in hits:
            a, b = sides[0][x], sides[1][y]
            u, v = root(a[7]), root(b[7])
            if u != v and judge.holds(bag(a), bag(b)):
                above[max(u, v)] = min(u, v)
                out.append((a[5], b[5]))
        if out:
            yield pa.record_batch([pa.array(c, pa.binary()) for c in zip(*out)], names=["a", "b"])

    texts_ = kept.join(found.withColumnRenamed("key", "th"), "th").select(*_OPEN, "text")
    out = written(met(texts_).mapInArrow(lambda batches: _blocks(batches, hold), "a binary, b binary"), "more")
    discard(kept)
    return out


def _alike(pairs: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that hold, written."""
    out = compare(pairs.withColumn("payload", F.lit(None).cast("string")), found, lambda: _Overlap(threshold), "a binary, b binary")
    return written(out, "links")


def text_hash(text: str = "text"):
    """128 bits of a text, null as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 20, rows: int = 4) -> DataFrame:
    """doc_id, th (hash of the text), class_id (the least doc_id of the class) and kept (one id and text a class) of each document."""
    docs = texts(docs).withColumn("th", text_hash())
    signed = written(banded(docs, bands, rows), "signatures")
    one = signed.dropDuplicates(["th"])
    keyed = one.select("th", "n", F.posexplode("bands").alias("band", "key"))
    many = written(keyed.groupBy("band", "key").agg(F.count("*").alias("company")).where("company > 1"), "many")
    members = written(keyed.join(many, ["band", "key"]).select("band", "key", "th", "n", "company"), "members")

    keys = written(members.select(F.col("th").alias("key")).distinct(), "keys")
    found = pick_texts(docs, keys, F.col("th"))
    company = members.groupBy("th").agg(F.sum("company").alias("all"))
    ranked = members.join(company, "th").select("band", "key", "th", "n", F.struct("all", "th", "n").alias("rank"))
    # the sides of joins by band are tables, so Spark can split a hot band
    centers = written(ranked.groupBy("band", "key").agg(F.max("rank").alias("c")), "centers")
    fits = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y)
    stars = ranked.join(centers, ["band", "key"]).where((F.col("c.th") != F.col("th")) & fits(F.col("c.n"), F.col("n")))
    tried = written(stars.select(F.col("c.th").alias("a"), F.col("th").alias("b")).distinct(), "stars")
    links = _alike(tried, found, threshold)

    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = members.join(roots, members["th"] == roots["u"], "left").select("band", "key", "th", "n", F.coalesce("root", "th").alias("root"))
    placed = written(placed, "placed")
    mixed = written(placed.groupBy("band", "key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("band", "key"), "mixed")
    open_ = written(placed.join(mixed, ["band", "key"]).join(one.select("th", "sig", "bands"), "th"), "open")
    more = _close(open_, found, threshold, bands * rows)
    discard(many, keys, found, members, centers, tried, links, placed, mixed, open_)

    # the second set of components is over whole ones of the first
    def root_of(links: DataFrame, c: str) -> DataFrame:
        return links.join(roots.select(F.col("u").alias(c), F.col("root").alias("r")), c, "left").withColumn(c, F.coalesce("r", c)).drop("r")

    tops = components(root_of(root_of(more, "a"), "b").select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = signed.select("doc_id", "th").join(roots.select(F.col("u").alias("th"), "root"), "th", "left").select("doc_id", "th", F.coalesce("root", "th").alias("root"))
    named = named.join(tops.select(F.col("u").alias("root"), F.col("root").alias("top")), "root", "left").select("doc_id", "th", F.coalesce("top", "root").alias("class"))
    # a hot class meets its least row by class and salt, dealt over that many tasks
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    named = named.withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(64)).cast("int"))
    by_salt = named.groupBy("class", "salt").agg(F.min(first).alias("first"))
    least = by_salt.groupBy("class").agg(F.min("first").alias("first"), F.collect_list("salt").alias("salt")).select("class", F.explode("salt").alias("salt"), "first")
    return named.join(least, ["class", "salt"]).select("doc_id", "th", F.col("first.doc_id").alias("class_id"), first.eqNullSafe(F.col("first")).alias("kept"))


def one_of_each(docs: DataFrame, **params) -> DataFrame:
    """`docs` with one row of each class; the rows that go are joined out by id and text hash."""
    marks = written(near_duplicates(docs, **params), "classes")
    gone = marks.where(~F.col("kept")).select(F.col("doc_id").alias("id_gone"), F.col("th").alias("th_gone")).distinct()
    hashed = packed(docs, F.col("doc_id").cast("long").alias("id"), text_hash().alias("th"))
    left = hashed.join(gone, F.col("id").eqNullSafe(F.col("id_gone")) & (F.col("th") == F.col("th_gone")), "left_anti")
    if not marks.where("kept").groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["id", "th"])
    return left.select("row.*")
