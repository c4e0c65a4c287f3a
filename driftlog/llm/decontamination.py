"""Benchmark decontamination in DataFrame functions only: SimHash of item-sized windows, Hamming blocks, exact check.

A benchmark item of m words is compared with all windows of m words of each document. Windows and items get 64-bit SimHash
fingerprints of their word shingles, each as often as it occurs. A fingerprint has eight blocks of eight bits; within `radius`
23 some block differs in at most two bits, so a join of the windows' blocks with the items' blocks in all 37 spellings finds
every pair within the radius. Shingle multisets then decide: weighted Jaccard of `threshold` or more.

Fingerprints are worked out for the windows that can reach the threshold only, which loses none: a window of similarity t with
an item of n shingles has at least t * n places whose shingle the item has, wherever in the item it stands. All shingles of the
documents are joined with those of the items, and the starts of all windows with so many hits follow from the hits' places, so
items that are rearranged, cut or stretched are met like others.

Words are runs of ASCII letters, digits and characters beyond ASCII, lower-cased. Shingles have five words; an item of fewer
words is one shingle. Items without words match nothing. Null texts: as empty. Null ids stay null. Repeated documents: a row
for each distinct text of an id. Documents shorter than an item: the whole document is the window. Empty tables: an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, small, texts, written

_SIZE = 5


def words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once: the optimizer does not copy it into the places of its use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles(h: Column, size: int) -> Column:
    """Hashes of the runs of `size` word hashes; of all words where there are fewer, if any. `h` is bound by let()."""
    n = F.size(h)

    def roll(i: Column) -> Column:
        out = F.element_at(h, i)
        for j in range(1, size):
            out = F.xxhash64(out, F.element_at(h, i + j))
        return out

    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), roll)).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))


def shingles_of(h: Column, k: Column) -> Column:
    """shingles() of `k` words, k a column of 1 to 5."""
    out = F.when(k == _SIZE, shingles(h, _SIZE))
    for size in range(1, _SIZE):
        out = out.when(k == size, shingles(h, size))
    return out


def simhash(col: str) -> Column:
    """The fingerprint of the hashes in `col`: bit b is set where more than half of them have it.

    Two bits are counted at once, in the halves of a long.
    """
    lanes, one, none = (F.lit(x).cast("bigint") for x in ((1 << 32) | 1, 1, 0))

    def whole(hashes: Column) -> Column:
        counts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.aggregate(hashes, none, lambda n, h: n + F.call_function("shiftrightunsigned", h, b).bitwiseAND(lanes)))

        def bits(both: Column, b: Column) -> Column:
            low = F.when(both.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.size(hashes), F.call_function("shiftleft", one, b)).otherwise(none)
            high = F.when(F.shiftrightunsigned(both, 32) * 2 > F.size(hashes), F.call_function("shiftleft", one, b + 32)).otherwise(none)
            return low.bitwiseOR(high)

        return F.aggregate(F.transform(counts, bits), none, lambda x, y: x.bitwiseOR(y))

    return let(F.col(col), whole)


def _block(col: str, b: Column) -> Column:
    return F.element_at(F.array(*[F.shiftrightunsigned(F.col(col), 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]), b + 1)


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets."""
    count = lambda xs, h: F.size(F.filter(xs, lambda y: y == h))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, h: n + F.least(count(a, h), count(b, h)))


def items(benchmark: DataFrame) -> DataFrame:
    """Each item with its number of words, shingle size, shingle hashes and fingerprint."""
    df = benchmark.select("item_id", let(words("text"), lambda w: F.transform(w, lambda x: F.xxhash64(x))).alias("h")).withColumn("m", F.size("h")).where("m > 0")
    df = df.withColumn("k", F.least(F.col("m"), F.lit(_SIZE)))
    return df.select("item_id", "m", "k", let(F.col("h"), lambda h: shingles_of(h, F.col("k"))).alias("s")).withColumn("f", simhash("s"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 23, small_mb: int = 64) -> DataFrame:
    """A row for each document (id and text hash th) and item found in it: similarity, start and words of the best window.

    Of windows alike the first counts.

    The documents are read twice: for the places of item shingles (joined with the benchmark's shingles; Spark broadcasts
    them if they are small and else shuffles) and, for the documents with enough of them, for the windows' shingles. The window
    table is written; it is broadcast only if it has at most `small_mb` MB, else the join shuffles.
    """
    bench = written(items(benchmark), "items").withColumn("need", F.ceil(F.size("s") * threshold - 1e-9).cast("int"))
    words_of = F.transform(words("text"), lambda w: F.xxhash64(w))
    keyed = texts(docs).select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = None
    for k in sorted(r["k"] for r in bench.select("k").distinct().collect()):  # five sizes of shingles at most
        seeds = bench.where(F.col("k") == k).select("item_id", "m", F.size("s").alias("n"), "need", F.explode(F.array_distinct("s")).alias("g"))
        grams = keyed.select("doc_id", "th", F.posexplode(let(words_of, lambda h: shingles(h, k))).alias("pos", "g"))
        hits = grams.join(seeds, "g").groupBy("doc_id", "th", "item_id", "m", "n", "need").agg(F.array_sort(F.collect_set("pos")).alias("p")).where(F.size("p") >= F.col("need"))

        def starts(j: Column) -> Column:
            first, last = F.element_at("p", j), F.element_at("p", j + F.col("need") - 1)
            return F.when(last - first < F.col("n"), F.sequence(F.greatest(F.lit(0), last - F.col("n") + 1), first)).otherwise(F.array().cast("array<int>"))

        at = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size("p") - F.col("need") + 1), starts)))
        hits = hits.select("doc_id", "th", F.lit(k).alias("k"), "m", F.explode(at).alias("start"))
        found = hits if found is None else found.union(hits)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "doc_id long, th long, k int, m int, start int")
    windows = written(found.distinct().groupBy("doc_id", "th").agg(F.collect_set(F.struct("k", "m", "start")).alias("at")), "windows")
    few = windows.selectExpr("count(*) n", "coalesce(sum(size(at)), 0) w").first()
    side = F.broadcast(windows) if few["n"] * 40 + few["w"] * 24 <= small_mb << 20 else windows
    side = side.withColumnRenamed("doc_id", "_id").withColumnRenamed("th", "_th")
    rows = keyed.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).dropDuplicates(["doc_id", "th"])
    # the window's end is held within the document; the slices of all windows of a row come from one array of word hashes
    cut = let(words_of, lambda h: F.transform("at", lambda w: let(F.greatest(F.lit(0), F.least(w["start"], F.size(h) - w["m"])), lambda start: F.struct(w["k"].alias("k"), w["m"].alias("m"), start.alias("start"), F.slice(h, start + 1, w["m"]).alias("h")))))
    rows = rows.select("doc_id", "th", F.explode(F.array_distinct(cut)).alias("w")).select("doc_id", "th", "w.*")
    rows = rows.select("doc_id", "th", "m", "start", let(F.col("h"), lambda h: shingles_of(h, F.col("k"))).alias("s"))
    marked = rows.withColumn("f", simhash("s"))

    blocks = F.explode(F.sequence(F.lit(0), F.lit(7)))
    flips = [0, *(1 << b for b in range(8)), *((1 << a) | (1 << b) for a, b in combinations(range(8), 2))]
    spelled = bench.select("item_id", "m", F.col("s").alias("item_s"), F.col("f").alias("item_f"), blocks.alias("b")).select("*", F.explode(F.array(*map(F.lit, flips))).alias("flip"))
    spelled = spelled.select("item_id", "m", "item_s", "item_f", "b", _block("item_f", F.col("b")).bitwiseXOR(F.col("flip").cast("bigint")).alias("v"))
    asked = marked.select("*", blocks.alias("b")).withColumn("v", _block("f", F.col("b")))
    near = asked.join(spelled, ["m", "b", "v"]).where(F.bit_count(F.col("f").bitwiseXOR(F.col("item_f"))) <= radius)
    near = near.dropDuplicates(["doc_id", "th", "m", "start", "item_id"])
    both = overlap(F.col("s"), F.col("item_s"))
    exact = near.withColumn("o", both).withColumn("similarity", F.col("o") / (F.size("s") + F.size("item_s") - F.col("o"))).where(F.col("similarity") >= threshold)
    best = exact.groupBy("doc_id", "th", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "m")).alias("best"))
    return best.select("doc_id", "th", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).cast("long").alias("start"), F.col("best.m").cast("long").alias("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """`docs` without the documents that hold an item; the rows that go are broadcast if they are few."""
    found = written(contaminated(docs, benchmark, **params).select(F.col("doc_id").alias("id_gone"), F.col("th").alias("th_gone")).distinct(), "contaminated")
    side = F.broadcast(found) if small(found, 32) else found
    hashed = packed(docs, F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    left = hashed.join(side, F.col("id").eqNullSafe(F.col("id_gone")) & (F.col("th") == F.col("th_gone")), "left_anti")
    return left.select("row.*")
