"""Document fingerprints by winnowing, in DataFrame functions only.

Words (text between spaces) are hashed, hashes are rolled over k words, and in each window of `window` k-grams the smallest
hash is chosen, the rightmost on ties. Chosen hashes keep their positions, so any run of `window` + k - 1 equal words gives
equal entries. Rolling and window minima take a few passes of zip_with by doubling, not one slice per position.

A chosen k-gram is one long: 35 bits of hash above 28 bits of reversed position, so the smallest long is the smallest hash
with the largest position.

Null text: as empty; an empty text has an empty fingerprint. Fewer words than k: one k-gram of all words. Fewer k-grams than
a window: one window. Two empty fingerprints are alike (1.0), an empty and another are not (0.0). Null doc_id: after all
others. Repeated doc_ids: ordered by text. One document is its own next one. No documents: an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import texts

_POS = 28
_LAST = (1 << _POS) - 1


def _head(col: str, n: str, less: int) -> Column:
    return F.slice(col, F.lit(1), F.greatest(F.col(n) - less, F.lit(0)))


def _tail(col: str, n: str, skip: int) -> Column:
    return F.slice(col, F.lit(1 + skip), F.greatest(F.col(n) - skip, F.lit(0)))


def _rolled(df: DataFrame, col: str, n: str, size: int, join) -> DataFrame:
    """`col` joined over runs of `size` neighbours: doubled while that fits, then the rest once."""
    have = 1
    while have < size:
        step = min(have, size - have)
        df = df.withColumn(col, F.zip_with(_head(col, n, step), _tail(col, n, step), join)).withColumn(n, F.greatest(F.col(n) - step, F.lit(0)))
        have += step
    return df


def winnow(df: DataFrame, text: str, out: str, k: int = 4, window: int = 8) -> DataFrame:
    """`df` with the column `out`: the chosen k-grams in order. k is a power of two, so that doubling gives no overlap."""
    if k & (k - 1):
        raise ValueError("k is a power of two")
    h, n, few = f"_{out}_h", f"_{out}_n", f"_{out}_few"
    df = df.withColumn(h, F.when(F.col(text) == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(text, " "), lambda w: F.xxhash64(w))))
    df = df.withColumn(n, F.size(h)).withColumn(few, F.when((F.col(n) > 0) & (F.col(n) < k), F.xxhash64(h)))
    df = _rolled(df, h, n, k, lambda a, b: F.xxhash64(a, b))
    df = df.withColumn(h, F.when(F.col(few).isNotNull(), F.array(few)).otherwise(F.col(h)))
    df = df.withColumn(h, F.transform(h, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 29), _POS).bitwiseOR(F.lit(_LAST) - i.cast("long")))).withColumn(n, F.size(h))
    df = df.withColumn(few, F.when((F.col(n) > 0) & (F.col(n) < window), F.array_min(h)))
    df = _rolled(df, h, n, window, lambda a, b: F.least(a, b))
    df = df.withColumn(out, F.when(F.col(few).isNotNull(), F.array(few)).otherwise(F.array_distinct(h)))
    return df.drop(h, n, few)


def hashes(chosen: str) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, _POS)))


def shown(chosen: str) -> Column:
    """The fingerprint as text: hash@position, in order."""
    return F.array_join(F.transform(chosen, lambda x: F.concat(F.hex(F.shiftright(x, _POS)), F.lit("@"), (F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST))).cast("string"))), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two columns of hashes."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_).cast("double")


def with_next(df: DataFrame, key: str, tie: str, carried: list[str]) -> DataFrame:
    """`df` with next_<c> of the row after it in descending `key`; after the last row comes the first.

    Rows are dealt into ranges whose upper ends are keys that occur (from an approximate histogram of the keys alone). Such
    an end row also goes to the range above as a guest at its bottom, and the first row to the lowest range, so a window in
    each range needs no other: one shuffle, no range holds more than its share, nothing is collected but the ends.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = df.agg(F.max(key).alias("most"), F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("ends")).first()
    ends = sorted({e for e in found["ends"] or [] if e < found["most"]})
    step = max(1, math.isqrt(len(ends)))
    chunks = [ends[i : i + step] for i in range(0, len(ends), step)]

    def below(values: Column, k: Column) -> Column:
        return F.size(F.filter(values, lambda e: e < k))

    longs = lambda v: F.array(*map(F.lit, v)).cast("array<bigint>")
    if chunks:
        df = df.withColumn("_c", below(longs([c[0] for c in chunks]), F.col(key)))
        df = df.withColumn("_range", F.when(F.col("_c") == 0, F.lit(0)).otherwise((F.col("_c") - 1) * step + below(F.element_at(F.array(*map(longs, chunks)), F.greatest(F.col("_c"), F.lit(1))), F.col(key)))).drop("_c")
        is_end = F.col(key).isin(ends)
    else:
        df, is_end = df.withColumn("_range", F.lit(0)), F.lit(False)
    places = F.filter(F.array(F.struct(F.col("_range").alias("at"), F.lit(0).alias("guest")), F.struct(F.when(is_end, F.col("_range") + 1).alias("at"), F.lit(1).alias("guest")), F.struct(F.when(F.col(key) == F.lit(found["most"]), F.lit(0)).alias("at"), F.lit(2).alias("guest"))), lambda p: p["at"].isNotNull())
    df = df.withColumn("_place", F.explode(places)).withColumn("_at", F.col("_place.at")).withColumn("_guest", F.col("_place.guest")).drop("_place", "_range")
    order = Window.partitionBy("_at").orderBy("_guest", F.desc(key), tie)
    for c in carried:
        df = df.withColumn(f"next_{c}", F.lead(c).over(order))
    return df.where("_guest = 0").drop("_at", "_guest")


def fingerprint(docs: DataFrame, k: int = 4, window: int = 8) -> DataFrame:
    """The fingerprint of each document and of its edited text, and their likeness to it and to the next document's."""
    df = texts(docs).withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    df = winnow(df, "text", "own", k, window)
    df = with_next(df, "_key", "text", ["text", "own"]).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))).drop("text", "next_text", "_key")
    df = winnow(df, "edited", "changed", k, window)
    df = df.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")
    df = df.withColumn("a", hashes("own")).withColumn("b", hashes("changed")).withColumn("c", hashes("next_own"))
    return df.select("doc_id", "n_chars", "edited_sha256", shown("own").alias("fingerprint"), shown("changed").alias("edited_fingerprint"), likeness("a", "b").alias("near_edited"), likeness("a", "c").alias("near_next"))
