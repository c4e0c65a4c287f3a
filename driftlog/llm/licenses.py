"""License scan by diagonal voting over rolling word k-grams.

Hashes of all rolling k-grams of a document are joined with the places of the templates' k-grams. A hit votes for the diagonal
document place - template place. Neighbouring diagonals (at most `slack` apart, so words may be added or lost) merge into one
span, which reaches as far as the template would on both sides. Each span is verified in the text: the words that it has of
the template in order (longest common subsequence) must be `cover` of the template's words or more. A base phrase is a template
of its own: each diagonal with a vote is a place if the phrase's words stand there. The score is the largest share of a
template's words that a span has, 1 at a base place.

Words are lower-cased (A-Z) runs of ASCII letters, digits and characters beyond ASCII.

Null text: as empty. Null ids stay null. Repeated rows: one result each. Texts without words: zeros, empty labels, score 0.
No documents: an empty result. Other columns are ignored. Texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, WordHashes, rolled, rows_of, small, texts, written

# Base phrases, then the notices that are looked for, with their labels.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2", "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("bsl-1", "distributed under the boost software license version 1 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc0", "waived all copyright and related or neighboring rights to this work"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2", "made available under the terms of the eclipse public license 2 0"),
    ("all-rights-reserved", "all rights reserved"),
]
LISTED = [*((label, text.split(), True) for label, text in PHRASES.items()), *((label, text.split(), False) for label, text in TEMPLATES)]

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_PIECE = 1 << 16
#: A gram that each document has once and that joins with no template: it carries the document.
_CARRIER = -1
_FOUND = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower() if text.isascii() else text.translate(ASCII_LOWER))


def grams(listed: list[str], hashes: WordHashes, k: int):
    """Hashes of the rolling k-grams as signed numbers; numpy."""
    import numpy as np

    return rolled(hashes.array(listed), k).view(np.int64) if len(listed) >= k else np.empty(0, np.int64)


def in_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def verified(found: list[str], spans: list[tuple[int, int, int]], cover: float) -> tuple:
    """(base places, first, last, base labels, labels, score) of the spans (template, start, end) in the words of a text."""
    places, own, base, score = [], set(), set(), 0.0
    for template, start, end in spans:
        label, text, is_base = LISTED[template]
        if is_base:
            if found[start : start + len(text)] == text and start >= 0:
                places.append(start)
                base.add(label)
                score = 1.0
            continue
        share = in_order(found[max(0, start) : end], text) / len(text)
        score = max(score, share)
        if share >= cover:
            own.add(label)
    return len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score


def scan(docs: DataFrame, k: int = 3, slack: int = 3, cover: float = 0.7) -> DataFrame:
    """Base places, labels and score of each document.

    All k-grams are joined where they are made; the table of template places is a few hundred rows, fixed above, and is
    broadcast. Shuffled are the hits only, a few numbers each, and the texts that have some.
    """
    spark = docs.sparkSession
    keyed = texts(docs).select("doc_id", F.xxhash64("text").alias("th"), "text")

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hashes = WordHashes()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids, ths, counts, starts, lists = [], [], [], [], []
                for doc_id, th, text in rows_of(part):
                    found = words(text)
                    own = grams(found, hashes, k)
                    for at in range(0, max(1, len(own)), _PIECE):
                        ids.append(doc_id)
                        ths.append(th)
                        counts.append(len(found))
                        starts.append(at)
                        lists.append(own[at : at + _PIECE])
                        if at == 0:  # stands before the first gram
                            starts[-1], lists[-1] = -1, np.concatenate([np.array([_CARRIER]), lists[-1]])
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                grams_ = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(counts, pa.int64()), pa.array(starts, pa.int64()), grams_], names=["doc_id", "th", "n_words", "start", "grams"])

    rolling = keyed.mapInArrow(roll, "doc_id long, th long, n_words long, start long, grams array<long>")
    each = rolling.select("doc_id", "th", "n_words", "start", F.posexplode("grams").alias("i", "g")).select("doc_id", "th", "n_words", (F.col("start") + F.col("i")).alias("pos"), "g")
    places, hashes = [(_CARRIER, -1, 0, 0)], WordHashes()
    for number, (_, text, _base) in enumerate(LISTED):
        places += [(g, number, at, len(text)) for at, g in enumerate(grams(text, hashes, k).tolist())]
    table = spark.createDataFrame(places, "g long, template int, at long, size long")
    hits = written(each.join(F.broadcast(table), "g").select("doc_id", "th", "n_words", "pos", "template", "at", "size"), "hits")

    keys = ["doc_id", "th", "template"]
    lines = hits.where("template >= 0").groupBy(*keys, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.max("size").alias("size"))
    is_base = F.col("template") < len(PHRASES)
    order = Window.partitionBy(*keys).orderBy("diagonal")
    apart = F.when(~is_base & (F.col("diagonal") - F.lag("diagonal").over(order) <= slack), 0).otherwise(1)
    runs = lines.withColumn("new", apart).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy(*keys, "span").agg(F.min("diagonal").alias("start"), (F.max("diagonal") + F.max("size")).alias("end"))
    listed = written(spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("template", "start", "end")).alias("spans")), "spans")
    side = listed.select(F.col("doc_id").alias("of_id"), F.col("th").alias("of_th"), "spans")
    side = F.broadcast(side) if small(listed.select(F.explode("spans")), 32) else side
    asked = keyed.join(side, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_th"))).dropDuplicates(["doc_id", "th"]).select("doc_id", "th", "text", "spans")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, th, *verified(words(text), sorted((s["template"], s["start"], s["end"]) for s in spans_), cover)) for doc_id, th, text, spans_ in rows_of(batch)]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND.types)], schema=_FOUND)

    found = asked.mapInArrow(verify, "doc_id long, th long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    found = found.withColumnsRenamed({"doc_id": "of_id", "th": "of_th"})
    carried = hits.where("template = -1").select("doc_id", "th", "n_words")
    joined = carried.join(found, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_th")), "left")
    of = lambda c, none: F.coalesce(F.col(c), F.lit(none)).alias(c)
    return joined.select("doc_id", "n_words", of("n_base", 0).cast("long").alias("n_base"), "first_word", "last_word", of("base_labels", ""), of("labels", ""), of("score", 0.0))
