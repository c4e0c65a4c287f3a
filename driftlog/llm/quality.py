"""Quality by supervised subword embeddings: hashed word and character n-gram vectors, averaged per document, then softmax.

Features of a word: the word itself and its character n-grams of 3 to 5 characters with the marks of its ends, hashed into
`buckets`; two equal words in a row add one more feature (the word pair of a repetition). The vectors and the softmax layer
are trained together by stochastic gradient descent in numpy.

Since the document vector is an average and the output is linear in it, a word adds a fixed number to the difference of the
two outputs: scoring keeps one number per bucket, and each worker a bounded cache per word.

Only rows whose crc32(doc_id) mod 4 is not 2 teach, at most `sample_rows` of them. Null or empty text: no features, the score
of the bias alone. Null ids: scored like others. Repeated rows: scored alike. No labels, or labels of one kind only: the
share of label 1 (0.5 without labels). No documents: an empty result. Texts are read whole. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, rows_of, texts

_REPEAT = "\x00repeat"


def features(word: str, buckets: int) -> list[int]:
    raw = f"<{word}>"
    grams = [raw[i : i + n] for n in (3, 4, 5) for i in range(len(raw) - n + 1)]
    return [zlib.crc32(g.encode()) % buckets for g in (f"\x01{word}", *grams)]


def _repeats(words: list[str]) -> int:
    return sum(map(eq, words, words[1:]))


def bags(docs: DataFrame, marks: DataFrame, buckets: int) -> DataFrame:
    """label and the document's buckets and counts, as bytes, for the rows of `marks`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            out = []
            for doc_id, text, label in rows_of(batch):
                words, bag = text.split(), Counter()
                for word, n in Counter(words).items():
                    for f in features(word, buckets):
                        bag[f] += n
                if n := _repeats(words):
                    bag[features(_REPEAT, buckets)[0]] += n * 8
                ids = sorted(bag)
                out.append((doc_id, label, np.array(ids, "<u4").tobytes(), np.array([bag[i] for i in ids], "<f4").tobytes()))
            if out:
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["doc_id", "label", "ids", "counts"])

    rows = texts(docs).join(F.broadcast(marks), "doc_id")
    return rows.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, ids binary, counts binary")


def train(rows: list[tuple[int, bytes, bytes]], buckets: int, dim: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 7):
    """(a number per bucket, bias): the word vectors times the difference of the output vectors."""
    import numpy as np

    share = (sum(r[0] for r in rows) + 1) / (len(rows) + 2)
    bias = np.array([math.log(1 - share), math.log(share)])
    if len({r[0] for r in rows}) < 2:
        return np.zeros(buckets, "<f4"), float(bias[1] - bias[0])
    rng = np.random.default_rng(seed)
    vectors, output = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)), np.zeros((2, dim))
    data = [(y, np.frombuffer(i, "<u4"), np.frombuffer(c, "<f4")) for y, i, c in rows if i]
    steps, done = epochs * len(data), 0
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            y, ids, counts = data[k]
            lr, done = rate * (1 - done / steps), done + 1
            part = counts / counts.sum()
            hidden = part @ vectors[ids]
            z = output @ hidden + bias
            p = np.exp(z - z.max())
            err = p / p.sum()
            err[y] -= 1
            back = err @ output
            output -= lr * np.outer(err, hidden)
            bias -= 0.1 * lr * err
            # the step of a vector grows with its share of the document, scaled up as shares are small
            vectors[ids] -= lr * np.outer(np.minimum(part * 50, 1.0), back)
    return (vectors @ (output[1] - output[0])).astype("<f4"), float(bias[1] - bias[0])


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 3_000, buckets: int = 1 << 16) -> dict:
    """The model, from at most `sample_rows` labelled rows by a hash of their ids (their features come to the driver).

    Each row counts once, whatever the shares of the labels.
    """
    marks = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    teach = marks.where(F.pmod(id_crc(F.col("doc_id")), F.lit(4)) != 2).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    rows = sorted((r["doc_id"], r["label"], bytes(r["ids"]), bytes(r["counts"])) for r in bags(docs, teach, buckets).collect())
    weights, bias = train([r[1:] for r in rows], buckets)
    return {"weights": weights.tobytes(), "bias": bias, "buckets": buckets}


class Scorer:
    def __init__(self, model: dict, limit: int = 100_000):
        import numpy as np

        weights, buckets = np.frombuffer(model["weights"], "<f4").tolist(), model["buckets"]
        self.bias, self.repeat = model["bias"], weights[features(_REPEAT, buckets)[0]]

        class Sums(dict):
            """Word -> its sum of weights + number of features * 1j."""

            def __missing__(self, word):
                if len(self) >= limit:
                    self.clear()
                ids = features(word, buckets)
                found = complex(sum([weights[i] for i in ids]), len(ids))
                if len(word) <= 64:
                    self[word] = found
                return found

        self.sums = Sums()

    def __call__(self, text: str) -> float:
        words = text.split()
        n = 8 * _repeats(words)
        total = sum(map(self.sums.__getitem__, words), complex(self.repeat * n, n))
        z = self.bias + (total.real / total.imag if total.imag else 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of each document; no shuffle. The model (4 bytes a bucket) goes with the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            out = []
            for doc_id, text in rows_of(batch):
                p = scorer(text)
                out.append((doc_id, p, int(p >= threshold)))
            if out:
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(), pa.float64(), pa.int32()))], names=["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, score and predicted of each document, by a model learned from the labelled rows."""
    scored = score(docs, learn(docs, labels, **params))
    return scored.select("doc_id", (F.pmod(id_crc(F.col("doc_id")), F.lit(4)) == 2).alias("held_out"), "score", "predicted")
