"""Documents to packed training sequences, in stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of `docs` but for the last, which returns
the pieces of packed sequences. run() writes each stage's rows in the shared folder and reads them for the next.
"""

from __future__ import annotations

from driftlog.llm.common import documents, written
from driftlog.llm.decontamination import clean
from driftlog.llm.near_duplicates import one_of_each
from driftlog.llm.packing import pack
from driftlog.llm.repeats import without_repeats
from driftlog.llm.toxicity import without_toxic


def toxicity(spark, docs, sf_dir):
    """Documents that the clause grammar scores as toxic go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate class stays, that of the least doc_id."""
    return one_of_each(docs)


def suffix_dedup(spark, docs, sf_dir):
    """Passages of 50 words or more stay in their first document only; a document left without words goes."""
    return without_repeats(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark, docs, sf_dir):
    """The pieces of the documents in sequences of 4096 tokens."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
