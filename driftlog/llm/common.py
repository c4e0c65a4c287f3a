"""What the training-data operators share: shared storage, input columns and text iteration."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []

#: ASCII upper case to lower case and nothing else, as a table for str.translate.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a session on one machine
    gets a temporary folder, and one on a cluster an error, as no folder of one machine would do there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "driftlog-shared")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/driftlog-{uuid.uuid4().hex}/{name}"
    if not _WRITTEN:
        atexit.register(_clean)
    _WRITTEN.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            remove(spark, path.rpartition("/")[0])
        except Exception:  # the session may have ended before the process
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: the lineage ends there, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of written() whose readers have been written themselves."""
    for df in tables:
        remove(df.sparkSession, df.written_to)


def packed(docs: DataFrame, *keys: Column) -> DataFrame:
    """All columns of `docs` in one struct `row`, beside `keys`: no name of theirs can clash. select("row.*") gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keys)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of an Arrow batch that goes to a Python worker: long texts make batches of few rows.
BATCH_BYTES = 4 << 20


def importable(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes, and Python workers started from now on find this package where the driver did (a path that executors have too, or none)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")), root]))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text only, whatever other columns there are; a null text is an empty one."""
    importable(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def id_crc(col: Column) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def rows_of(batch, size: int = 256) -> Iterator[tuple]:
    """The rows of an Arrow batch as tuples of Python values, `size` at a time."""
    for i in range(0, batch.num_rows, size):
        yield from zip(*(c.to_pylist() for c in batch.slice(i, size).columns))


def small(df: DataFrame, row_bytes: int, most_mb: int = 24) -> bool:
    """Whether a written table of rows of about `row_bytes` may be broadcast; as a hash table it takes two or three times that."""
    return df.count() * row_bytes <= most_mb << 20


def pick_texts(docs: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """A written table key, text of the documents whose `key` is in `keys`, one row a key; the keys are broadcast if small."""
    keyed = docs.select(key.alias("key"), "text")
    side = F.broadcast(keys) if small(keys, 64) else keys
    return written(keyed.join(side, "key", "left_semi").dropDuplicates(["key"]), "texts")


def spread(df: DataFrame, keys: list[str], other: str, share: int, weight: Column | None = None, salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """`df` with `parts` and `part`, by which the rows of a key are dealt to a task for each `share` of their weights (1 each if
    not given); keys and parts.

    A row's salt is a hash of `other`. Rows meet the number of parts by key and salt, so a hot key is dealt over `salts` tasks
    there too, whatever its size; a key has a row for each salt that it has.
    """
    weight = F.lit(1) if weight is None else weight
    salted = df.withColumn("salt", F.pmod(F.xxhash64(F.lit(17), F.col(other)), F.lit(salts)).cast("int"))
    by_salt = salted.groupBy(*keys, "salt").agg(F.sum(weight).alias("weight"))
    parts = by_salt.groupBy(*keys).agg(F.ceil(F.sum("weight") / share).cast("int").alias("parts"), F.collect_list("salt").alias("salt"))
    dealt = salted.join(parts.select(*keys, F.explode("salt").alias("salt"), "parts"), [*keys, "salt"]).drop("salt")
    return dealt.withColumn("part", F.pmod(F.xxhash64(other), F.col("parts")).cast("int")), parts.select(*keys, "parts")


def compare(pairs: DataFrame, found: DataFrame, judge, schema: str, share: int = 128) -> DataFrame:
    """judge(center text, rows of (a, b, payload, text of b)) -> rows of `schema`, for the pairs (a, b, payload string).

    The members of a center `a` stream past it, its text sent once for each `share` of them: a hot center is dealt over many
    tasks, and a task holds one center's text and one batch. `found` has key and text.
    """
    import pyarrow as pa

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, parts = spread(pairs.select("a", "b", "payload"), ["a"], "b", share)
    members = dealt.join(found.withColumnRenamed("key", "b"), "b").select("a", "part", F.lit(1).alias("kind"), "b", "payload", "text")
    centers = parts.join(found.withColumnRenamed("key", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast(dict(pairs.dtypes)["b"]).alias("b"), F.lit(None).cast("string").alias("payload"), "text")
    both = centers.unionByName(members).repartition(n, "a", "part").sortWithinPartitions("a", "part", "kind", "b")

    def run(batches):
        see, kind = judge(), None
        for batch in batches:
            out = []
            for a, _, is_member, b, payload, text in rows_of(batch):
                if not is_member:
                    see.center(text)
                else:
                    out.extend(see.member(a, b, payload, text))
            if out:
                kind = kind or _arrow(schema)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kind.types)], schema=kind)

    return both.mapInArrow(run, schema)


def _arrow(schema: str):
    """An Arrow schema of a DDL string of plain types."""
    import pyarrow as pa

    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(","))])


class WordHashes(dict):
    """Word -> 64-bit hash, bounded."""

    def __init__(self, limit: int = 100_000):
        self.limit = limit

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = found
        return found

    def array(self, words: list[str]):
        import numpy as np

        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x):
    """A 64-bit finaliser over numpy's unsigned integers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(hashes, size: int):
    """Hashes of the runs of `size` word hashes; of all of them where there are fewer, if any."""
    import numpy as np

    n = len(hashes)
    if not n:
        return hashes
    size, factor, one = min(size, n), np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out = out * factor + hashes[i : n - size + 1 + i] + one
    return mix(out)
