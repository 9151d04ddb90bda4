"""What the operators of this subpackage share: tables in the shared folder, Arrow batches, caches."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Tokenizer files; every operator that needs one takes the folder or the path as a parameter.
TOKENIZER_DIR = None
#: Rows and bytes in one Arrow batch, so that a batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where
    that is unset, which only a single-machine session may use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="twinleaf-")
        shared_dir.own = found
    return found.rstrip("/")


def _table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/twinleaf-tables/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: the rows are computed once, the lineage is
    cut, and the loss of an executor loses nothing. discard takes the table away once it is of no use;
    those that a result still reads belong to the caller."""
    spark = df.sparkSession
    path = _table_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def materialize_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """materialize in buckets by a column, as many as there are shuffle partitions: joins and aggregates
    on it leave the rows where they are."""
    spark = df.sparkSession
    path, table = _table_path(spark, name), f"twinleaf_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).saveAsTable(table)
    return spark.table(table)


def discard(df: DataFrame) -> None:
    """Delete the table behind a DataFrame of materialize, which nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._table_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in rows and bytes, whatever the length of the texts."""
    conf = spark.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine; files are never copied or shipped."""
    import public_tokenizers

    return public_tokenizers.path(name)


def worker_model(key: tuple, make):
    """What make() gives, kept as long as the Python worker asks for the same key. A worker serves many
    queries, so it holds one model with its memo at a time."""
    if getattr(sys, "_twinleaf_model", (None,))[0] != key:
        sys._twinleaf_model = (None,)  # the old one goes before the new one comes
        sys._twinleaf_model = key, make()
    return sys._twinleaf_model[1]


class Memo:
    """A dictionary of computed values, bounded in bytes, in two generations: when the young one is full
    it becomes the old one, and entries that are met again move back. Keys over LONG bytes are never
    kept. Losing an entry only costs computing it again, so results never depend on the bound."""

    #: Bytes of one generation, as Python counts its keys and values, and of an entry's place in it.
    BYTES, ENTRY = 64 << 20, 110
    LONG = 256

    def __init__(self, compute_many, limit: int = BYTES):
        self.compute_many, self.limit, self.size, self.young, self.old = compute_many, limit, 0, {}, {}

    def values(self, keys: list[bytes]) -> list:
        """The value of each of keys, which are distinct; new ones are computed together."""
        if self.size > self.limit:
            self.young, self.old, self.size = {}, self.young, 0
        old, sizeof, found = self.old, sys.getsizeof, list(map(self.young.get, keys))
        missing = [i for i, v in enumerate(found) if v is None]
        fresh = []
        for i in missing:
            v = found[i] = old.get(keys[i])
            if v is None:
                fresh.append(i)
        for i, v in zip(fresh, self.compute_many([keys[i] for i in fresh]) if fresh else ()):
            found[i] = v
        kept = {keys[i]: found[i] for i in missing if len(keys[i]) <= self.LONG}
        self.young.update(kept)
        self.size += sum(map(sizeof, kept)) + sum(map(sizeof, kept.values())) + self.ENTRY * len(kept)
        return found


def text_batches(rows: Iterator, columns: list[str], text: str = "text") -> Iterator[tuple]:
    """The named columns of each Arrow batch as Python lists, and its texts (without nulls) as they are."""
    for batch in rows:
        if batch.num_rows:
            at = batch.schema.get_field_index
            texts = batch.column(at(text))
            yield (*(batch.column(at(c)).to_pylist() for c in columns), texts if pa.types.is_string(texts.type) else texts.cast(pa.string()))


def batches(rows: Iterator, columns: list[str]) -> Iterator[tuple]:
    """The named columns of each Arrow batch, as Python lists."""
    for batch in rows:
        if batch.num_rows:
            yield tuple(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns)
