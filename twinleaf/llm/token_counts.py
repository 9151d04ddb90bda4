"""Token counts: batches in Arrow functions that return lengths only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, documents, text_batches
from .library_tokens import token_counts


def count_tokens(docs: DataFrame, file: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; only lengths leave the worker.

    Texts are cut at safe boundaries; spans of pieces with balanced bytes are looked up together, long
    texts over several spans, and distinct pieces that are new go through the library's batch encoder
    in calls of balanced bytes. Null and empty texts have no bytes and no tokens; repeated rows are
    counted each; other columns are ignored; an empty table gives no rows."""
    bound_batches(docs.sparkSession)

    def count(rows):
        model = token_counts(file, folder)
        for ids, sizes, texts in text_batches(rows, ["doc_id", "n_bytes"]):
            out = model.of(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(out), pa.array(out > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return plain.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(documents(spark, sf_dir))
