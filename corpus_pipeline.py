"""Corpus preparation in stages; each reads the documents that the one before it wrote.

A stage is a function of (spark, docs, sf_dir) that returns a DataFrame. All but the last one return
the columns of documents. Stages hold no state: what one decides is in the rows it returns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinleaf.llm.common import shared_dir
from twinleaf.llm.langid import identify, train
from twinleaf.llm.likeness import first_of_each_group
from twinleaf.llm.packing import pack_documents
from twinleaf.llm.quality import judge

#: The stages decide by models and hashes that SQL doesn't have; tests compare with a plain version.
ORACLE_SQL = None

#: How far a prediction has to be above the least that the best of k languages can have, 1 / k, on the way to 1.
MIN_MARGIN = 0.35


def _columns(docs: DataFrame, **changed) -> list:
    """The columns of docs out of the struct row, with some replaced."""
    return [(changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose predicted language is known; lang becomes the prediction.

    The network learns from the labelled rows of docs. Texts without a letter, null texts, and
    predictions that are too close to chance (MIN_MARGIN) go. Without any labelled row nothing can be judged, and
    nothing goes. Repeated rows and ids are judged each, other columns stay as they are, whatever their
    names; an empty table gives no rows."""
    net = train(docs)
    if net is None:
        return docs
    chance = 1 / len(net.classes)
    found = identify(docs, net).where((F.col("lang_pred") != "und") & (F.col("score") >= chance + MIN_MARGIN * (1 - chance)))
    return found.select(*_columns(docs, lang=F.col("lang_pred")))


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the quality rules, with the lines that pass; n_chars follows.

    Null, empty and short texts go. Repeated rows and ids are judged each, other columns stay as they are,
    whatever their names; an empty table gives no rows."""
    judged = judge(docs, only_kept=True)
    text = F.col("cleaned_text")
    return judged.select(*_columns(docs, text=text, n_chars=F.length(text).cast(docs.schema["n_chars"].dataType)))


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: likeness of 0.8 or more in shingles of five
    words, and what such links reach. Of a group the row with the smallest doc_id stays (null ids last);
    different texts under one id are judged each, and equal rows are one. Null and empty texts are one
    group. Other columns stay as they are, whatever their names; an empty table gives no rows."""
    return first_of_each_group(docs)


def packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents that are left into sequences of 2048 tokens. Null and empty texts are a piece of
    one token, repeated rows are documents of their own; an empty table gives no rows."""
    return pack_documents(docs)


STAGES = [("language", language), ("quality", quality), ("near_dedup", near_dedup), ("packing", packing)]


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/twinleaf-tables/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
