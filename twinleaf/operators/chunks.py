"""Blocks to chunks: budgeted packing within chapters, context, manifest, plan hash and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digest, word_count
from .blocks import translatable

# The estimate of a translation's size, and the limits of a chunk.
TOKENS_PER_WORD = 1.8
TOKENS_PER_BLOCK = 40
TARGET_WORDS = 1500
MAX_OUTPUT_TOKENS = 8192
OVERSIZE, MIN_SPLIT = 1.2, 0.4
CONTEXT_BLOCKS = 2


def estimate(words: Column, blocks: Column) -> Column:
    """Output tokens of a translation."""
    return F.floor(words.cast("double") * TOKENS_PER_WORD).cast("long") + blocks * TOKENS_PER_BLOCK


def fold(blocks: Column, target: int, most: int, tokens: int, least: int) -> Column:
    """The seq of each block that starts a chunk, in order: blocks is an array of structs with seq, words,
    heading and section. A block over the limits stands alone; a section heading starts a chunk once
    there is text and enough of it; otherwise a chunk ends before the block that would overflow it."""
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("len"), F.lit(False).alias("text"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        w = b["words"].cast("long")
        alone = (w > most) | (estimate(w, F.lit(1)) > tokens)
        section = b["section"] & s["text"] & (s["words"] >= least)
        joined = F.when(section, F.lit(0)).otherwise(s["len"])
        full = (joined > 0) & ((s["words"] + w > target) | (estimate(s["words"] + w, s["len"] + 1) > tokens))
        new = alone | section | full | (s["len"] == 0)
        return F.struct(
            F.when(alone, F.lit(0).cast("long")).when(new, w).otherwise(s["words"] + w).alias("words"),
            F.when(alone, F.lit(0)).when(new, F.lit(1)).otherwise(s["len"] + 1).alias("len"),
            F.when(alone, F.lit(False)).when(new, ~b["heading"]).otherwise(s["text"] | ~b["heading"]).alias("text"),
            F.when(new, F.concat(s["out"], F.array(b["seq"].cast("long")))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(blocks, start, step, lambda s: s["out"])


def pack(blocks: DataFrame, target_words: int = TARGET_WORDS, max_words: int | None = None, max_output_tokens: int = MAX_OUTPUT_TOKENS, min_split_words: int | None = None) -> DataFrame:
    """Translatable blocks with island (the run of one chapter that they are in), chunk_no, chunk_id
    and oversized. One ordered fold for each run gives the first block of each chunk; runs are packed
    side by side, and a run is as much as one task has to hold."""
    most = int(target_words * OVERSIZE) if max_words is None else max_words
    least = int(target_words * MIN_SPLIT) if min_split_words is None else min_split_words
    rows = translatable(blocks).withColumn("words", word_count(F.col("text")))
    order = Window.partitionBy("book").orderBy("seq")
    starts = F.coalesce(F.lag("chapter").over(order) != F.col("chapter"), F.lit(True))
    rows = rows.withColumn("island", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    heading = F.col("kind") == "heading"
    item = F.struct("seq", "words", heading.alias("heading"), (heading & (F.col("level") == 2)).alias("section"))
    runs = rows.groupBy("book", "island").agg(F.array_sort(F.collect_list(item)).alias("items"))
    firsts = runs.select("book", "island", F.explode(fold(F.col("items"), target_words, most, max_output_tokens, least)).alias("seq"), F.lit(1).alias("_first"))
    run = Window.partitionBy("book", "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    oversized = (F.col("words") > most) | (estimate(F.col("words"), F.lit(1)) > max_output_tokens)
    packed = rows.join(firsts, ["book", "island", "seq"], "left").withColumn("chunk_no", F.count("_first").over(run).cast("int")).drop("_first")
    return packed.withColumn("chunk_id", F.concat(F.col("chapter"), F.lit("/c"), F.format_string("%02d", "chunk_no"))).withColumn("oversized", oversized)


def chunk_document(blocks: DataFrame, target_words: int = TARGET_WORDS, max_words: int | None = None, context_blocks: int = CONTEXT_BLOCKS, max_output_tokens: int = MAX_OUTPUT_TOKENS, min_split_words: int | None = None) -> DataFrame:
    """A row for each chunk: book, chunk_id, chapter, first_seq, blocks (in order), prev_context (up
    to context_blocks before it in the run), next_context (the one after), word_count,
    estimated_output_tokens, oversized, warnings."""
    packed = pack(blocks, target_words, max_words, max_output_tokens, min_split_words)
    block = F.struct("seq", "id", "kind", "level", "text")
    run = Window.partitionBy("book", "island").orderBy("seq")
    near = packed.withColumn("_b", block)
    before = F.collect_list("_b").over(run.rowsBetween(-context_blocks, -1)) if context_blocks else F.array().cast("array<struct<seq:bigint,id:string,kind:string,level:int,text:string>>")
    near = near.withColumn("_prev", before).withColumn("_next", F.lead("_b").over(run))
    chunks = near.groupBy("book", "island", "chunk_no", "chunk_id", "chapter").agg(
        F.min("seq").alias("first_seq"),
        F.array_sort(F.collect_list("_b")).alias("blocks"),
        F.min_by("_prev", "seq").alias("prev_context"),
        F.max_by(F.array_compact(F.array("_next")), "seq").alias("next_context"),
        F.sum("words").alias("word_count"),
        F.max("oversized").alias("oversized"),
    )
    tokens = estimate(F.col("word_count"), F.size("blocks"))
    warning = F.format_string("block of %d words, about %d output tokens: over the limit, sent whole", F.col("word_count"), tokens)
    return chunks.select(
        "book", "chunk_id", "chapter", "first_seq", "blocks", "prev_context", "next_context", "word_count",
        tokens.alias("estimated_output_tokens"), "oversized",
        F.when(F.col("oversized"), F.array(warning)).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def block_ids(chunks: DataFrame) -> Column:
    return F.transform(chunks["blocks"], lambda b: b["id"])


def manifest(chunks: DataFrame, source_sha256: str = "") -> DataFrame:
    """The plan as rows that carry ids instead of texts."""
    return chunks.select("chunk_id", "chapter", block_ids(chunks).alias("block_ids"), "word_count", "estimated_output_tokens", "oversized", "warnings", F.lit(source_sha256).alias("source_sha256"), "first_seq")


def ascii_json(text: Column) -> Column:
    """A string as JSON with all but ASCII escaped (ids hold one such character, the section sign)."""
    quoted = F.to_json(F.array(text))
    return F.replace(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit("§"), F.lit("\\u00a7"))


def chunk_plan_hash(chunks: DataFrame) -> DataFrame:
    """book, chunk_plan: 16 hex digits over the ids of chunks and blocks, in order."""
    ids = F.array_join(F.transform(block_ids(chunks), ascii_json), ", ")
    record = F.concat(F.lit('{"block_ids": ['), ids, F.lit('], "id": '), ascii_json(F.col("chunk_id")), F.lit("}"))
    rows = chunks.select("book", F.struct("first_seq", record.alias("r")).alias("x"))
    plan = rows.groupBy("book").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return plan.select("book", digest(F.concat(F.lit("["), F.array_join(F.transform("x", lambda x: x["r"]), ", "), F.lit("]")), 16).alias("chunk_plan"))


def summarize(chunks: DataFrame) -> DataFrame:
    """book, chunks, words, tokens, largest_chunk (the first of equals), largest_words, oversized."""
    return chunks.groupBy("book").agg(
        F.count("*").alias("chunks"),
        F.sum("word_count").alias("words"),
        F.sum("estimated_output_tokens").alias("tokens"),
        F.max_by("chunk_id", F.struct("word_count", -F.col("first_seq"))).alias("largest_chunk"),
        F.max("word_count").alias("largest_words"),
        F.count_if("oversized").alias("oversized"),
    )
