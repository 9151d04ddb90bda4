"""Blocks and translations to two-language Markdown, chapter by chapter.

Source text comes from blocks alone; a translation is looked up by the id of its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numerals import short_column
from ..functions.text import INLINE_IMAGE, INLINE_LINK, RAW_MARKUP, WS, fold_space, is_blank, prefix_lines, strip, table_cell, unquote_lines
from .blocks import TRANSLATABLE, translatable

# The mark of a missing translation, and how images and chapter numbers are written.
MISSING_MARK = "*（未译 · 待重跑）*"
IMAGE = rf"""!\[[^\]]*\]\({WS}*<?([^\t-\r\x1c-\x20\x85\xa0)>]+)>?(?:{WS}+(?:"[^"]*"|'[^']*'))?{WS}*\)"""
CHAPTER_NUMBER = rf"(?i)\bChapter{WS}+(\d{{1,2}})\b"
CHAPTER_ZH = rf"\A第{WS}*(?:\d{{1,2}}|[零一二三四五六七八九十]+){WS}*章{WS}*"


def safe_path(path: Column) -> Column:
    """A relative path with slashes and without leading dots; null if it leaves its folder."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"/(?:\./)+|/{2,}", "/")
    clean = F.regexp_replace(p, r"\A[./]+|/+\z", "")
    return F.when(p.startswith("/") | p.rlike(r"(?:\A|/)\.\.(?:/|\z)") | (clean == ""), F.lit(None)).otherwise(clean)


def image_target(text: Column) -> Column:
    """The safe path of the first image in a text, or null."""
    return safe_path(F.nullif(F.regexp_extract(text, IMAGE, 1), F.lit("")))


def heading_line(level: Column, text: Column, zh: Column) -> Column:
    """Both languages on one line: the level is the source's; copied prefixes, links and images go
    from the translation, links from the source; chapter numbers become Chinese numerals."""
    en = strip(F.regexp_replace(F.regexp_replace(text, r"\A#+", ""), INLINE_LINK, "$1"))
    out = strip(F.regexp_replace(strip(zh), rf"\A#{{1,6}}{WS}+", ""))
    out = fold_space(F.regexp_replace(strip(F.regexp_replace(out, INLINE_LINK, "$1")), INLINE_IMAGE, ""))
    number = short_column(F.regexp_extract(en, CHAPTER_NUMBER, 1).try_cast("int"), 1, 99)
    out = F.when(number.isNotNull(), strip(F.regexp_replace(out, F.lit(CHAPTER_ZH), F.concat(F.lit("第"), number, F.lit("章 "))))).otherwise(out)
    hashes = F.repeat(F.lit("#"), F.greatest(level, F.lit(1)))
    return F.when(out == "", F.concat_ws(" ", hashes, en)).otherwise(F.concat(hashes, F.lit(" "), out, F.lit(" · "), en))


def annotation_markdown(a: str = "annotation") -> Column:
    """An image's annotation (a struct column) as a note and a table of labels."""
    c = lambda n: F.col(f"{a}.{n}")
    head = F.concat(
        F.lit("> [!note] 图中文字中英对照 · "), table_cell(c("figure")), F.lit("\n> 人工视觉转写 · 置信度："), table_cell(c("confidence")),
        F.lit(" · 原始图片保持不变\n>\n> **图意：** "), table_cell(c("summary_zh")),
        F.when(c("note_zh") != "", F.concat(F.lit("\n>\n> **读图说明：** "), table_cell(c("note_zh")))).otherwise(""),
    )
    rows = F.transform(c("labels"), lambda x: F.concat(F.lit("| "), table_cell(x["en"]), F.lit(" | "), table_cell(x["zh"]), F.lit(" |")))
    return F.concat(head, F.lit("\n\n| English label | 中文对照 |\n|---|---|\n"), F.array_join(rows, "\n"))


def with_translation(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """blocks with zh: the trimmed translation, '' where there is none."""
    tr = translations.select(F.col("block_id").alias("_id"), F.col("zh").alias("_zh"))
    joined = blocks.join(tr, (F.col("id") == F.col("_id")) & (F.col("id") != ""), "left")
    return joined.withColumn("zh", F.coalesce(strip(F.col("_zh")), F.lit(""))).drop("_id", "_zh")


def aligned(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """Translatable blocks that have a translation, with zh as it stands."""
    tr = translations.where(~is_blank(F.col("zh"))).select(F.col("block_id").alias("id"), "zh")
    return translatable(blocks).join(tr, "id")


def missing(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """Translatable blocks without a translation; a blank one is none. Raw markup isn't translated."""
    there = translations.where(~is_blank(F.col("zh"))).select(F.col("block_id").alias("id"))
    return translatable(blocks).where(~F.col("text").rlike(RAW_MARKUP)).join(there, "id", "left_anti")


def stale(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """Translations of blocks that the document doesn't have."""
    return translations.join(translatable(blocks).select(F.col("id").alias("block_id")), "block_id", "left_anti")


def expected_parts(with_zh: DataFrame) -> DataFrame:
    """Adds tokens: what assembly writes for a block, in order; tables of contents are dropped."""
    raw, can, zh = F.col("text").rlike(RAW_MARKUP), F.col("kind").isin(*TRANSLATABLE), F.col("zh")
    body = F.array(prefix_lines(F.col("text")), F.when(zh == "", F.lit(MISSING_MARK)).otherwise(unquote_lines(zh)))
    head = heading_line(F.col("level"), F.col("text"), zh)
    return with_zh.where("kind != 'toc'").withColumn("tokens", F.when(raw | ~can, F.array("text")).when(F.col("kind") == "heading", F.array(head)).otherwise(body))


def assemble(blocks: DataFrame, translations: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """book, chapter, first_seq, markdown, written, missing (ids in order): one row for each chapter.

    annotations (path and the fields of a visual annotation) follow the image with their path."""
    parts = expected_parts(with_translation(blocks, translations))
    absent = F.col("kind").isin(*TRANSLATABLE) & ~F.col("text").rlike(RAW_MARKUP) & (F.col("zh") == "")
    parts = parts.withColumn("tokens", F.when(absent & (F.col("kind") == "heading"), F.concat("tokens", F.array(F.lit(MISSING_MARK)))).otherwise(F.col("tokens")))
    if annotations is not None:
        notes = annotations.select(F.col("path").alias("_path"), F.struct("figure", "summary_zh", "labels", "confidence", "note_zh").alias("annotation"))
        parts = parts.join(notes, (F.col("kind") == "image") & (image_target(F.col("text")) == F.col("_path")), "left")
        parts = parts.withColumn("tokens", F.when(F.col("_path").isNotNull(), F.concat("tokens", F.array(annotation_markdown()))).otherwise(F.col("tokens")))
    done = F.col("kind").isin(*TRANSLATABLE) & ~F.col("text").rlike(RAW_MARKUP) & (F.col("zh") != "")
    chapters = parts.groupBy("book", "chapter").agg(
        F.min("seq").alias("first_seq"),
        F.array_sort(F.collect_list(F.struct("seq", "tokens"))).alias("p"),
        F.count_if(done).alias("written"),
        F.array_sort(F.collect_list(F.when(absent, F.struct("seq", "id")))).alias("m"),
    )
    text = F.regexp_replace(F.array_join(F.flatten(F.transform("p", lambda x: x["tokens"])), "\n\n"), rf"{WS}+\z", "")
    return chapters.select("book", "chapter", "first_seq", F.concat(text, F.lit("\n")).alias("markdown"), "written", F.transform("m", lambda x: x["id"]).alias("missing"))


def assembly_report(chapters: DataFrame, stale_ids: DataFrame) -> DataFrame:
    """book, chapter, written, missing, n_stale, ok: a chapter is whole if nothing is missing, and if the
    document has no stale translation anywhere (their ids are rows of stale_ids)."""
    n = stale_ids.agg(F.count("*").alias("n_stale"))  # one number
    return chapters.crossJoin(F.broadcast(n)).select("book", "chapter", "written", "missing", "n_stale", ((F.size("missing") == 0) & (F.col("n_stale") == 0)).alias("ok"))
