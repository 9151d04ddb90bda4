"""Checks of assembled Markdown: order and pairing of its parts, rendering, and characters."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import FOREIGN, WS, unquote_lines
from .assemble import MISSING_MARK, expected_parts, with_translation
from .blocks import TRANSLATABLE

# What a two-language heading looks like, and what it must not hold.
HEADING = r"\A#{1,6} [^#].+ · .+\z"
HEADING_LINK = r"(?<!!)\[[^\]]*\]\([^)]+\)"
HEADING_PREFIX = rf"\A#{{1,6}}{WS}+#{{1,6}}{WS}+"
BROKEN_IMAGE = r"(?iU)!(?!\[)(?:Images?|图像)\b"
QUOTED = re.compile(r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*>")
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def traditional_characters(more: str = "於後羆裏", less: str = "瞭鎔") -> str:
    """Characters that a Simplified text shouldn't hold: the frequent ones of Big5 (its first level)
    that GB 2312 lacks, with those of more that both have, and without those of less. It is a rule and
    no curated table; a project that has such a table passes it to verify_artifacts."""

    def code(char: str, codec: str) -> bytes:
        try:
            return char.encode(codec)
        except UnicodeEncodeError:
            return b""

    frequent = lambda c: b"\xa4\x40" <= code(c, "big5") <= b"\xc6\x7e"
    found = (c for c in map(chr, range(0x4E00, 0xA000)) if frequent(c) and not code(c, "gb2312"))
    return "".join(sorted((set(found) | set(more)) - set(less)))


def scan(markdown: str, blocks: list[dict]) -> list[dict]:
    """Forward scan of a chapter. blocks are in order; each has id, body and t, the parts of the block, each
    to be found at or after the end of the one before it. A block's scan ends with its first miss; the
    cursor stays where it is. A translation (the second part of a body) must not be on a quoted line."""
    found, at = [], 0
    for b in blocks:
        for i, part in enumerate(b["t"]):
            place = markdown.find(part, at)
            if place < 0:
                found.append({"id": b["id"], "rule": "artifact.pairing"})
                break
            if b["body"] and i == 1 and QUOTED.match(markdown, markdown.rfind("\n", 0, place) + 1, place):
                found.append({"id": b["id"], "rule": "artifact.translation_quote"})
            at = place + len(part)
    return found


def scan_chapters(batches):
    """scan over Arrow batches of (book, chapter, markdown, b): a moving cursor has no built-in form that
    doesn't start over at each part."""
    for batch in batches:
        rows = [(r["book"], r["chapter"], x["id"], x["rule"]) for r in batch.to_pylist() for x in scan(r["markdown"], r["b"])]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], ["book", "chapter", "block_id", "rule"])


def verify_artifacts(blocks: DataFrame, translations: DataFrame, chapters: DataFrame, traditional: str | None = None) -> DataFrame:
    """Findings of assembled chapters (book, chapter, markdown): book, chapter, block_id, rule, detail."""
    parts = expected_parts(with_translation(blocks, translations))
    body = F.col("kind").isin(*TRANSLATABLE) & (F.col("kind") != "heading")
    ordered = parts.groupBy("book", "chapter").agg(F.array_sort(F.collect_list(F.struct("seq", "id", body.alias("body"), F.col("tokens").alias("t")))).alias("b"))
    with_md = ordered.join(chapters.select("book", "chapter", "markdown"), ["book", "chapter"])
    found = with_md.select("book", "chapter", "markdown", "b").mapInArrow(scan_chapters, "book string, chapter string, block_id string, rule string")
    pairing = found.select("*", F.lit("expected text missing or out of order, or quoted").alias("detail"))

    letters = traditional_characters() if traditional is None else traditional
    said = parts.where(F.col("kind").isin(*TRANSLATABLE) & (F.col("zh") != "")).withColumn("clean", F.when(F.col("kind") == "heading", F.col("zh")).otherwise(unquote_lines(F.col("zh"))))
    odd = F.array_sort(F.array_except(F.split("clean", ""), F.split(F.translate("clean", letters, ""), "")))
    rules = F.array(
        F.when(F.col("clean").rlike(FOREIGN), F.struct(F.lit("artifact.foreign_script").alias("rule"), F.lit("unexpected script").alias("detail"))),
        F.when(F.size(odd) > 0, F.struct(F.lit("artifact.traditional").alias("rule"), F.array_join(odd, "、").alias("detail"))),
    )
    characters = said.select("book", "chapter", F.col("id").alias("block_id"), F.explode(F.array_compact(rules)).alias("x")).select("book", "chapter", "block_id", "x.rule", "x.detail")

    lines = chapters.select("book", "chapter", F.posexplode(F.split("markdown", LINE_BREAK)).alias("n", "line")).where(F.col("line").startswith("#"))
    rule = lambda when, name: F.when(when, F.lit(name))
    checks = F.array(
        rule(~F.col("line").rlike(HEADING), "artifact.heading"),
        rule(F.col("line").rlike(HEADING_LINK), "artifact.heading_link"),
        rule(F.col("line").rlike(r"[\x{3400}-\x{9fff}]") & F.col("line").rlike(HEADING_PREFIX), "artifact.heading_prefix"),
    )
    headings = lines.select("book", "chapter", F.lit("").alias("block_id"), F.explode(F.array_compact(checks)).alias("rule"), F.format_string("line %d", F.col("n") + 1).alias("detail"))

    page = F.array(rule(F.col("markdown").contains(MISSING_MARK), "artifact.missing"), rule(F.col("markdown").rlike(BROKEN_IMAGE), "artifact.malformed_image"))
    pages = chapters.select("book", "chapter", F.lit("").alias("block_id"), F.explode(F.array_compact(page)).alias("rule"), F.lit("").alias("detail"))
    return pairing.unionByName(characters).unionByName(headings).unionByName(pages)
