"""Markdown documents to blocks: frontmatter, splitting, kinds, chapters and content-hash ids.

Every operator takes and returns DataFrames. Order is a column (seq), never the order of rows, and
all windows are partitioned by book, so books are parsed side by side.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import NOT_WS, WS, digest, fold_space, is_blank, strip, word_count

#: Kinds that are translated, and kinds that pass through.
TRANSLATABLE = ("para", "heading", "list", "quote", "table")
OPAQUE = ("image", "code", "toc", "rule")
# The patterns of the kinds.
FENCE = rf"\A{WS}*```"
HEADING = rf"(?ds)\A(#{{1,6}}){WS}+(.*)\z"
RULE = rf"\A{WS}*(?:(?:\*{WS}*){{3,}}|(?:-{WS}*){{3,}}|(?:_{WS}*){{3,}})\z"
TOC_LINE = rf"\A{WS}*(?:[-*+]{WS}+)?\[[^\]]*\]\(#[^)]*\){WS}*\z"
QUOTE = rf"\A{WS}*>"
LIST = rf"\A{WS}*(?:[-*+]|\p{{Nd}}+[.)]){WS}+"
TABLE = rf"\A{WS}*\|"


def split_frontmatter(docs: DataFrame) -> DataFrame:
    """book, src -> book, meta_raw (null without frontmatter), body.

    Frontmatter starts the text with --- and ends at the next line that does."""
    end = F.locate("\n---", F.col("src"), 4)
    has = F.col("src").startswith("---") & (end > 0)
    return docs.select(
        "book",
        F.when(has, F.regexp_replace(F.substring(F.col("src"), F.lit(4), end - 4), r"\A\n+|\n+\z", "")).alias("meta_raw"),
        F.when(has, F.substring(F.col("src"), end + 4, F.length("src"))).otherwise(F.col("src")).alias("body"),
    )


def frontmatter(split: DataFrame) -> DataFrame:
    """book, meta: keys with their values; a scalar has one, a list as many as it has items.

    A line `key: value` is a scalar, `key:` opens a list, and indented `- item` lines belong to the
    list that is open; any other line closes it. Of equal keys the last counts."""
    lines = split.where("meta_raw IS NOT NULL").select("book", F.posexplode(F.split("meta_raw", "\n")).alias("n", "line")).where(~is_blank(F.col("line")))
    item = F.col("line").rlike(rf"\A{WS}+-{WS}+")
    pair = F.col("line").contains(":") & ~F.col("line").startswith(" ")
    key, value = strip(F.substring_index("line", ":", 1)), strip(F.regexp_replace("line", r"(?s)\A[^:]*:", ""))
    marked = lines.select("book", "n", "line", item.alias("item"), F.when(~item & pair, key).alias("key"), F.when(~item & pair, value).alias("value"))
    # the line that the items after it belong to: the last one that is no item
    last = F.last(F.when(~F.col("item"), F.struct(F.col("n"), F.when(F.col("value") == "", F.col("key")).alias("list"))), ignorenulls=True)
    owned = marked.withColumn("open", last.over(Window.partitionBy("book").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    rows = owned.select(
        "book",
        "n",
        F.coalesce("key", F.when(F.col("item"), F.col("open.list"))).alias("key"),
        F.when(F.col("key").isNotNull(), F.col("n")).otherwise(F.col("open.n")).alias("at"),
        F.when(F.col("item"), strip(F.regexp_replace("line", r"(?s)\A[^-]*-", ""))).when(F.col("value") != "", F.col("value")).alias("value"),
    ).where("key IS NOT NULL")
    values = rows.groupBy("book", "key", "at").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("n", "value")))), lambda x: x["value"]).alias("values"))
    latest = values.groupBy("book", "key").agg(F.max_by("values", "at").alias("values"))
    return latest.groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct("key", "values"))).alias("meta"))


def raw_blocks(split: DataFrame) -> DataFrame:
    """book, body -> book, seq, lines: blank lines part blocks, except within code fences, and the
    line that closes a fence ends its block; a fence that stays open ends with the text."""
    lines = split.select("book", F.posexplode(F.split("body", "\n")).alias("n", "line"))
    order = Window.partitionBy("book").orderBy("n")
    fence = F.col("line").rlike(FENCE).cast("int")
    lines = lines.withColumn("fence", fence).withColumn("fences", F.sum("fence").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = (F.col("fences") - F.col("fence")) % 2 == 1
    lines = lines.withColumn("gap", (F.col("fence") == 0) & ~inside & is_blank(F.col("line"))).withColumn("closes", (F.col("fence") == 1) & (F.col("fences") % 2 == 0))
    ended = F.coalesce(F.lag(F.col("gap") | F.col("closes")).over(order), F.lit(True))
    lines = lines.withColumn("seq", F.sum(ended.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("NOT gap")
    grouped = lines.groupBy("book", "seq").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    return grouped.select("book", F.col("seq").cast("long"), F.transform("l", lambda x: x["line"]).alias("lines"))


def kind_of(lines: Column) -> Column:
    """The kind of a block: the first that holds."""
    first, n = F.get(lines, F.lit(0)), F.size(lines)
    links = F.size(F.filter(lines, lambda x: x.rlike(TOC_LINE)))
    return (
        F.when(first.rlike(FENCE), "code")
        .when(strip(first).startswith("!["), "image")
        .when(strip(first).rlike(HEADING), "heading")
        .when(first.rlike(RULE), "rule")
        .when((links > 0) & (links >= F.greatest(F.lit(1), F.floor(n * F.lit(0.8)).cast("int"))), "toc")
        .when(first.rlike(QUOTE), "quote")
        .when(first.rlike(LIST), "list")
        .when(first.rlike(TABLE), "table")
        .otherwise("para")
    )


def classify(raw: DataFrame) -> DataFrame:
    """book, seq, lines -> book, seq, kind, level, text, title (of headings)."""
    first = strip(F.get("lines", F.lit(0)))
    kinds = raw.withColumn("kind", kind_of(F.col("lines")))
    heading = F.col("kind") == "heading"
    return kinds.select(
        "book",
        "seq",
        "kind",
        F.when(heading, F.length(F.regexp_extract(first, HEADING, 1))).otherwise(0).alias("level"),
        F.array_join("lines", "\n").alias("text"),
        F.when(heading, F.regexp_extract(first, HEADING, 2)).alias("title"),
    )


@F.pandas_udf(StringType())
def slugify(titles: pd.Series) -> pd.Series:
    """A title as a path part: compatibility form, lower case, words joined by dashes, 32 characters
    at most, `untitled` if nothing is left. Only chapter headings pass through here, as the
    compatibility form has no built-in function."""
    s = titles.str.normalize("NFKD").str.strip().str.lower()
    s = s.str.replace(r"[^\w\s-]", "", regex=True).str.replace(r"[\s_]+", "-", regex=True).str.strip("-")
    return s.str.slice(0, 32).str.strip("-").replace("", "untitled")


def assign_chapters(blocks: DataFrame, chapter_levels: tuple[int, ...] = (1,)) -> DataFrame:
    """Adds chapter: `front` up to the first heading of a level in chapter_levels, then the slug of
    the last such heading; the n-th heading with a slug in its book gets -n from the second on."""
    if not chapter_levels or any(not 1 <= x <= 6 for x in chapter_levels):
        raise ValueError("chapter_levels: one or more of 1 to 6")
    opens = (F.col("kind") == "heading") & F.col("level").isin(*chapter_levels)
    heads = blocks.where(opens).select("book", "seq", slugify("title").alias("slug"))
    nth = F.row_number().over(Window.partitionBy("book", "slug").orderBy("seq"))
    heads = heads.select("book", "seq", F.when(nth == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", nth.cast("string"))).alias("opened"))
    running = Window.partitionBy("book").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    joined = blocks.join(heads, ["book", "seq"], "left")
    return joined.withColumn("chapter", F.coalesce(F.last("opened", ignorenulls=True).over(running), F.lit("front"))).drop("opened")


def paragraph_id(book: Column, chapter: Column, norm: Column, occurrence: Column) -> Column:
    """book/chapter/§hash over the text with folded white space; repeats are told apart by number."""
    nul = F.lit("\x00")
    payload = F.concat(book, nul, chapter, nul, norm, F.when(occurrence > 0, F.concat(nul, F.lit("#"), occurrence.cast("string"))).otherwise(""))
    return F.concat(book, F.lit("/"), chapter, F.lit("/§"), digest(payload, 8))


def assign_ids(blocks: DataFrame) -> DataFrame:
    """Adds id: of translatable kinds, by content and occurrence in the chapter; others get ''."""
    can = F.col("kind").isin(*TRANSLATABLE)
    folded = blocks.withColumn("_can", can).withColumn("_norm", fold_space(F.col("text")))
    nth = F.row_number().over(Window.partitionBy("book", "chapter", "_can", F.xxhash64("_norm"), "_norm").orderBy("seq")) - 1
    folded = folded.withColumn("_occ", nth)
    return folded.withColumn("id", F.when(F.col("_can"), paragraph_id(F.col("book"), F.col("chapter"), F.col("_norm"), F.col("_occ"))).otherwise("")).drop("_can", "_norm", "_occ")


def parse_markdown(docs: DataFrame, chapter_levels: tuple[int, ...] = (1,)) -> DataFrame:
    """book, src -> blocks: book, seq, kind, level, text, chapter, id."""
    blocks = classify(raw_blocks(split_frontmatter(docs)))
    return assign_ids(assign_chapters(blocks, chapter_levels)).select("book", "seq", "kind", "level", "text", "chapter", "id")


def translatable(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("kind").isin(*TRANSLATABLE))


def chapter_slugs(blocks: DataFrame) -> DataFrame:
    """book, chapter, first_seq: chapters in the order in which they appear."""
    return blocks.where("chapter != ''").groupBy("book", "chapter").agg(F.min("seq").alias("first_seq")).orderBy("book", "first_seq")


def select_chapters(blocks: DataFrame, chapters: list[str]) -> DataFrame:
    """Blocks of the named chapters; an unknown name is an error that lists those there are."""
    wanted = list(dict.fromkeys(chapters))
    names = blocks.sparkSession.createDataFrame([(c,) for c in wanted], "chapter string")
    unknown = [r[0] for r in names.join(blocks, "chapter", "left_anti").collect()]
    if unknown:
        known = [r["chapter"] for r in chapter_slugs(blocks).limit(200).collect()]
        raise ValueError(f"no such chapter: {', '.join(unknown)}; there are: {', '.join(known)}")
    return blocks.join(F.broadcast(names), "chapter", "left_semi")


def with_word_count(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("words", word_count(F.col("text")))


def lines_as_blocks(docs: DataFrame, book: str = "source", chapter: str = "doc_id", text: str = "text") -> DataFrame:
    """Plain documents with a block for each line that isn't blank: book, chapter, seq, text, id, and
    the columns that docs has besides."""
    more = [c for c in docs.columns if c not in (book, chapter, text, "book", "chapter", "seq", "kind", "id", "line")]
    lines = docs.select(F.col(book).alias("book"), F.col(chapter).cast("string").alias("chapter"), *more, F.posexplode(F.split(F.col(text), "\n")).alias("seq", "text"))
    lines = lines.where(F.col("text").rlike(NOT_WS)).withColumn("kind", F.lit("para"))
    return assign_ids(lines)
