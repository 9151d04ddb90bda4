"""Column functions for text: white space, words, numbers, scripts, and Markdown fragments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that counts (29 code points), and the patterns that define words,
# numbers and marks. Results depend on them as they stand.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOT_WS = r"[^\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NUMBER = r"(?i)(?<![A-Za-z0-9_-])\p{Nd}+(?:[.,]\p{Nd}+)*(?=\z|-(?:a|per)-|[.,](?!\p{Nd})|[^A-Za-z0-9_.,-])"
FOOTNOTE = r"\[\p{Nd}+\]"
LINK_TARGET = r"\]\(([^)]+)\)"
WORD = r"[A-Za-z]+(?:['’-][A-Za-z]+)?"
WORD_CHARACTER = r"[A-Za-z'’-]"
CJK = r"[\u3400-\u9fff]"
FOREIGN = r"[\u0370-\u03ff\u1f00-\u1fff]|[\u0400-\u052f]|[\u3040-\u30ff]|\ufffd"
LIST_ITEM = rf"(?md)^{WS}*(?:[-*+]|\p{{Nd}}+[.)]){WS}+"
TAG = r"(?i)</?(?:thinking|analysis|reasoning|tool|assistant)\b"
JSON_KEY = rf"(?i)[{{,]{WS}*[\"'](?:id|zh|translations)[\"']{WS}*:"
RAW_MARKUP = rf"(?i)\A{WS}*</?(?:svg|image)\b"
INLINE_LINK = r"(?<!!)\[([^\]]*)\]\([^)]*\)"
INLINE_IMAGE = r"!\[[^\]]*\]\([^)]+\)"


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(NOT_WS)


def words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text, f"{WS}+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def fold_space(text: Column) -> Column:
    """Words with one space between."""
    return F.array_join(words(text), " ")


def latin_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CJK))


def numbers(text: Column) -> Column:
    """Number tokens without thousands separators, repeats included."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, ",", ""))


def bag_minus(a: Column, b: Column) -> Column:
    """Distinct elements of a with how many more a has than b, where more, in their order: both are
    sorted together once, and the runs of equal elements are compared."""
    tagged = lambda xs, mine: F.transform(xs, lambda x: F.struct(x.alias("x"), F.lit(mine).alias("mine")))
    items = F.sort_array(F.concat(tagged(a, True), tagged(b, False)))  # false before true; array_sort would interpret a comparison

    def runs(s: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(places, lambda p: F.transform(p, lambda i, k: F.struct(F.get(s, i).alias("of"), (F.coalesce(F.get(p, k + 1), F.size(s)) - i).alias("n"))))

    def extra(r: Column) -> Column:
        def of(x: Column, k: Column) -> Column:
            before = F.get(r, k - 1)
            theirs = F.when(F.coalesce(before["of"]["x"] == x["of"]["x"], F.lit(False)), before["n"]).otherwise(0)
            return F.struct(x["of"]["x"].alias("token"), F.when(x["of"]["mine"], x["n"] - theirs).otherwise(0).alias("n"))

        return F.filter(F.transform(r, of), lambda s: s["n"] > 0)

    nothing = F.array().cast("array<struct<token:string,n:int>>")
    return F.when(F.size(a) > 0, let(let(items, runs), extra)).otherwise(nothing)


def prefix_lines(text: Column) -> Column:
    """Every line quoted; blank lines get a bare mark."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(is_blank(x), F.lit(">")).otherwise(F.concat(F.lit("> "), x))), "\n")


def unquote_lines(text: Column) -> Column:
    """Every line without leading quote marks and the space after them."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, rf"\A{WS}*>+(?:{WS}?)", "")), "\n")


def table_cell(text: Column) -> Column:
    return F.replace(fold_space(text), F.lit("|"), F.lit("\\|"))


def safe_component(text: Column, fallback: Column) -> Column:
    """A file name: forbidden characters and runs of dots become a dash, no dots or spaces at the
    ends, 120 characters at most."""
    clean = F.regexp_replace(strip(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', "-")), r"[. ]+\z", "")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(clean, f"{WS}+", " "), r"\.{2,}", "-"), r"\A[. ]+", "")
    clean = F.when(clean.isin("", ".", ".."), fallback).otherwise(clean)
    cut = F.regexp_replace(F.substring(clean, 1, 120), r"[. ]+\z", "")
    return F.when(cut == "", fallback).otherwise(cut)


def digest(text: Column, length: int) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, length)


def mask_key(key: Column) -> Column:
    return F.when(F.length(key) <= 12, F.lit("***")).otherwise(F.concat(F.substring(key, 1, 6), F.lit("…"), F.right(key, F.lit(4))))


def base_url(text: Column) -> Column:
    """Without trailing slashes and the version suffix."""
    return F.regexp_replace(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), "/+\\z", ""), "/v1\\z", "")
