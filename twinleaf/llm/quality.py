"""Quality rules, line first: lines that fail a rule go, and documents that lose too much text go.

Everything is a DataFrame expression on one row, so nothing is shuffled and no document is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Between the links of a navigation row. Guillemets quote in French and German and are none.
SEPARATORS = "|<>›·•"
#: A row of links has SEPARATORS for every so many of its words at least, and two or more.
LINK_WORDS = 5
#: A boilerplate phrase fails lines of fewer words; a longer line says something else too.
SHORT_LINE = 25
WINDOW = 8
#: A line ends in one of these, or it is no sentence.
SENTENCE_END = r"""[.!?:;…"'”»)\]][\x20\x09-\x0D]*\z"""
#: Phrases that begin at no letter's right side, in lower case.
BOILERPLATE = (
    r"(?:^|[^a-z])(?:cookie|javascript|privacy policy|terms of (?:use|service)|all rights reserved|licensed under|copyright"
    r"|subscribe to|click here|sign (?:up|in)\b|log ?in\b|lorem ipsum|share this|read more|skip to content"
    r"|alle rechte vorbehalten|datenschutzerklärung|impressum|nutzungsbedingungen|weiterlesen|hier klicken"
    r"|tous droits réservés|politique de confidentialité|mentions légales|conditions d'utilisation|lire la suite|cliquez ici"
    r"|todos los derechos reservados|política de privacidad|aviso legal|términos de uso|leer más|haga clic aquí)"
)


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def without_space(text: Column) -> Column:
    return F.translate(text, SPACE, "")


def count_of(text: Column, chars: str) -> Column:
    """How many of some characters a text has; most texts have none, and a search tells that soonest."""
    return F.when(text.rlike(f"[{chars}]"), F.length(text) - F.length(F.translate(text, chars, ""))).otherwise(0)


def words_of(text: Column) -> Column:
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def repeated_words(words: Column) -> Column:
    """How many words (a column that is bound already) lie in windows of WINDOW words that occur
    twice or more. Hashes of all windows only tell whether there can be any; where there can, the
    windows themselves are sorted and compared, so the count is exact."""
    last = F.size(words) - (WINDOW - 1)
    starts = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))

    def exact(sorted_windows: Column) -> Column:
        def met_again(x: Column, i: Column) -> Column:
            same = lambda y: F.coalesce(x["k"] == y["k"], F.lit(False))
            return same(F.get(sorted_windows, i - 1)) | same(F.get(sorted_windows, i + 1))

        places = F.sort_array(F.transform(F.filter(sorted_windows, met_again), lambda x: x["i"]))
        return let(places, lambda p: total(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))).cast("long"))))

    windows = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("k"), i.alias("i")))
    # each word is hashed once; hashes of 2, 4 and 8 words are made of two of the size below

    def joined(hashes: Column, size: int) -> Column:
        """The hash of each run of twice as many words."""

        def of(h: Column) -> Column:
            n = F.greatest(F.size(h) - size, F.lit(0))
            return F.zip_with(F.slice(h, 1, n), F.slice(h, size + 1, n), lambda x, y: F.xxhash64(x, y))

        return let(hashes, of)

    hashes = joined(joined(joined(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)
    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(last < 2, F.lit(0).cast("long")).when(some, let(F.sort_array(windows), exact)).otherwise(F.lit(0).cast("long"))


def line_passes(line: Column) -> Column:
    """A line stays if it ends like a sentence, is no row of links (two separators or more, and one for
    every LINK_WORDS words) or of symbols (over a tenth of its characters), and is no short line with a
    boilerplate phrase."""
    n_words = F.size(words_of(line))
    few = let(count_of(line, SEPARATORS), lambda n: (n < 2) | (n * LINK_WORDS < n_words))
    plain = ~line.rlike(f"[{SYMBOLS}]") | (count_of(line, SYMBOLS) * 10 <= F.length(without_space(line)))
    return line.rlike(SENTENCE_END) & few & plain & ~(F.lower(line).rlike(BOILERPLATE) & (n_words < SHORT_LINE))


def judge(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, min_share: float = 0.5, only_kept: bool = False) -> DataFrame:
    """Counts and verdict of every row, beside row: its columns (those named in keep, or all).

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; base_failed: under 20 words, or
    over 30 % of them in repeated windows; cleaned_text: the lines that pass, joined; kept: not
    base_failed and at least min_share of word_chars in lines that pass. only_kept leaves out the other
    rows. Null and empty texts have no words and fail. Rows are judged alone, so copies and ties don't
    matter; an empty table gives no rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))

    def by_line(lines: Column) -> Column:
        passed = F.filter(lines, line_passes)
        return F.struct(
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(lines).alias("n"),
            passed.alias("passed"),
        )

    lines = let(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""), by_line)
    counts = F.struct(words.alias("w"), lines.alias("l"), F.length(without_space(text)).cast("long").alias("word_chars"), count_of(text, SYMBOLS).cast("long").alias("n_symbols"))

    def verdict(c: Column) -> Column:
        passed = c["l"]["passed"]
        chars = F.when(F.size(passed) == c["l"]["n"], c["word_chars"]).otherwise(total(F.transform(passed, lambda x: F.length(without_space(x)).cast("long"))))
        failed = (c["w"]["n_words"] < 20) | (100 * c["w"]["n_repeat_words"] > 30 * c["w"]["n_words"])
        return F.struct(
            c["w"]["n_words"].alias("n_words"),
            c["word_chars"].alias("word_chars"),
            c["n_symbols"].alias("n_symbols"),
            c["l"]["n_dup_lines"].alias("n_dup_lines"),
            c["w"]["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            F.array_join(passed, "\n").alias("cleaned_text"),
            (~failed & (chars >= min_share * c["word_chars"])).alias("kept"),
        )

    # a generator, so that no filter or projection above is pushed below it and computes all that again
    judged = F.transform(F.array(counts), verdict)
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    return docs.select(row.alias("row"), F.inline(F.filter(judged, lambda v: v["kept"]) if only_kept else judged))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of all documents."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = judge(docs, keep=["doc_id"])
    return found.select("row.doc_id", *[c for c in found.columns if c not in ("row", "cleaned_text")])


_QUOTED = {k: v.replace("'", "''") for k, v in {"end": SENTENCE_END, "boilerplate": BOILERPLATE}.items()}
OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') AS k
  FROM w, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
n AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM r) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  coalesce(list_sum(list_transform(list_filter(ls, lambda x: regexp_matches(x, '{_QUOTED["end"]}')
      AND (length(x) - length(translate(x, '{SEPARATORS}', '')) < 2
        OR (length(x) - length(translate(x, '{SEPARATORS}', ''))) * {LINK_WORDS} < len(list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda y: y <> '')))
      AND (length(x) - length(translate(x, '{SYMBOLS}', ''))) * 10 <= length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g'))
      AND NOT (regexp_matches(lower(x), '{_QUOTED["boilerplate"]}') AND len(list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda y: y <> '')) < {SHORT_LINE})),
    lambda x: length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g')))), 0) AS passed
  FROM w LEFT JOIN n ON w.doc_id = n.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND passed >= 0.5 * word_chars AS kept
FROM c
"""
