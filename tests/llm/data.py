"""Small tables with the awkward cases: nulls, blanks, ties, copies, long texts, clashing columns."""

import random

from pyspark.sql import types as T

WORDS = "the of and to in red fox runs over lazy dog während größe straße niño señal œuvre déjà vu don't we'll I'M 12 3.5 a-b x_y".split()
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
ODD = [
    None, "", " ", "\n\n", "a", "a  b", " lead", "trail  ", "tab\tand\nnew\r\nline", "x" * 5000, "ab" * 3000, "wide　space   mix \x1c y", "nul\x00l",
    "é combining İstanbul ΣΑΣ", "\U0001f600 emoji 日本語", "<|endoftext|> in text <|startoftext|>", "end.Start,mid;x!y?z:w", "'s 'S ''s don't",
    "!!! ... ###", "one two", "1234567 12.5 ²½",
]


def texts(n: int, seed: int = 3) -> list:
    r = random.Random(seed)
    out = list(ODD)
    while len(out) < n:
        words = [r.choice(WORDS) for _ in range(r.choice([3, 12, 60, 400]))]
        out.append(" ".join(w + r.choice(["", "", "", ".", ",", "!\n"]) for w in words))
        if r.random() < 0.2:
            out.append(out[-1])  # an exact copy
        if r.random() < 0.2:
            out.append(out[-1] + " " + r.choice(WORDS))  # a near copy
    return out[:n]


def documents(spark, n: int = 90, seed: int = 3):
    rows = [(i * 7 - 50, t, ["en", "de", None][i % 3], "src", len(t or "")) for i, t in enumerate(texts(n, seed))]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Columns that clash with the operators' own, repeated rows, a null id."""
    base = documents(spark, 40)
    more = spark.createDataFrame([(6, "same row", "en", "s", 8)] * 3 + [(None, "no id", "en", "s", 5)], SCHEMA)
    both = base.union(more)
    for name in ("shard", "slot", "size", "part", "kind", "fp", "key", "score", "kept", "ids", "_w", "row_number", "n_tokens", "root"):
        both = both.withColumn(name, both["source"])
    return both


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
