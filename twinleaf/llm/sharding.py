"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over row numbers.

Row numbers are global and gapless. The permutation is a bijection of 0..n-1, so shard and slot of a
row follow from its number and the seed alone, and shards differ by at most one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize

#: Cells in which rows are numbered, at least, and rows for which there is one; only counts of cells, never
#: rows, reach the driver.
CELLS, CELL_ROWS = 4096, 1 << 16
#: The prime, and the factors, of the round function.
PRIME, FACTOR, SECOND = 2147483647, 48271, 69621
ROUNDS = 8
#: Steps of one walk. The domain exceeds n by less than sqrt(n) + 1 values, so a walk of k steps has a
#: probability of about n ** (-k / 2); a walk that does not end here raises an error.
WALK = 64


def round_keys(seed: int) -> list[int]:
    return [(seed * 1_000_003 + (i + 1) * 1_640_531_527) % PRIME for i in range(ROUNDS)]


def permuted(number: Column, n: int, seed: int = 42) -> Column:
    """Where the permutation of 0..n-1 puts a number: a Feistel network on pairs (left, right) in
    a * b >= n values, walked until the value is below n. Rounds are plain integer arithmetic."""
    if n < 2:
        return number
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    keys = F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.lit(i % 2 == 0).alias("left")) for i, k in enumerate(round_keys(seed))])

    def mixed(x: Column, key: Column) -> Column:
        first = (x * FACTOR + key) % PRIME
        return (first * SECOND + F.shiftright((x * FACTOR + key) % PRIME, 16)) % PRIME

    def turn(state: Column, k: Column) -> Column:
        left, right = state["l"], state["r"]
        return F.struct(
            F.when(k["left"], (left + mixed(right, k["key"])) % a).otherwise(left).alias("l"),
            F.when(~k["left"], (right + mixed(left, k["key"])) % b).otherwise(right).alias("r"),
        )

    def once(x: Column) -> Column:
        start = F.struct(((x - x % b) / b).cast("long").alias("l"), (x % b).alias("r"))
        return F.aggregate(keys, start, turn, lambda s: s["l"] * b + s["r"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(number), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def row_numbers(rows: DataFrame, by: list[str], spread: Column) -> tuple[DataFrame, int]:
    """The columns of by, with a gapless global `row_number` (from 0), and how many rows there are.

    Rows fall into cells by a number that spreads them, and are ordered by their cell and by; equal rows
    are counted before they meet. The driver sees one count for each cell, and there is a cell for every
    CELL_ROWS rows."""
    cells = max(CELLS, rows.count() // CELL_ROWS)
    groups = rows.groupBy(*by).agg(F.count("*").alias("_copies")).withColumn("_cell", F.pmod(spread, F.lit(cells)).cast("int"))
    counts = {r[0]: r[1] for r in rows.groupBy(F.pmod(spread, F.lit(cells)).cast("int")).count().collect()}
    starts, n = [], 0
    for c in range(cells):
        starts.append(n)
        n += counts.get(c, 0)
    offsets = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")
    until = F.sum("_copies").over(Window.partitionBy("_cell").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)) + F.get(offsets, F.col("_cell"))
    numbered = groups.withColumn("_until", until)
    return numbered.select(*by, F.explode(F.sequence(F.col("_until") - F.col("_copies"), F.col("_until") - 1)).alias("row_number")), n


#: Where a row stands in the cells, whatever order its ids and texts come in.
SPREAD = "text_crc32 + pmod(coalesce(doc_id, 0), 1000003) * 31"


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot of every row.

    Null text: no bytes, crc 0. Null or repeated ids, and fully equal rows, are rows of their own:
    each gets a row number and a slot (which of several equal rows gets which is immaterial). An
    empty table gives no rows. Other columns of docs are ignored, whatever their names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    digest = materialize(digest, "sharding")  # texts are read once; both uses see the same rows
    numbered, n = row_numbers(digest, ["doc_id", "text_crc32", "size"], F.expr(SPREAD))
    placed = numbered.withColumn("_p", permuted(F.col("row_number"), n, seed))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        "row_number",
        (F.col("_p") % shards).cast("int").alias("shard"),
        ((F.col("_p") - F.col("_p") % shards) / shards).cast("long").alias("slot"),
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39, under the law `rows`."""
    return shard_documents(documents(spark, sf_dir)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def _oracle(shards: int = 40, seed: int = 42) -> str:
    """The same rows in DuckDB: CRC-32 byte by byte, and the network round by round."""
    left, right = "x // b", "x % b"
    for i, key in enumerate(round_keys(seed)):
        source, target, size = (right, left, "a") if i % 2 == 0 else (left, right, "b")
        first = f"(({source}) * {FACTOR} + {key}) % {PRIME}"
        turned = f"(({target}) + ({first} * {SECOND} + (({first}) >> 16)) % {PRIME}) % {size}"
        pair = (turned, right) if i % 2 == 0 else (left, turned)
        inner = f"SELECT i, n, a, b, {pair[0]} AS l, {pair[1]} AS r FROM " + (f"({inner}) AS q{i}" if i else "w WHERE x >= n OR step = 0")
        left, right = "l", "r"
    return f"""WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
h AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, hex(coalesce(text, '')) AS s FROM documents),
c AS (SELECT doc_id, size, list_transform(range(1, length(s), 2), lambda i: (strpos('0123456789ABCDEF', s[i]) - 1) * 16 + strpos('0123456789ABCDEF', s[i + 1]) - 1) AS bs FROM h),
d AS MATERIALIZED (SELECT doc_id, size::BIGINT AS size, CASE WHEN size = 16 THEN 0 ELSE xor(list_reduce(bs, lambda c, y: xor(c >> 8, t[1 + (xor(c, y) & 255)]), 4294967295::BIGINT), 4294967295) END::BIGINT AS text_crc32 FROM c, tab),
m AS (SELECT count(*) AS n, floor(sqrt(count(*) - 1))::BIGINT + 1 AS a FROM d),
e AS (SELECT d.*, n, a, (n + a - 1) // a AS b, row_number() OVER (ORDER BY ((text_crc32 + ((coalesce(doc_id, 0) % 1000003 + 1000003) % 1000003) * 31) % greatest({CELLS}, n // {CELL_ROWS})), doc_id NULLS FIRST, text_crc32, size) - 1 AS i FROM d, m),
w(i, n, a, b, x, step) AS (SELECT i, n, a, b, i, 0 FROM e UNION ALL SELECT i, n, a, b, l * b + r, 1 FROM ({inner}) AS z),
p AS (SELECT i, x FROM w WHERE step > 0 AND x < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {shards})::INTEGER AS shard, (x // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard, e.i::BIGINT AS row_number FROM e JOIN p ON p.i = e.i"""


OP1_SQL = _oracle()
