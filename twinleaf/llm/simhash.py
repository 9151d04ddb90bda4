"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints link at a distance of 3 or less. Half the radius, rounded down, is 1, and two balls of
radius 1 meet only up to distance 2; balls of radius 2 would take 2,081 rows for each fingerprint.
So the 64 bits are dealt into three blocks and one block at a time is masked: of 3 differing bits,
the block that holds most holds one at least, and at most 2 remain. For each mask a fingerprint emits
itself and all variants at distance 1, 131 rows in all; fingerprints within reach share a variant, and
every colliding pair is verified on all 64 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bound_batches, discard, documents, materialize
from .components import connected_components

RADIUS = 3
#: Bits of the three blocks, from the lowest.
BLOCKS = ((0, 22), (22, 43), (43, 64))
#: Bytes of a text whose words are held at once.
PART = 1 << 18
_SPACE = re.compile(rb"[ \t-\r]")


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, repeats included, in arrays of bounded size: words are between ASCII white
    space, A-Z in lower case, a shingle is width words with a space between them. Fewer words: all of
    them; no word at all: nothing."""
    import xxhash

    digest, data, at, held, any_yet = xxhash.xxh64_intdigest, (text or "").encode().lower(), 0, [], False
    while at < len(data):
        end = at + PART
        cut = _SPACE.search(data, end) if end < len(data) else None
        end = cut.start() if cut else len(data)
        words = held + data[at:end].split()
        if len(words) >= width:
            yield np.array([digest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(width))))], np.uint64)
            any_yet = True
        held, at = words[max(0, len(words) - width + 1) :], end
    if held and not any_yet:
        yield np.array([digest(b" ".join(held), seed)], np.uint64)


def fingerprint(hashes: Iterable[np.ndarray]) -> int:
    """A bit is 1 if it is set in over half of the hashes; no hash at all: 0."""
    ones, n = np.zeros(64, np.int64), 0
    for part in hashes:
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def simhash(text: str | None, width: int = 3) -> int:
    """The fingerprint of a text's shingles."""
    return fingerprint(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    bound_batches(docs.sparkSession)

    def compute(rows):
        for ids, texts in batches(rows, ["doc_id", "text"]):
            fps = np.array([simhash(t, width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(compute, "doc_id long, fp long")


def links(distinct_fps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints that differ in 1 to RADIUS bits, each once.

    distinct_fps: one long column fp without repeats. Copies of a text are one fingerprint here, so
    no group of copies is ever paired; a key's fingerprints all lie within distance 2 outside one
    block, and only pairs that pass verification leave the join."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def variants(low: int, high: int):
        masked = F.col("fp").bitwiseAND(F.lit(signed((1 << 64) - (1 << high) + (1 << low) - 1)))
        flips = [0] + [1 << i for i in range(64) if not low <= i < high]
        listed = F.split(F.lit(",".join(str(signed(x)) for x in flips)), ",").cast("array<bigint>")
        return F.transform(listed, lambda flip: masked.bitwiseXOR(flip))

    emitted = [variants(low, high) for low, high in BLOCKS]
    distinct_fps = distinct_fps.repartition("fp")  # the rows grow a hundredfold: spread them before that
    balls = distinct_fps.select("fp", F.explode(F.concat(*emitted)).alias("key"))
    # both sides have the same form, so that they share one shuffle; merged by hint, as Spark takes them to be as small
    # as the table that they are made of and would send 131 times as many rows through the driver
    left, right = (balls.select(F.col("key").alias(f"key_{x}"), F.col("fp").alias(x)) for x in "ab")
    near = (F.col("key_a") == F.col("key_b")) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    return left.hint("merge").join(right, near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp, component_id of every row: component_id is the smallest doc_id reachable by links
    between fingerprints, itself included.

    Null, empty and blank texts have fingerprint 0 and link like any other. Repeated rows are rows of
    their own. A null doc_id counts as no id: it is never a component_id unless its component has no
    other. An empty table gives no rows. Texts are read once; beyond that only ids and fingerprints
    move, and links join each distinct fingerprint, not each copy."""
    marked = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    least = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(links(least.select("fp")))
    joined = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = materialize(joined, "roots")
    discard(least)
    discard(roots)
    component = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = joined.join(component, "root").select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(labels, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
