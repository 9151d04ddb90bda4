"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases whose ends depend on a few symbols around them only, found by
deterministic coin tossing; each phrase gets a name from its symbols, and the names are parsed again.
Equal substrings thus have equal phrases inside, wherever they stand. The fingerprint is a sketch of
the set of names: of the names that fall into each of BINS bins, the one with the least hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bound_batches, documents, materialize

BINS = 64
#: Names of phrases from this level on make the fingerprint; a shorter text's last name always does.
LEVEL = 2
#: Code points that are parsed together.
GROUP = 1 << 18
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing: twice the lowest bit in which a symbol differs from the one before
    it, and its value there. Neighbours that differ still differ, with far fewer values."""
    one = x.dtype.type(1)
    diff = np.empty_like(x)
    np.bitwise_xor(x[1:], x[:-1], out=diff[1:])
    diff[first] = 1
    low = np.bitwise_count((diff & (~diff + one)) - one)
    return (low << np.uint8(1)) | ((x >> low.astype(x.dtype)) & one).astype(np.uint8)


def parse(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the names of the phrases of several sequences that lie side by side, and where each
    sequence begins among them. first: where each begins in symbols; none is empty."""
    begins = np.ones(len(symbols), bool)  # runs of one symbol become one symbol
    np.not_equal(symbols[1:], symbols[:-1], out=begins[1:])
    begins[first] = True
    if not begins.all():
        at = np.flatnonzero(begins)
        length = np.diff(at, append=len(symbols)).astype(_U)
        symbols = np.where(length > _U(1), _mix(symbols[at] ^ (length * _U(0x9E3779B97F4A7C15))), symbols[at])
        first = (np.cumsum(begins) - 1)[first]
    labels = _toss(symbols, first)
    for _ in range(3):  # 64 bits, below 128, 14, 8, 6
        labels = _toss(labels, first)
    starts = np.zeros(len(symbols), bool)
    starts[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    starts[first[1:] - 1] = False  # the last symbol of a sequence has no right neighbour
    starts[first] = True
    at = np.flatnonzero(starts)
    number = np.cumsum(starts) - 1
    place = (np.arange(len(symbols)) - at[number]).astype(_U)
    names = _mix(np.add.reduceat(_mix(symbols + place * _U(0xD6E8FEB86659FD93)), at) + np.diff(at, append=len(symbols)).astype(_U))
    return names, number[first]


def sketches(texts: list[str]) -> np.ndarray:
    """A row of BINS 16-bit values for each text; 0 marks a bin without a name."""
    n = len(texts)
    best = np.full(n * BINS, 0xFFFFFFFFFFFF, _U)
    lengths = np.array([len(t) for t in texts])
    owner = np.flatnonzero(lengths)
    if len(owner):
        symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)
        first = (np.cumsum(lengths) - lengths)[owner]
        level = 0
        while len(owner):
            symbols, first = parse(symbols, first)
            level += 1
            count = np.diff(first, append=len(symbols))
            done = count == 1
            used = np.repeat(done | (level >= LEVEL), count)
            key = _mix(symbols[used] ^ _U(0x2545F4914F6CDD1D))
            bins = (key >> _U(58)).astype(np.int64) + np.repeat(owner, count)[used] * BINS
            np.minimum.at(best, bins, key & _U(0xFFFFFFFFFFFF))
            if done.any():  # a text of one phrase is parsed to its end
                symbols, owner, count = symbols[np.repeat(~done, count)], owner[~done], count[~done]
                first = np.cumsum(count) - count
    values = np.where(best == _U(0xFFFFFFFFFFFF), 0, (best & _U(0xFFFF)) | _U(1)).astype(">u2")
    return values.reshape(n, BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of names in common (twice the common ones over all of both), row by row: 1 for
    equal sketches, also for two without names."""
    equal = ((a == b) & (a != 0)).sum(1)
    either = ((a != 0) | (b != 0)).sum(1)
    jaccard = np.where(either > 0, equal / np.maximum(either, 1), 1.0)
    return 2 * jaccard / (1 + jaccard)


_ROW = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(ids: list, texts: list[str], following: list[str]) -> list:
    """The columns of _ROW for texts and the text that follows each."""
    edited = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, following)]
    own, changed = sketches(texts), sketches(edited)
    after = own[1:] if texts[1:] == following[:-1] else None
    after = np.concatenate([after, sketches(following[-1:])]) if after is not None else sketches(following)
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array([x.tobytes().hex() for x in own]),
        pa.array([x.tobytes().hex() for x in changed]),
        pa.array(likeness(own, changed), pa.float64()),
        pa.array(likeness(own, after), pa.float64()),
    ]


def groups(pairs: Iterator[tuple]) -> Iterator[tuple[list, list]]:
    """Rows of (id, text) in lists of about GROUP code points."""
    ids, texts, size = [], [], 0
    for i, t in pairs:
        ids.append(i)
        texts.append(t)
        size += len(t) + 8
        if size >= GROUP:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fingerprint of every row (doc_id, n_chars, fingerprint), texts staying where they are.

    Null and empty texts have no names: all bins are 0. Equal texts have equal fingerprints."""
    bound_batches(docs.sparkSession)

    def mark(rows):
        pairs = (p for ids, texts in batches(rows, ["doc_id", "text"]) for p in zip(ids, texts))
        for ids, texts in groups(pairs):
            arrays = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([x.tobytes().hex() for x in sketches(texts)])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_chars", "fingerprint"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return plain.mapInArrow(mark, "doc_id long, n_chars long, fingerprint string")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row beside the next one in ascending doc_id (after the last one: the first): _ROW.

    Null ids come first, equal ids are ordered by the hash of their text (and the text). Null texts are empty. The texts are
    dealt out by ranges of doc_id and sorted; a task compares each row with the next it reads. Only
    the first and the last row of each task wait for a join, in which every task has one pair."""
    spark = docs.sparkSession
    bound_batches(spark)

    def walk(rows):
        part = TaskContext.get().partitionId()
        pairs = (p for ids, texts in batches(rows, ["doc_id", "text"]) for p in zip(ids, texts))
        held = None

        def edge(kind, i, text):
            nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), *nothing, pa.array([kind]), pa.array([part], pa.int32()), pa.array([text])], [*_ROW, "kind", "part", "text"])

        for ids, texts in groups(pairs):
            if held is None:
                yield edge("first", ids[0], texts[0])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = ids[-1], texts[-1]
            if n := len(ids) - 1:
                arrays = compare(ids[:-1], texts[:-1], texts[1:])
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(["row"] * n), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string())], [*_ROW, "kind", "part", "text"])
        if held is not None:
            yield edge("last", *held)

    def close(rows):
        for ids, texts, following in batches(rows, ["doc_id", "text", "following"]):
            yield pa.RecordBatch.from_arrays(compare(ids, texts, following), _ROW)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ordered = plain.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    walked = materialize(ordered.mapInArrow(walk, f"{_SCHEMA}, kind string, part int, text string"), "walked")
    parts = sorted(r[0] for r in walked.where("kind = 'first'").select("part").collect())  # one number for each task
    order = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    lasts = walked.where("kind = 'last'").select("doc_id", "text", "part").join(F.broadcast(order), "part")
    firsts = walked.where("kind = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    closed = lasts.join(firsts, "next_part").select("doc_id", "text", "following").mapInArrow(close, _SCHEMA)
    return walked.where("kind = 'row'").select(*_ROW).union(closed)


def op7_phrases(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and their likeness."""
    return compare_with_next(documents(spark, sf_dir))
