"""Best-fit packing of token pieces into sequences of a fixed capacity, in bounded space.

Each partition packs its own documents as they come. A fixed number of bins is open; a bitset tells
which amounts of free space occur, so the best fit is the lowest set bit at or above the length. When
nothing fits and all bins are open, the fullest one closes.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, bound_batches, documents, text_batches
from .library_tokens import token_ids


#: Packing comes last in a pipeline, when the executors are full: a smaller memo, and smaller spans of text.
MEMO_BYTES, SPAN_BYTES = 24 << 20, 1 << 20


class BestFit:
    """Online best fit with at most max_open open bins."""

    def __init__(self, capacity: int, max_open: int):
        self.capacity, self.max_open = capacity, max_open
        self.bits, self.open, self.bins = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        found = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece of 1 to capacity tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            free, found = self.capacity, self.bins
            self.bins += 1
            if length < self.capacity and self.open == self.max_open:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        left = free - length
        if left:
            self.by_free[left].append(found)
            self.bits |= 1 << left
            self.open += 1
        return found, self.capacity - free


def pack_documents(
    docs: DataFrame,
    capacity: int = 2048,
    max_open: int = 4096,
    file: str = "word_bpe_49k.json",
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str | None = None,
    with_ids: bool = False,
    memo_bytes: int = MEMO_BYTES,
    span_bytes: int | None = SPAN_BYTES,
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with
    with_ids the piece's ids as little-endian unsigned 32-bit integers.

    A document is its ids and end_id. Only documents longer than capacity are cut, into pieces of
    capacity tokens and a shorter last one; any piece may share a sequence. Null and empty texts are
    a piece with end_id alone. Repeated rows are documents of their own. sequence_id holds the
    partition above 32 bits of a number within it; a partition that is computed again gets the same.
    memo_bytes and span_bytes bound what a worker holds, and change only the time that it takes."""
    bound_batches(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def pack(rows):
        model, bins = token_ids(file, folder, True, memo_bytes, span_bytes), BestFit(capacity, max_open)
        base, end = TaskContext.get().partitionId() << 32, end_id.to_bytes(4, "little")
        for doc_ids, texts in text_batches(rows, ["doc_id"]):
            out, kept = [], []
            for doc_id, found in zip(doc_ids, model.of(texts)):
                ids = found.astype("<u4").tobytes() + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    place, offset = bins.place(len(piece) // 4)
                    out.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece), base + place, offset))
                    kept.append(piece)
            arrays = [pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, zip(*out))]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return plain.mapInArrow(pack, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens. Alone, packing has room for the whole memo."""
    return pack_documents(documents(spark, sf_dir), memo_bytes=Memo.BYTES, span_bytes=None)
