"""Token ids in shard files with Elias-Fano coded document boundaries.

A shard is one binary record: a header, the concatenated ids in 2 or 4 bytes each, the boundaries of
its documents and their ids, both as Elias-Fano sequences. Records lie in a Parquet folder, so any
store that Spark writes will do, and Spark's commit protocol covers lost executors.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bound_batches, documents, shared_dir, text_batches
from .library_tokens import token_ids

#: Tokens after which a shard is closed; a longer document has a shard of its own.
SHARD_TOKENS = 1 << 20
#: Every how many ones the position of a one is stored.
SAMPLE = 256
_EF, _HEAD = "<QQBII", "<4sBIIQQQQ"
_POP = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of integers in about 2 + log2(universe / n) bits each.

    The low bits of each value lie side by side; the high bits are gaps in unary. value(i) needs the
    position of the i-th one, found from the nearest sampled one."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, universe = len(v), int(v[-1]) + 1 if len(v) else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, universe, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack(_EF, self.n, self.universe, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The sequence at the start of data, and the bytes it takes."""
        n, universe, low_bits, n_low, n_high = struct.unpack_from(_EF, data)
        at = struct.calcsize(_EF)
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        samples = np.frombuffer(data, "<u4", -(-n // SAMPLE), at + n_low + n_high)
        return cls(n, universe, low_bits, low, high, samples), at + n_low + n_high + samples.nbytes

    def select(self, i: int) -> int:
        """Position of the i-th one in the high bits, from the sampled one at or before it."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while left >= (ones := word.bit_count()):
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return (byte << 3) + (word & -word).bit_length() - 1

    def select_all(self) -> np.ndarray:
        """Positions of all ones: what select gives for 0..n-1."""
        return np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]

    def value(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, low = i * self.low_bits, 0
        for k in range(self.low_bits):
            low |= (int(self.low[(at + k) >> 3]) >> ((at + k) & 7) & 1) << k
        return (self.select(i) - i) << self.low_bits | low

    def values(self) -> np.ndarray:
        high = (self.select_all() - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        return high | (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def write_shard(doc_ids: list[int | None], sizes: list[int], ids: bytes, width: int) -> bytes:
    """A shard record. doc_ids ascend, nulls first; sizes are numbers of ids; ids are the documents' ids
    side by side, as little-endian unsigned integers of width bytes."""
    bounds = EliasFano.build(np.cumsum([0, *sizes])).to_bytes()
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    names = EliasFano.build((known - base).astype(np.uint64)).to_bytes()
    head = struct.pack(_HEAD, b"TLEF", width, len(doc_ids), len(doc_ids) - len(known), len(ids) // width, base & 0xFFFFFFFFFFFFFFFF, len(ids), len(bounds))
    return b"".join((head, ids, bounds, names))


class Shard:
    """A shard record, opened for reading: doc_ids, bounds (Elias-Fano) and the ids of a document."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, width, self.n_docs, self.n_null, self.n_tokens, base, n_body, n_bounds = struct.unpack_from(_HEAD, view)
        if magic != b"TLEF":
            raise ValueError("not a shard")
        at = struct.calcsize(_HEAD)
        self.tokens = np.frombuffer(view, f"<u{width}", self.n_tokens, at)
        self.bounds, _ = EliasFano.from_bytes(view[at + n_body :])
        self._names, self._base = EliasFano.from_bytes(view[at + n_body + n_bounds :])[0], base - (1 << 64) if base >> 63 else base

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document, its ends looked up by select."""
        return self.tokens[self.bounds.value(i) : self.bounds.value(i + 1)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + (self._names.values().astype(np.int64) + self._base).tolist()


def write_store(docs: DataFrame, path: str, file: str = "byte_bpe_50k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> None:
    """Encode every whole text, append end_id, and write shards in ascending order of doc_id.

    Null ids come first; equal ids are ordered by the hash of their text (and the text). Null and empty texts have end_id alone.
    Texts are shuffled once, by range, and encoded after it; a worker holds one shard at a time."""
    bound_batches(docs.sparkSession)

    def write(rows):
        model, part = token_ids(file, folder), TaskContext.get().partitionId()
        width = model.width
        end = end_id.to_bytes(width, "little")
        names, sizes, held, shard, start = [], [], bytearray(), 0, 0

        def flush():
            nonlocal names, sizes, held, shard, start
            size = len(held) // width
            record = write_shard(names, sizes, held, width)
            out = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((part, pa.int32()), (shard, pa.int32()), (start, pa.int64()), (size, pa.int64()), (record, pa.binary()))], ["part", "shard", "part_start", "n_tokens", "record"])
            names, sizes, held, shard, start = [], [], bytearray(), shard + 1, start + size
            return out

        for doc_ids, texts in text_batches(rows, ["doc_id"]):
            for doc_id, ids in zip(doc_ids, model.of(texts)):
                if sizes and len(held) // width + len(ids) >= SHARD_TOKENS:
                    yield flush()
                held += ids.tobytes()
                held += end
                names.append(doc_id)
                sizes.append(len(ids) + 1)
        if sizes:
            yield flush()

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ordered = plain.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    ordered.mapInArrow(write, "part int, shard int, part_start long, n_tokens long, record binary").write.option("compression", "zstd").parquet(path)


def read_store(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in a store. start is global: a sum for
    each written partition (as many numbers as there were partitions) goes to the readers."""
    shards = spark.read.parquet(path)
    sizes = sorted(shards.groupBy("part").agg(F.sum("n_tokens")).collect())
    starts, total = {}, 0
    for part, n in sizes:
        starts[part] = total
        total += n

    def read(rows):
        for parts, locals_, records in batches(rows, ["part", "part_start", "record"]):
            for part, local, record in zip(parts, locals_, records):
                shard = Shard(record)
                bounds = shard.bounds.values().astype(np.int64)
                flat = memoryview(shard.tokens.astype("<u4").tobytes())
                edges = (bounds * 4).tolist()
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids(), pa.int64()), pa.array(bounds[:-1] + (starts[part] + local)), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "part_start", "record").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_store(spark, sf_dir: str) -> DataFrame:
    """Write all documents to a store in the shared folder and read it back."""
    import uuid

    path = f"{shared_dir(spark)}/twinleaf-tables/store-{uuid.uuid4().hex}"
    write_store(documents(spark, sf_dir), path)
    return read_store(spark, path)
