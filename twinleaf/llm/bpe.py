"""Byte-level BPE in two tiers, and its inverse.

A minimal perfect hash over the vocabulary resolves pre-tokens that are tokens as a whole: one probe,
one comparison. The others are merged on linked bytes with a heap of candidate pairs, least rank
first. Ids decode by table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, bound_batches, documents, text_batches, tokenizer_path, worker_model
from .library_tokens import gather, spans


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: n keys, n slots, by hash and displace.

    Keys fall into n buckets; from the largest bucket down, a displacement is sought that sends its
    keys to free slots, and buckets of one key name their slot outright."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.shift = np.zeros(max(n, 1), np.int64)
        hashes = self.hashes(keys)
        bucket = (hashes % np.uint64(max(n, 1))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)) if n else np.zeros(1, int)
        groups = sorted((order[a:b] for a, b in zip(edges, edges[1:])), key=len, reverse=True)
        taken, self.slot_of = np.zeros(n, bool), np.zeros(n, np.int64)
        free = None
        for g in groups:
            if len(g) == 1:
                free = iter(np.flatnonzero(~taken).tolist()) if free is None else free
                slot = next(free)
                self.shift[bucket[g[0]]], self.slot_of[g[0]] = -slot - 1, slot
                continue
            d = 1
            while True:
                slots = self._mix(hashes[g], np.array([d], np.uint64))
                if not taken[slots].any() and len(set(slots.tolist())) == len(g):
                    break
                d += 1
            taken[slots] = True
            self.shift[bucket[g[0]]], self.slot_of[g] = d, slots

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        import xxhash

        return np.array([xxhash.xxh64_intdigest(k, 7) for k in keys], np.uint64)

    def _mix(self, h: np.ndarray, d) -> np.ndarray:
        x = h ^ (d * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key; a string that is not a key gets any slot."""
        h = self.hashes(keys)
        d = self.shift[(h % np.uint64(self.n)).astype(np.int64)]
        return np.where(d < 0, -d - 1, self._mix(h, np.maximum(d, 0).astype(np.uint64)))


class BytePairs:
    """Encoder and decoder for a table of ranks; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.rank, self.split = ranks, regex.compile(pattern).findall
        self.hash = PerfectHash(list(ranks))
        self.keys: list[bytes] = [b""] * len(ranks)
        self.ids = [0] * len(ranks)
        for (key, rank), slot in zip(ranks.items(), self.hash.slot_of.tolist()):
            self.keys[slot], self.ids[slot] = key, rank
        listed = sorted(ranks, key=ranks.__getitem__)
        self.bytes_at, self.size_at = np.frombuffer(b"".join(listed), np.uint8), np.fromiter(map(len, listed), np.int64, len(listed))
        self.place_of = {i: k for k, i in enumerate(sorted(ranks.values()))}
        self.dense = all(i == k for i, k in self.place_of.items())
        self.pieces = Memo(self._encode_pieces)

    @classmethod
    def load(cls, path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word by repeated merging of the adjacent pair with the least rank, the leftmost
        of equals. end[i] is where the token at i ends, 0 once it is part of an earlier one."""
        n, rank = len(word), self.rank.get
        end, prev = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, j = pop(heap)
            mid = end[i]
            if not mid or mid >= j or end[mid] != j:
                continue  # one of the two has been merged meanwhile
            end[i], end[mid], prev[j] = j, 0, i
            if j < n and (r := rank(word[i : end[j]])) is not None:
                push(heap, (r, i, end[j]))
            p = prev[i]
            if p >= 0 and (r := rank(word[p:j])) is not None:
                push(heap, (r, p, j))
        out, i = [], 0
        while i < n:
            out.append(self.rank[word[i : end[i]]])
            i = end[i]
        return out

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        split = [self.split(p.decode()) for p in pieces]
        words = list(set().union(*split))
        raw = [w.encode() for w in words]
        keys, ids, merge, slots = self.keys, self.ids, self.merge, self.hash.slots(raw).tolist()
        get = {w: array("I", [ids[s]] if keys[s] == r else merge(r)).tobytes() for w, r, s in zip(words, raw, slots)}.__getitem__
        return [get(x[0]) if len(x) == 1 else b"".join(map(get, x)) for x in split]

    def encode_texts(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        parts: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
        for pieces, distinct, edges, first, _ in spans(texts):
            found = self.pieces.values(distinct)
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            ids = gather(np.frombuffer(b"".join(found), np.uint32), sizes, pieces)
            at = np.append(0, np.cumsum(sizes[pieces]))[edges].tolist()
            for k, (a, b) in enumerate(itertools.pairwise(at)):
                if b > a:
                    parts[first + k].append(ids[a:b])
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.uint32) for x in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        at = ids if self.dense else np.array([self.place_of[i] for i in ids.tolist()], np.int64)
        return gather(self.bytes_at, self.size_at, at).tobytes()


def model(path: str | None = None) -> BytePairs:
    """This worker's encoder."""

    def make() -> BytePairs:
        import public_tokenizers

        return BytePairs.load(path or tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

    return worker_model(("bpe", path), make)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and with with_ids the ids.

    Every match of the pattern in the whole text is encoded separately; the ids are decoded again.
    Null and empty texts have no ids: both digests are those of nothing. Repeated rows are encoded
    each; an empty table gives no rows."""
    bound_batches(docs.sparkSession)

    def encode(rows):
        bpe, digest = model(path), hashlib.sha256
        for doc_ids, texts in text_batches(rows, ["doc_id"]):
            ids = bpe.encode_texts(texts)
            arrays = [
                pa.array(doc_ids, pa.int64()),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([digest(" ".join(map(str, x.tolist())).encode()).hexdigest() for x in ids]),
                pa.array([digest(bpe.decode(x)).hexdigest() for x in ids]),
            ]
            more = [pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(arrays + more, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return plain.mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode and decode all documents."""
    return encode_documents(documents(spark, sf_dir))
