import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from twinleaf.llm import library_tokens, packing
from twinleaf.llm.bpe import PerfectHash, encode_documents, model
from twinleaf.llm.common import Memo
from twinleaf.llm.library_tokens import token_counts, token_ids
from twinleaf.llm.packing import BestFit, pack_documents
from twinleaf.llm.token_counts import count_tokens
from twinleaf.llm.token_store import EliasFano, Shard, read_store, write_shard, write_store

from .data import awkward, documents, empty


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def u32(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def rank_library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000])
def test_perfect_hash_is_minimal(n):
    keys = [f"key{i}".encode() for i in range(n)]
    h = PerfectHash(keys)
    assert sorted(h.slot_of.tolist()) == list(range(n))
    if n:
        assert h.slots(keys).tolist() == h.slot_of.tolist()


def test_heap_merges_like_the_library(rank_library):
    bpe, r = model(), random.Random(1)
    for _ in range(300):
        text = "".join(r.choice("abc dé. \n'") for _ in range(r.randrange(60)))
        ids = bpe.encode_texts(pa.array([text]))[0]
        assert ids.tolist() == rank_library.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


@pytest.mark.parametrize("make", [documents, awkward, empty])
def test_bpe_documents(spark, rank_library, make):
    docs = make(spark)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in encode_documents(docs).collect())
    want = []
    for i, t in rows_of(docs):
        ids = rank_library.encode_ordinary(t)
        want.append((i is None, i or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)


@pytest.mark.parametrize("make", [documents, awkward, empty])
def test_counts(spark, byte_level, make):
    docs = make(spark)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(docs).collect())
    want = [(str(i), len(t.encode()), n := len(byte_level.encode(t, add_special_tokens=False)), n > 512) for i, t in rows_of(docs)]
    assert got == sorted(want)


@pytest.mark.parametrize("make", [documents, awkward, empty])
def test_packing(spark, make):
    library, docs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), make(spark)
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in pack_documents(docs, capacity=64, max_open=4).collect():
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for i, t in rows_of(docs):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want[i] += [(k, at, len(ids[at : at + 64]), zlib.crc32(u32(ids[at : at + 64]))) for k, at in enumerate(range(0, len(ids), 64))]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64


def test_best_fit_takes_the_least_space_and_closes_the_fullest():
    b = BestFit(10, 2)
    assert [b.place(n) for n in (6, 7, 3, 4, 9, 8)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0)]
    assert b.place(5) == (4, 0)  # both open bins are too full: the one with one free token closes
    assert b.place(2) == (3, 8) and b.place(5) == (4, 5)


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [3, 3, 9, 1000, 10**12], list(range(0, 5000, 3))])
def test_elias_fano(values):
    ef, used = EliasFano.from_bytes(memoryview(EliasFano.build(np.array(values, np.uint64)).to_bytes() + b"rest"))
    assert ef.values().tolist() == values
    assert [ef.value(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        ef.value(len(values))


def test_elias_fano_is_small():
    bounds = np.cumsum(np.random.default_rng(1).integers(1, 2000, 20000))
    assert len(EliasFano.build(bounds).to_bytes()) < 20000 * 14 / 8  # not 8 bytes each


@pytest.mark.parametrize("width", [2, 4])
def test_shard_round_trip(width):
    ids = [[1, 2, 3], [2], [65535 if width == 2 else 70000, 5]]
    for docs in ([-4, 7, 7], [None, -(2**62), 2**62]):
        shard = Shard(write_shard(docs, list(map(len, ids)), np.array(sum(ids, []), f"<u{width}").tobytes(), width))
        assert shard.doc_ids() == docs and [shard.ids(i).tolist() for i in range(3)] == ids


@pytest.mark.parametrize("make", [documents, awkward, empty])
def test_store(spark, byte_level, make, tmp_path):
    docs = make(spark)
    write_store(docs, f"{tmp_path}/store")
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read_store(spark, f"{tmp_path}/store").collect()), key=lambda x: x[0])
    ids = [[*byte_level.encode(t, add_special_tokens=False).ids, 2] for _, t in rows_of(docs)]
    want = sorted((i is not None, i or 0, len(x), zlib.crc32(u32(x))) for (i, _), x in zip(rows_of(docs), ids))
    assert sorted((d is not None, d or 0, n, c) for _, d, n, c in got) == want
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    known = [d for _, d, _, _ in got if d is not None]
    assert known == sorted(known)


#: ASCII and other space, marks, eastern clauses, special strings, and letters whose case changes their size.
ODD_PARTS = [*"ab \u00e9.,!? \n\t\x0b\x1c\x1f\x85", *map(chr, (0xA0, 0x202F, 0x3000, 0x200B, 0x2003, 0x1680, 0x180E, 0x2028, 0xFEFF, 0x3001, 0x3002, 0x65E5, 0x304B, 0x3099, 0xFF0C, 0xAC00, 0x3A3, 0x130, 0x301)), "'s", "'ll", "12", "<|endoftext|>", " \u00c0\u00c9", " \u023ab", "\u023e"]


def odd_texts(n: int, seed: int, most: int = 40) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choices(r.sample(ODD_PARTS, 8), k=r.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("span_bytes", [24, 4 << 20])
def test_pieces_give_the_ids_of_whole_texts(monkeypatch, byte_level, rank_library, span_bytes):
    monkeypatch.setattr(library_tokens, "SPAN_BYTES", span_bytes)
    texts, words = odd_texts(3000, span_bytes), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    column = pa.array(["before", *texts])[1:]  # a slice of a longer column
    lists = lambda found: [x.tolist() for x in found]
    assert lists(token_ids("word_bpe_49k.json", drops_space=True).of(column)) == [e.ids for e in words.encode_batch(texts, add_special_tokens=False)]
    want = byte_level.encode_batch(texts, add_special_tokens=False)
    assert lists(token_ids("byte_bpe_50k.json").of(column)) == [e.ids for e in want]
    assert token_counts("byte_bpe_50k.json").of(column).tolist() == [len(e.ids) for e in want]
    assert lists(model().encode_texts(column)) == [rank_library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("unit", ["mot\u00a0: un\u202fmot, ", "\u65e5\u672c\u8a9e\u3002\u65e5\u672c\uff0c", "plain words, here. "])
def test_long_texts_are_cut(monkeypatch, byte_level, unit):
    monkeypatch.setattr(library_tokens, "SPAN_BYTES", 1 << 18)
    text = unit * (3_000_000 // len(unit.encode()))
    found = list(library_tokens.spans(pa.array(["a b", text, "", "c"])))
    assert len(found) > 8 and max(len(x) for _, distinct, *_ in found for x in distinct) < 40
    assert b"".join(distinct[p] for pieces, distinct, *_ in found for p in pieces).decode() == "a b" + text + "c"
    got = [x.tolist() for x in token_ids("byte_bpe_50k.json").of(pa.array(["a b", text, "", "c"]))]
    assert got == [e.ids for e in byte_level.encode_batch(["a b", text, "", "c"], add_special_tokens=False)]


def test_a_text_without_boundaries_is_one_piece(monkeypatch, byte_level):
    monkeypatch.setattr(library_tokens, "SPAN_BYTES", 100)
    texts = ["x" * 5000, None, "", "y z"]
    got = [x.tolist() for x in token_ids("byte_bpe_50k.json").of(pa.array([t or "" for t in texts]))]
    assert got == [byte_level.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_gather():
    runs = [[1, 2], [], [3], [4, 5, 6]]
    flat, sizes = np.array(sum(runs, [])), np.array(list(map(len, runs)))
    for which in ([], [1], [3, 0, 0, 1, 2], [2, 1, 3]):
        assert library_tokens.gather(flat, sizes, np.array(which, int)).tolist() == sum((runs[i] for i in which), [])


def test_memo_is_bounded_and_keeps_no_long_keys():
    seen = []

    def compute(keys):
        seen.extend(keys)
        return [k.upper() for k in keys]

    memo, r = Memo(compute, limit=20_000), random.Random(2)
    for _ in range(200):
        keys = list({bytes([r.choice(b"abcdef")]) * r.randrange(1, 60) for _ in range(60)} | {b"x" * 1000, b"x" * 5000})
        assert memo.values(keys) == [k.upper() for k in keys]
        assert max(map(len, [*memo.young, *memo.old])) <= Memo.LONG
    assert len(memo.young) < 400 and len(seen) > 400


def test_packing_alone_has_the_whole_memo(spark, monkeypatch):
    """op8 gives its workers the whole memo, those that served the pipeline included."""
    small = token_ids("word_bpe_49k.json", None, True, packing.MEMO_BYTES, packing.SPAN_BYTES)
    whole = token_ids("word_bpe_49k.json", None, True, Memo.BYTES, None)
    assert whole.memo.limit == Memo.BYTES > small.memo.limit == packing.MEMO_BYTES and whole.span_bytes is None
    asked = {}
    monkeypatch.setattr(packing, "documents", lambda *_: documents(spark))
    monkeypatch.setattr(packing, "pack_documents", lambda docs, **options: asked.update(options) or docs)
    packing.op8_packing(spark, "")
    assert asked == {"memo_bytes": Memo.BYTES, "span_bytes": None}


def test_a_worker_holds_one_model():
    first = token_ids("byte_bpe_50k.json")
    assert token_ids("byte_bpe_50k.json") is first
    token_counts("byte_bpe_50k.json")
    assert token_ids("byte_bpe_50k.json") is not first
