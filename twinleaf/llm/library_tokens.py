"""Token ids by the tokenizers library, one distinct piece at a time.

Texts are cut at safe boundaries, places that no match of the library's pre-tokenizer spans, so the
ids of a text are the ids of its pieces in order. Cutting, counting distinct pieces and putting ids
together are array operations on the bytes of an Arrow column; the library encodes each distinct piece
once for as long as a bounded memo keeps it, and whatever the memo forgets is encoded again.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import Memo, tokenizer_path, worker_model

#: Bytes of text that are cut and looked up together, and of new pieces in one call of the library.
SPAN_BYTES, CALL_BYTES = 4 << 20, 1 << 18
_SPACE, _LETTER, _MARK, _HIGH = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[ord(c) for c in ".,!?;:"]] = _MARK
_KIND[[0, *range(28, 32), *range(128, 256)]] = _HIGH


def _odd_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before data[at] is white space outside ASCII, or a character that
    libraries disagree about. data[at - 1] is of kind _HIGH."""
    c, b, a = data[at - 1], np.where(at > 1, data[at - 2], 0), np.where(at > 2, data[at - 3], 0)
    two = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
    general = (a == 0xE2) & (b == 0x80) & ((c <= 0x8F) | ((c >= 0xA8) & (c <= 0xAF)))
    more = (a == 0xE2) & (b == 0x81) & (c >= 0x9F) & (c <= 0xA4)
    single = (a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E)))
    wide = ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xEF) & (b == 0xBB) & (c == 0xBF))
    return (c < 0x20) | two | general | more | single | wide


def _eastern(data: np.ndarray) -> np.ndarray:
    """Places between a letter of a script without spaces and a mark that ends a clause."""
    lead = np.flatnonzero((data[3:-2] == 0xE3) | (data[3:-2] == 0xEF)) + 3
    if not len(lead):
        return lead
    code = lambda p: ((data[p] & 15).astype(np.int32) << 12) | ((data[p + 1] & 63).astype(np.int32) << 6) | (data[p + 2] & 63)
    mark, letter, before = code(lead), code(lead - 3), data[lead - 3]
    marks = np.isin(mark, [0x3001, 0x3002, 0xFF01, 0xFF0C, 0xFF1A, 0xFF1B, 0xFF1F])
    letters = ((letter >= 0x3041) & (letter <= 0x3096)) | ((letter >= 0x30A1) & (letter <= 0x30FA)) | ((letter >= 0x4E00) & (letter <= 0x9FFF)) | ((letter >= 0xAC00) & (letter <= 0xD7A3))
    return lead[marks & letters & (before >= 0xE3) & (before <= 0xED)]


def cuts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes before which a text may be cut, in ascending order: before a run of ASCII white
    space behind anything but space, between an ASCII letter and the punctuation after it, and between
    an eastern letter and the mark after it.

    No match of the pre-tokenizers holds a non-space followed by a space, or a letter followed by
    punctuation, and each piece keeps its whole run of space, odd space included, so look-ahead sees
    what it saw in the text. Tokenizers that drop white space never join characters across such places
    either, be it by normalization to NFC or to lower case."""
    kind = _KIND[data]
    here, before = kind[1:], kind[:-1]
    at = np.flatnonzero(((here == _SPACE) & (before != _SPACE)) | ((here == _MARK) & (before == _LETTER))) + 1
    doubtful = kind[at - 1] == _HIGH
    if doubtful.any():
        doubtful[doubtful] = _odd_space(data, at[doubtful])
        at = at[~doubtful]
    if (data >= 0xE3).any() and len(east := _eastern(data)):
        at = np.sort(np.concatenate([at, east]))
    return at


def spans(texts: pa.Array, span: int | None = None) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, int, int]]:
    """The texts of a string array without nulls, in spans of about SPAN_BYTES (or span): (pieces, distinct, edges,
    first, last). pieces are the pieces of the texts first..last-1 in order, as numbers in distinct;
    edges are the numbers of pieces before each of these texts and at the end.

    A longer text goes on in the next span. Only where it has no safe boundary a span is longer."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
    at, end, size = int(offsets[0]), int(offsets[-1]), span or SPAN_BYTES
    while at < end:
        stop = min(at + size, end)
        if stop < end:  # the last text that ends there, or else the last safe boundary
            known = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            stop = known if known > at else stop
        window = data[at:stop]
        inner = cuts(window) + at if len(window) > 1 else np.zeros(0, np.int64)
        if stop < end and int(offsets[np.searchsorted(offsets, stop)]) != stop:
            if not len(inner):
                size *= 2
                continue
            stop, inner = int(inner[-1]), inner[:-1]
        first = int(np.searchsorted(offsets, at, "right")) - 1
        last = int(np.searchsorted(offsets, stop, "left"))
        here = np.zeros(stop - at, bool)
        here[inner - at] = here[offsets[first + 1 : last] - at] = here[0] = True
        begins = np.flatnonzero(here) + at
        bounds = np.append(begins, stop).astype(np.int32)
        listed = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(bounds), whole]).dictionary_encode()
        edges = np.searchsorted(begins, np.clip(offsets[first : last + 1], at, stop))
        yield listed.indices.to_numpy(), listed.dictionary.to_pylist(), edges, first, last
        at, size = stop, span or SPAN_BYTES


def gather(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """values holds runs of the given sizes side by side; the runs that which names, side by side."""
    chosen = sizes[which]
    ends = np.cumsum(chosen)
    shift = (np.cumsum(sizes) - sizes)[which] - (ends - chosen)
    return values[np.repeat(shift, chosen) + np.arange(ends[-1] if len(ends) else 0)]


def call_sizes(pieces: list[str]) -> list[slice]:
    """Slices of pieces with about CALL_BYTES of UTF-8 each, one piece at least."""
    out, start, size = [], 0, 0
    for i, p in enumerate(pieces):
        size += (len(p) if p.isascii() else len(p.encode())) + 16
        if size >= CALL_BYTES:
            out.append(slice(start, i + 1))
            start, size = i + 1, 0
    return [*out, slice(start, len(pieces))] if start < len(pieces) else out


class Library:
    """A tokenizer file in the tokenizers library, for pieces of texts.

    Pieces that may stand side by side without any effect on their ids go through the batch encoder
    WORDS to a text, and the bytes of their tokens tell where the ids of each end. For byte-level
    tokenizers (drops_space false) these are all that begin with space and end with none; for others
    those of characters whose lower case is known. All other pieces are texts of
    their own in the same encoder."""

    WORDS = 512
    _SIDE = re.compile(rb"[ \t-\r][\x00-\xff]*[!-~]")
    #: Space, then ASCII and Latin letters (U+00C0 to U+024F without the dotted capital I and two signs).
    _PLAIN = re.compile(rb"[ \t-\r]+(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+")

    def __init__(self, file: str, folder: str | None = None, drops_space: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(os.path.join(folder, file) if folder else tokenizer_path(file))
        self.batch = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        self.drops_space, self.fits = drops_space, (self._PLAIN if drops_space else self._SIDE).fullmatch
        vocabulary, suffix = self.library.get_vocab(), getattr(self.library.model, "end_of_word_suffix", None) or ""
        top = max(vocabulary.values(), default=0)
        #: Bytes of an id where they are kept: 2 where all ids fit, else 4.
        self.width = 2 if top < 1 << 16 else 4
        self.bytes_of = np.zeros(top + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token.removesuffix(suffix) if suffix else token)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for part in call_sizes(texts) for e in self.batch(texts[part], add_special_tokens=False)]

    def encode(self, pieces: list[bytes], pack, pack_each) -> list:
        """A value for each piece: pack_each(ids, edges) gives those of pieces whose ids lie side by side,
        pack(ids) that of one piece."""
        out: list = [None] * len(pieces)
        side = [i for i, p in enumerate(pieces) if self.fits(p)]
        if side:
            there = [pieces[i] for i in side]
            texts = [b"".join(there[k : k + self.WORDS]).decode() for k in range(0, len(there), self.WORDS)]
            ids = np.fromiter(itertools.chain.from_iterable(self._ids(texts)), np.int64)
            sizes = np.fromiter(map(len, there), np.int64, len(there))
            if self.drops_space:  # without the space before each; few letters have more bytes in lower case
                bare = map(bytes.strip, there)
                sizes = np.fromiter((len(p) if p.isascii() else len(p.decode().lower().encode()) for p in bare), np.int64, len(there))
            ends, wanted = np.cumsum(self.bytes_of[ids]), np.cumsum(sizes)
            at = np.searchsorted(ends, wanted)
            if len(ends) and ends[-1] == wanted[-1] and (ends[at] == wanted).all():
                for i, value in zip(side, pack_each(ids, [0, *(at + 1).tolist()])):
                    out[i] = value
        rest = [i for i, value in enumerate(out) if value is None]
        for i, ids in zip(rest, self._ids([pieces[i].decode() for i in rest])):
            out[i] = pack(ids)
        return out


class Counts:
    """Numbers of ids of texts, by a byte-level tokenizer."""

    def __init__(self, library: Library):
        self.memo = Memo(lambda pieces: library.encode(pieces, len, lambda ids, edges: np.diff(edges).tolist()))

    def of(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for pieces, distinct, edges, first, last in spans(texts):
            before = np.append(0, np.cumsum(np.array(self.memo.values(distinct), np.int64)[pieces]))
            out[first:last] += np.diff(before[edges])
        return out


class Ids:
    """Ids of texts, as arrays of unsigned integers of `width` bytes."""

    def __init__(self, library: Library, memo_bytes: int = Memo.BYTES, span_bytes: int | None = None):
        self.width, self.span_bytes, kind = library.width, span_bytes, f"<u{library.width}"
        self.kind, width = kind, library.width

        def side_by_side(ids: np.ndarray, edges: list[int]) -> list[bytes]:
            flat = ids.astype(kind).tobytes()
            return [flat[a * width : b * width] for a, b in itertools.pairwise(edges)]

        self.memo = Memo(lambda pieces: library.encode(pieces, lambda ids: np.array(ids, kind).tobytes(), side_by_side), memo_bytes)

    def parts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(ids, sizes, first) for spans of texts: the ids of the texts from first on side by side, and how
        many each has. A long text goes on in the next span, whose first it is then again."""
        for pieces, distinct, edges, first, _ in spans(texts, self.span_bytes):
            found = self.memo.values(distinct)
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.width
            ids = gather(np.frombuffer(b"".join(found), self.kind), sizes, pieces)
            yield ids, np.diff(np.append(0, np.cumsum(sizes[pieces]))[edges]), first

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        held, at = [], 0
        none = np.zeros(0, self.kind)
        for ids, sizes, first in self.parts(texts):
            ends = np.cumsum(sizes)
            for k, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
                while at < first + k:  # the text before is whole
                    yield np.concatenate(held) if len(held) > 1 else held[0] if held else none
                    held, at = [], at + 1
                if size:
                    held.append(ids[end - size : end])
        while at < len(texts):
            yield np.concatenate(held) if len(held) > 1 else held[0] if held else none
            held, at = [], at + 1


def token_counts(file: str, folder: str | None = None) -> Counts:
    """This worker's counts by a byte-level tokenizer file."""
    return worker_model(("count", file, folder), lambda: Counts(Library(file, folder)))


def token_ids(file: str, folder: str | None = None, drops_space: bool = False, memo_bytes: int = Memo.BYTES, span_bytes: int | None = None) -> Ids:
    """This worker's ids by a tokenizer file."""
    return worker_model(("ids", file, folder, drops_space, memo_bytes, span_bytes), lambda: Ids(Library(file, folder, drops_space), memo_bytes, span_bytes))
