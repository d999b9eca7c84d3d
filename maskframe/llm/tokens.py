"""Token ids of whole texts.

The tokenizer always cuts before a space that a visible character follows, and
between letters, full stops and line ends, so the pieces between such cuts have
the same ids alone as in the text.  Each distinct piece of a chunk goes to the
tokenizers library once; a bounded cache keeps the pieces of earlier chunks.
A special token's string inside a text is that token, as in a plain call of the library.
"""

from __future__ import annotations

import os
import re
from codecs import charmap_decode
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from maskframe.llm.words import ranges
from maskframe.llm.words import texts as byte_run

#: Bytes of text that are encoded at a time.
CHUNK_BYTES = 8 << 20
#: Pieces that a process keeps at most, in each of two generations: what the older one has and nobody asks for goes.
CACHE = 450_000
#: A piece that the tokenizer does not cut any further.
_WORD = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+")
_ENCODERS: dict[str, Encoder] = {}


def vocabulary_path() -> str:
    """Where the installed vocabulary file of the byte-level tokenizer is, on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}  # bytes whose letter is their own; the others' letters follow from 256 on
        hidden = [b for b in range(0x100) if b not in shown]
        self.letters = "".join(chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(0x100))

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, as bytes of unsigned 32-bit integers."""
        found = [self.known.get(p) for p in pieces]
        new = [i for i, ids in enumerate(found) if ids is None]
        if self.older:
            for i in new:
                found[i] = self.older.get(pieces[i])
        made = new
        new = [i for i in made if found[i] is None]
        rest = []
        for i in new:
            if _WORD.fullmatch(pieces[i]):  # the model alone takes half the time
                tokens = self.model.tokenize(charmap_decode(pieces[i].encode(), "strict", self.letters)[0])
                found[i] = pack(f"<{len(tokens)}I", *[t.id for t in tokens])
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = np.array(e.ids, dtype="<u4").tobytes()
        if len(self.known) + len(made) > CACHE:
            self.known, self.older = {}, self.known
        if len(made) <= CACHE:
            self.known.update((pieces[i], found[i]) for i in made)
        return found

    def encode(self, texts: pa.Array, end: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Index of the first text of a chunk, ids of all its texts, and where each text's ids start, with the end.

        ``end`` is an id to put behind every text.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        sizes = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy())))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + CHUNK_BYTES, side="right")) - 1)
            yield at, *self._chunk(texts.slice(at, to - at), end)
            at = to

    def _chunk(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = byte_run(texts)
        cut = cuts(data, offsets)
        cut[offsets] = True
        at = np.flatnonzero(cut)
        pieces = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        codes, bounds = pieces.indices.to_numpy().astype(np.int64), np.searchsorted(at[:-1], offsets)
        ids = self.pieces(pieces.dictionary.to_pylist())
        if end is not None:
            codes = np.insert(codes, bounds[1:], len(ids))
            bounds = bounds + np.arange(len(bounds))
            ids.append(np.array([end], dtype="<u4").tobytes())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(lengths) - lengths
        ends = np.concatenate(([0], np.cumsum(lengths[codes])))
        return flat[ranges(starts[codes], lengths[codes])], ends[bounds]


_ASCII = np.arange(256)
_IS_LETTER = ((_ASCII | 0x20) >= 0x61) & ((_ASCII | 0x20) <= 0x7A) & (_ASCII < 0x80)
_IS_STOP = np.isin(_ASCII, [0x2C, 0x2E])
#: Visible ASCII, and first bytes of two-byte characters beyond U+00BF, of which none is white space.
_IS_SEEN = ((_ASCII > 0x20) & (_ASCII < 0x7F)) | ((_ASCII >= 0xC3) & (_ASCII <= 0xDF))


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether the tokenizer surely cuts before a byte, for every byte of texts and the end."""
    cut = np.zeros(len(data) + 1, dtype=bool)
    if len(data):
        before, after = data[:-1], data[1:]
        seen = _IS_SEEN[after]
        line = (before == 0x0A) & seen
        cut[1:-1] = line | _IS_LETTER[before] & _IS_STOP[after]
        line |= (before == 0x20) & seen
        last = offsets[1:-1]
        line[last[(last > 0) & (last < len(data))] - 1] = False  # what follows is another text
        cut[:-2] |= line
    return cut


def encoder(path: str | None = None) -> Encoder:
    """This process's encoder of a vocabulary file (None: the installed one)."""
    path = path or vocabulary_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
